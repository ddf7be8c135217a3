"""Chat formatting: typed content parts, turn marks, and a loss mask over what assistants say.

A turn is written between control strings of its role. Texts are escaped so that they can't hold a control string:
every control string starts with ``[`` or ``<``, and in a text these two, and the backslash, are followed by a
backslash that the reader drops. Content is flattened by a visitor: texts stay, attachments become numbered
placeholders, and their references and the tokens that they will take are recorded in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<number:int,type:string,ref:string,tokens:long,at:int>"
#: What stands before and after the content of a turn, by role; other roles are named in their marks.
MARKS = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("[REPLY] ", " [/REPLY]</s>")}
LOSS_ROLE = "assistant"
#: Tokens of an attachment: an image's patches, an audio's frames, a document's pages.
IMAGE_PATCH, AUDIO_TOKENS_A_SECOND, DOCUMENT_TOKENS_A_PAGE = 28, 25.0, 512

_ESCAPE = re.compile(r"[\[<\\]")
_UNESCAPE = re.compile(r"([\[<\\])\\")
_TURN = re.compile(r"(?:<<SYS>> (?P<system>.*) <</SYS>>|\[INST\] (?P<user>.*) \[/INST\]|\[REPLY\] (?P<assistant>.*) \[/REPLY\]</s>|\[ROLE:(?P<name>[^\]]*)\] (?P<other>.*) \[/ROLE\])", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (f"[ROLE:{quote(role, safe='')}] ", " [/ROLE]")


@dataclass
class Flattener:
    """Visits content parts in order. ``pieces`` are the formatted strings; ``attachments`` rows of ATTACHMENT."""

    first: int = 1
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0

    def visit(self, part: dict) -> None:
        """A part of unknown type keeps its text, if it has one."""
        {"image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}.get(part.get("type"), self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (-(-max(1, part.get(side) or 1) // IMAGE_PATCH) for side in ("width", "height"))
        self._attach(part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach(part, max(1, round((part.get("seconds") or 0) * AUDIO_TOKENS_A_SECOND)))

    def visit_document(self, part: dict) -> None:
        """A document's own text, if given, follows its placeholder."""
        self._attach(part, max(1, part.get("pages") or 1) * DOCUMENT_TOKENS_A_PAGE)
        if part.get("text"):
            self.visit_text(part)

    def _attach(self, part: dict, tokens: int) -> None:
        number = self.first + len(self.attachments)
        self.attachments.append({"number": number, "type": part["type"], "ref": part.get("ref"), "tokens": tokens, "at": self.length})
        self._add(f"<|{part['type']}:{number}|>")

    def _add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)


def text_parts(text: Column) -> Column:
    """Plain text as content of one part; null as an empty text."""
    return F.from_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text")))), f"array<{PART}>")


SEGMENT = f"formatted string, loss_start int, loss_end int, attachments array<{ATTACHMENT}>, expanded_tokens long"
_ATTACHMENT = pa.list_(pa.struct([("number", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("at", pa.int32())]))


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str | None = "text", parts: str | None = None) -> DataFrame:
    """(conv_id, turn, tie, formatted, loss_start, loss_end, attachments, expanded_tokens), a row a turn.

    A conversation's text is its turns' ``formatted``, in order of (turn, tie), one after the other. Content is
    ``parts``, an array of PART, or the plain ``text``. ``loss_start`` and ``loss_end`` are code points of
    ``formatted`` (null outside assistant turns); attachments are numbered within their turn. Null roles count as
    empty, null contents have no parts; rows of one conversation and turn are ordered by ``tie``, a digest of the
    role and the content; repeated rows are repeated turns. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            out = []
            for c, t, who, plain, content in zip(*(batch.column(k).to_pylist() for k in ("conv", "turn", "role", "text", "parts")), strict=True):
                flat = Flattener()
                for part in content if content is not None else [{"type": "text", "text": plain}]:
                    if part is not None:
                        flat.visit(part)
                before, after = marks(who or "")
                said = "".join(flat.pieces)
                masked = (len(before), len(before) + len(said)) if who == LOSS_ROLE else (None, None)
                tie = hashlib.md5(f"{who or ''}\n{said}".encode()).hexdigest()
                shifted = [a | {"at": a["at"] + len(before)} for a in flat.attachments]
                out.append((c, t, tie, before + said + after, *masked, shifted, sum(a["tokens"] for a in shifted)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), _ATTACHMENT, pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["conv_id", "turn", "tie", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"])

    content = F.col(parts).cast(f"array<{PART}>") if parts else F.lit(None).cast(f"array<{PART}>")
    plain = F.col(text) if text else F.lit(None).cast("string")
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), plain.alias("text"), content.alias("parts"))
    return rows.mapInArrow(run, f"conv_id long, turn long, tie string, {SEGMENT}")


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, content): what was written, with texts as they were and placeholders still in place."""
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError("not a formatted turn")
    if m["name"] is not None:
        return unquote(m["name"]), unescape(m["other"])
    return m.lastgroup, unescape(m[m.lastgroup])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted turns alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_attachments, expanded_tokens.

    Conversations are dealt by id and streamed in order with constant memory, however many turns one has; a digest
    over a conversation is a chain, so one task reads all of it. Null ids are one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        at, state, done = none, None, []

        def emptied() -> pa.RecordBatch:
            rows = [(c, n, turns.hexdigest(), chars, loss.hexdigest(), total, files, tokens) for c, (n, turns, chars, loss, total, files, tokens) in done]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows, strict=True)) or [()] * len(schema), schema.types, strict=True)], schema.names)

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("expanded_tokens", pa.int64())])
        for batch in common.slices(batches, "formatted"):
            for c, text, start, end, files, tokens in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_start", "loss_end", "files", "expanded_tokens")), strict=True):
                if at is none or c != at:
                    if state is not None:
                        done.append((at, state))
                    at, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, content = read_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{content}\n".encode())
                if start is not None:
                    masked = unescape(text[start:end])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
                state[5] += files
                state[6] += tokens
            if done:
                yield emptied()
        if state is not None:
            done.append((at, state))
            yield emptied()

    rows = formatted.select("conv_id", "turn", "tie", "formatted", "loss_start", "loss_end", F.size("attachments").alias("files"), "expanded_tokens")
    ordered = rows.repartition(common.wide(formatted.sparkSession), "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "tie")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")
