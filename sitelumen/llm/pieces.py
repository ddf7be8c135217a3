"""SentencePiece encoding and decoding by a streaming Viterbi search.

The model is of merged pieces: of two neighbouring symbols, those are merged first whose piece scores highest. The
pieces of a text's merged form are a path of which each step is allowed: merging its two pieces' characters alone
gives just these two pieces. So a search from left to right finds it: a cell behind each character holds the piece
that ends there on a surviving path, and a piece may follow a cell's if that pair is allowed.
No piece is longer than a bound, so only that many cells are live; as soon as all their back pointers meet in one
boundary, the ids before it are committed and their cells dropped. Where no piece can go on, every path meets, so a
text is searched segment by segment, and a segment that a task has searched before is remembered.
Control pieces are never made from text, and a text's own U+2581 is written as bytes, so decoding is exact.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Segments, of so many characters at most, and pairs of pieces that a task remembers.
KEPT_SEGMENTS, KEPT_LENGTH, KEPT_PAIRS = 400_000, 64, 1_000_000
#: Segments end where no piece goes on: before a space that follows something else and, if no piece holds what FINE_CUT
#: finds, at line feeds and behind runs of letters. (Superscript digits count as no letters.)
_LETTER = r"[^\W\d_²³¹]"
_OTHER = rf"(?:(?![{MARK}\n])[\W\d_²³¹])"
COARSE = f"{MARK}+[^{MARK}]*|[^{MARK}]+"
FINE = rf"\n|{MARK}+{_OTHER}*{_LETTER}*|{_OTHER}+{_LETTER}*|{_LETTER}+"
FINE_CUT = re.compile(rf"\n|{_LETTER}(?=[\W\d_²³¹])")


def vocabulary_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encodes and decodes texts with the pieces of one model."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: list[int] = [0] * 256
        self.data: list[bytes] = [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.data[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[piece], self.id[piece] = model.get_score(i), i
                self.data[i] = piece.replace(MARK, " ").encode()
        self.text = {i: p for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id):
            raise ValueError("pieces must not go on after a space")  # so a segment's beginning is a boundary
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, i in self.id.items():
            if all(c in self.id for c in p):  # others are never merged
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.length = [len(self.text.get(i, "")) for i in range(size)]
        #: Merges by score, best first, and equal scores alike; characters come before all.
        order = sorted({-self.score[p] for p in self.id if len(p) > 1})
        place = {v: k for k, v in enumerate(order)}
        self.rank = {i: place[-self.score[p]] if len(p) > 1 else -1 for p, i in self.id.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.segment = re.compile(FINE if not any(FINE_CUT.search(p) for p in self.id) else COARSE)
        self.segments: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str, stop: int = 0) -> list[str]:
        """The pieces of a short text, by merging: highest score first, leftmost of equal ones. ``stop`` -1: the two
        symbols before the last merge."""
        parts = list(text)
        while True:
            best, at = None, 0
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None or (stop and len(parts) == 2):
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def parts(self, piece: int) -> tuple[int, int] | None:
        """The two pieces that were merged last into ``piece``; none of a character. A piece that merging its
        characters doesn't give has itself twice."""
        if piece not in self.halves:
            text, found = self.text[piece], None
            if len(text) > 1:
                found = (piece, piece)
                if self.merged(text) == [text]:
                    steps = self.merged(text, -1)
                    found = (self.id[steps[0]], self.id[steps[1]])
            self.halves[piece] = found
        return self.halves[piece]

    def allowed(self, before: int, piece: int) -> bool:
        """May ``piece`` follow ``before`` on a path? -1: may it begin one?

        Both are undone merge by merge, the latest first. At each step, the two symbols at the border must not have
        been merged before what was undone: that is, by a better score, or by an equal one further left.
        """
        key = (before + 1) * len(self.data) + piece
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.parts(piece) != (piece, piece) and (before < 0 or self._parted(before, piece))
        return known

    def _parted(self, before: int, piece: int) -> bool:
        left, right, limit = before, piece, len(self.data)
        while True:
            joint = self.id.get(self.text[left] + self.text[right])
            if joint is not None and self.rank[joint] < limit:
                return False
            if self.rank[left] > self.rank[right]:
                left, limit = self.parts(left)[1], self.rank[left]
            elif halves := self.parts(right):
                right, limit = halves[0], self.rank[right] + 1
            else:
                return True

    def viterbi(self, text: str) -> Iterator[int]:
        """The ids of ``text``, which begins a path, each as soon as it is sure."""
        length, known, size, longest = self.length, self.pairs.get, len(self.data), self.longest
        # By cell beyond ``base``: the piece that ends there on a surviving path; -1 where a path begins.
        last = {0: -1}
        base = upto = 0

        def path(cell: int) -> list[int]:
            out = []
            while cell > base:
                out.append(last[cell])
                cell -= length[last[cell]]
            return out[::-1]

        for at, piece in self.automaton.iter(text):
            if at >= upto:
                # A character that no piece has gives no hit: a path ends before it and begins behind it.
                if at > upto:
                    yield from path(upto)
                    yield from self._bytes(text[upto:at])
                    base, last = at, {at: -1}
                upto = at + 1
                if upto - longest > base and (sure := self._common(last, base, upto - longest)) > base:
                    yield from path(sure)
                    base, last = sure, {c: p for c, p in last.items() if c >= sure}
            if upto not in last:
                before = last.get(upto - length[piece])
                if before is not None:
                    allowed = known((before + 1) * size + piece)
                    if allowed or (allowed is None and self.allowed(before, piece)):
                        last[upto] = piece
        yield from path(upto)
        yield from self._bytes(text[upto:])

    def _bytes(self, text: str) -> Iterator[int]:
        return (self.byte[b] for b in text.encode("utf-8", "surrogatepass"))

    def _common(self, last: dict[int, int], base: int, gone: int) -> int:
        """The last boundary that the paths of all live cells share; those up to ``gone`` are live no more.

        The latest cell steps back along its path until one is left.
        """
        live = {c for c in last if c >= gone}
        while len(live) > 1:
            cell = max(live)
            live.remove(cell)
            live.add(cell - self.length[last[cell]] if cell > base else base)
        return live.pop() if live else base

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers; none of an empty one."""
        if not text:
            return b""
        out, known = [], self.segments
        for k, part in enumerate(text.split(MARK)):
            segments = self.segment.findall((MARK if not k else "") + part.replace(" ", MARK))
            if fresh := set(segments).difference(known):
                if len(known) + len(fresh) > KEPT_SEGMENTS:
                    known.clear()
                    fresh = set(segments)
                for segment in fresh:
                    known[segment] = np.fromiter(self.viterbi(segment), "<u4").tobytes()
            out.append(b"".join(map(known.__getitem__, segments)))
            for segment in fresh:
                if len(segment) > KEPT_LENGTH:
                    del known[segment]
        return np.array([self.byte[b] for b in MARK.encode()], "<u4").tobytes().join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids that ``encode`` gave."""
        return b"".join(map(self.data.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids``, an array, in place of ``text``; null for a null text, empty for an empty one. No shuffle."""
    return _mapped(docs, text, "ids", "array<int>", pa.list_(pa.int32()), path or vocabulary_path(), lambda c, t: c.encode(t))


def decode(docs: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``text`` in place of ``ids``; null for null. No shuffle."""
    return _mapped(docs, ids, text, "string", pa.string(), path or vocabulary_path(), lambda c, i: c.decode(i))


def _mapped(docs: DataFrame, old: str, new: str, kind: str, arrow: pa.DataType, path: str, one) -> DataFrame:  # noqa: ANN001
    columns = [c for c in docs.columns if c not in (old, new)]
    kept = docs.select(*columns, old)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in common.slices(batches, old) if new == "ids" else batches:
            made = [None if v is None else one(own, v) for v in batch.column(old).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(made, arrow)], [*columns, new])

    return kept.mapInArrow(run, kept.drop(old).withColumn(new, F.lit(None).cast(kind)).schema)


def round_trip(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, exact) of every row of ``docs``: its ids, and the text they give back.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit numbers, ``decoded_sha256`` of the decoded text in
    UTF-8; ``exact``: it is the text. Null texts count as empty. Repeated rows and null ids stay. No shuffle.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in common.slices(batches, "text"):
            rows = []
            for key, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = own.packed(t or "")
                back = own.decode(np.frombuffer(ids, "<u4").tolist())
                rows.append((key, len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (t or "")))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "exact"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, exact boolean")
