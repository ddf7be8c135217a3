"""Language identification by unigrams of vocabulary pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum, over
all ways to cut it into pieces, of the product of their probabilities: a forward pass over the word. The
probabilities are learned by expectation maximisation, whose counts come from forward and backward passes.
Passes run over many different words at once, position by position; a batch's words are found once each. A word is a
whole run of letters, however long: sums that leave the range of plain numbers anywhere in a word are made again by logarithms.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
WORD = re.compile(r"[^\W\d_]+")
#: Characters of different words that a pass takes at once (a longer word is a pass of its own), and that a task remembers.
PASS_CHARS, KEPT_CHARS = 200_000, 5_000_000
EM_ROUNDS = 1
#: Added to each piece's count; the probability of a letter that no piece covers; what a letter is scaled by.
EXTRA_COUNT, UNKNOWN, SCALE = 0.05, 1e-7, 12.0
#: A word with a scaled sum beyond these in some language is summed again by logarithms: plain sums would lose digits, then all.
LEAST_SUM, MOST_SUM = 1e-200, 1e200
UNDETERMINED = "und"


def vocabulary_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


_STEP = 0x9E3779B97F4A7C15 | 1
_SLOTS = 21  # the table's size as a power of two


@dataclass
class Pieces:
    """Lower-case pieces of letters in a hash table that also has their beginnings, so that a search stops early.

    ``length``: of each piece, and at last of the unknown letter. ``key``, ``value``: by slot, a string's hash and its
    piece, -1 for a mere beginning; a string lies in its slot or the one after.
    """

    length: np.ndarray
    key: np.ndarray
    value: np.ndarray
    factor: np.uint64

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are known, and their pieces."""
        slot = ((hashes * self.factor) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        slot += self.key[slot] != hashes
        return self.key[slot] == hashes, self.value[slot]


def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of code points times powers, and the inverse powers: the hash of [a, b) is (sum b - sum a) * inverse a."""
    up = np.full(len(codes) + 1, _STEP, np.uint64)
    down = np.full(len(codes) + 1, pow(_STEP, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(up)[:-1], out=total[1:])
    return total, np.multiply.accumulate(down)


def _hash(text: str) -> int:
    return sum((ord(c) + 1) * pow(_STEP, k, 1 << 64) for k, c in enumerate(text)) % (1 << 64)


@functools.cache
def pieces(path: str) -> Pieces:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        body = p.removeprefix(MARK)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and p == p.lower() and (body.isalpha() or p == MARK):
            found.append(p)
    value = {p[:n]: -1 for p in found for n in range(1, len(p))} | {p: i for i, p in enumerate(found)}
    entries = [(_hash(p), i) for p, i in value.items()]
    factor = _STEP
    while True:
        key, values = np.zeros((1 << _SLOTS) + 2, np.uint64), np.full((1 << _SLOTS) + 2, -1, np.int64)
        for h, i in entries:
            slot = (h * factor % (1 << 64)) >> (64 - _SLOTS)
            slot += key[slot] != 0
            if key[slot]:
                break
            key[slot], values[slot] = h, i
        else:
            return Pieces(np.array([*map(len, found), 1], np.int64), key, values, np.uint64(factor))
        factor = factor * _STEP % (1 << 64)


def words_of(text: str) -> list[str]:
    """A text's runs of letters, lower-case."""
    return WORD.findall(text.lower())


@dataclass
class Lattice:
    """All places of pieces in some words: piece ``at`` from cell ``start`` to ``end``; ``first``, ``last``: the words' cells."""

    piece: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @functools.cached_property
    def word(self) -> np.ndarray:
        """The word of each arc."""
        return np.searchsorted(self.first, self.start, "right") - 1


def lattice(words: list[str], known: Pieces) -> Lattice:
    joined = "\n".join([MARK + w for w in words]) + "\n"
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = np.cumsum(sizes + 1) - sizes - 1
    total, down = _sums(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"))
    at, ends, hits = np.arange(len(joined)), [], []
    for n in range(1, int(known.length.max()) + 1):
        at = at[: np.searchsorted(at, len(joined) - n, "right")]
        there, value = known.find((total[at + n] - total[at]) * down[at])
        at, value = at[there], value[there]
        whole = value >= 0
        ends.append(at[whole] + n)
        hits.append(value[whole])
    end, piece = np.concatenate(ends), np.concatenate(hits)
    covered = np.zeros(len(joined) + 1, bool)
    covered[end[known.length[piece] == 1]] = True
    covered[first] = covered[-1] = True  # the cells before a word and behind all of them are no letter's end
    bare = np.flatnonzero(~covered)
    end, piece = np.append(end, bare), np.append(piece, np.full(len(bare), len(known.length) - 1))
    return Lattice(piece, end - known.length[piece], end, first, first + sizes)


def _steps(place: np.ndarray, to: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of arcs of one ``place`` in their words, ascending, sorted by ``to``; and where each ``to`` begins."""
    order = np.argsort(place * (int(to.max(initial=0)) + 1) + to)
    edges = np.flatnonzero(np.diff(place[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            yield part, np.flatnonzero(np.append(True, np.diff(to[part]) != 0))


def forward(lat: Lattice, scaled: np.ndarray) -> np.ndarray:
    """For each cell and language, the sum over all segmentations up to it, times SCALE for each character."""
    out = np.zeros((int(lat.last[-1]) + 2, scaled.shape[1]))
    out[lat.first] = 1
    for part, edges in _steps(lat.end - lat.first[lat.word], lat.end):
        out[lat.end[part[edges]]] = np.add.reduceat(out[lat.start[part]] * scaled[lat.piece[part]], edges, axis=0)
    return out


def backward(lat: Lattice, scaled: np.ndarray) -> np.ndarray:
    out = np.zeros((int(lat.last[-1]) + 2, scaled.shape[1]))
    out[lat.last] = 1
    for part, edges in _steps(lat.last[lat.word] - lat.start, lat.start):
        out[lat.start[part[edges]]] = np.add.reduceat(out[lat.end[part]] * scaled[lat.piece[part]], edges, axis=0)
    return out


def beyond(lat: Lattice, sums: np.ndarray) -> np.ndarray:
    """The words that have a sum outside of [LEAST_SUM, MOST_SUM], or none."""
    cells = sums[: int(lat.last[-1]) + 1]
    bad = ~((cells >= LEAST_SUM) & (cells <= MOST_SUM)).all(1)
    return np.flatnonzero(np.logical_or.reduceat(bad, lat.first))


def _log_sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(values, edges, axis=0)
    top = np.where(np.isfinite(top), top, 0)
    each = np.exp(values - np.repeat(top, np.diff(np.append(edges, len(values))), axis=0))
    with np.errstate(divide="ignore"):
        return np.log(np.add.reduceat(each, edges, axis=0)) + top


def log_forward(lat: Lattice, logs: np.ndarray) -> np.ndarray:
    """The logarithm of ``forward``, for any length and probability; ``logs``: of the probabilities, unscaled."""
    out = np.full((int(lat.last[-1]) + 2, logs.shape[1]), -np.inf)
    out[lat.first] = 0
    for part, edges in _steps(lat.end - lat.first[lat.word], lat.end):
        out[lat.end[part[edges]]] = _log_sums(out[lat.start[part]] + logs[lat.piece[part]], edges)
    return out


def log_backward(lat: Lattice, logs: np.ndarray) -> np.ndarray:
    out = np.full((int(lat.last[-1]) + 2, logs.shape[1]), -np.inf)
    out[lat.last] = 0
    for part, edges in _steps(lat.last[lat.word] - lat.start, lat.start):
        out[lat.start[part[edges]]] = _log_sums(out[lat.end[part]] + logs[lat.piece[part]], edges)
    return out


@dataclass
class Model:
    """``langs``, sorted; ``probability``: a row a piece, a column a language."""

    langs: list[str]
    probability: np.ndarray
    path: str

    @functools.cached_property
    def scaled(self) -> np.ndarray:
        return self.probability * SCALE ** pieces(self.path).length[:, None].astype(float)

    @functools.cached_property
    def logs(self) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(self.probability)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The log probability of each word in each language."""
        parts = []
        for some in _passes(words):
            lat = lattice(some, pieces(self.path))
            with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
                ahead = forward(lat, self.scaled)
                parts.append(np.log(ahead[lat.last]) - (lat.last - lat.first)[:, None] * np.log(SCALE))
            if len(low := beyond(lat, ahead)):
                lat = lattice([some[k] for k in low], pieces(self.path))
                parts[-1][low] = log_forward(lat, self.logs)[lat.last]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)))


def _passes(words: list[str]) -> Iterator[list[str]]:
    """``words`` in turn, of about PASS_CHARS characters or one word."""
    start, held = 0, 0
    for i, w in enumerate(words):
        if i > start and held + len(w) > PASS_CHARS:
            yield words[start:i]
            start, held = i, 0
        held += len(w)
    if start < len(words):
        yield words[start:]


def expected(counts: dict[str, np.ndarray], model: Model) -> np.ndarray:
    """How often each piece is expected in each language, given how often each language has each word.

    A model of one column is the same for all languages.
    """
    langs = len(next(iter(counts.values()))) if counts else 0
    out = np.zeros((len(model.probability), langs))

    def add(lat: Lattice, share: np.ndarray, weight: np.ndarray) -> None:
        for k in range(langs):
            own = weight[lat.word, k]
            some_ = np.flatnonzero(own)
            out[:, k] += np.bincount(lat.piece[some_], share[some_, k % share.shape[1]] * own[some_], len(out))

    for some in _passes(list(counts)):
        weight = np.stack([counts[w] for w in some])
        lat = lattice(some, pieces(model.path))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
            ahead, behind = forward(lat, model.scaled), backward(lat, model.scaled)
            share = ahead[lat.start] * model.scaled[lat.piece] * behind[lat.end] / ahead[lat.last][lat.word]
        low = np.union1d(beyond(lat, ahead), beyond(lat, behind))
        rest = weight[low]
        weight[low] = 0
        add(lat, share, weight)
        if len(low):
            lat = lattice([some[k] for k in low], pieces(model.path))
            ahead, behind = log_forward(lat, model.logs), log_backward(lat, model.logs)
            add(lat, np.exp(ahead[lat.start] + model.logs[lat.piece] + behind[lat.end] - ahead[lat.last][lat.word]), rest)
    return out


def is_training(id: str, folds: int = 3, held_out: int = 1) -> Column:
    return F.crc32(F.col(id).cast("string")) % folds != held_out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", path: str | None = None, rounds: int = EM_ROUNDS) -> Model:
    """A model of all languages that ``docs`` names. Rows with a null text or language don't count; all others do.

    The first round starts with all pieces alike. What reaches the driver are a number for each piece and language.
    """
    path = path or vocabulary_path()
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    size = len(pieces(path).length)
    model = Model(langs, np.full((size, 1), 1 / size), path)
    model.probability[-1] = UNKNOWN
    for _ in range(rounds if langs else 0):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            place = {v: k for k, v in enumerate(model.langs)}
            total = np.zeros((len(model.probability), len(place)))
            seen: dict[str, Counter] = {v: Counter() for v in model.langs}
            held = 0  # characters read since the last passes

            def add() -> None:
                nonlocal total, held
                held = 0
                counts: dict[str, np.ndarray] = {}
                for v, own in seen.items():
                    for w, n in own.items():
                        if w not in counts:
                            counts[w] = np.zeros(len(place))
                        counts[w][place[v]] = n
                    own.clear()
                if counts:
                    total = total + expected(counts, model)

            for batch in common.slices(batches, "text"):
                for t, v in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    own, n = seen[v], len(seen[v])
                    own.update(words := words_of(t))
                    # Short words count by their number, so that common ones don't end a pass.
                    held += 8 * (len(own) - n) + sum(len(w) for w in words if len(w) > 64)
                if held > KEPT_CHARS // 3:
                    add()
            add()
            piece, column = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(column), pa.array(total[piece, column])], ["piece", "lang", "n"])

        sums = rows.mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        counts = np.full((size, len(langs)), EXTRA_COUNT)
        found = sums.toPandas()  # pieces times languages at most
        counts[found.piece.to_numpy(np.int64), found.lang.to_numpy(np.int64)] += found.n.to_numpy(float)
        counts[-1] = 0
        probability = counts / counts.sum(0)
        probability[-1] = UNKNOWN
        model = Model(langs, probability, path)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the language's posterior, all languages being alike at first.

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language was learned. The
    first by name wins ties. Columns of the two names are replaced, all others and repeated rows stay. No shuffle.
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*columns).withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        table, held = np.zeros((0, len(model.langs))), 0
        for batch in common.slices(batches, text):
            each = [words_of(t) if t else [] for t in batch.column(text).to_pylist()]
            each = [w if any(c.isalpha() for x in w for c in x) else [] for w in each]
            fresh = list({w for ws in each for w in ws}.difference(place))
            held += sum(map(len, fresh))
            if held > KEPT_CHARS:
                place, table = {}, table[:0]
                fresh = list({w for ws in each for w in ws})
                held = sum(map(len, fresh))
            place.update(zip(fresh, range(len(place), len(place) + len(fresh)), strict=True))
            table = np.concatenate([table, model.word_scores(fresh)]) if fresh else table
            named, scores = [], []
            for ws in each:
                if not ws or not model.langs:
                    named.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total = table[np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))].sum(0)
                best = int(total.argmax())
                named.append(model.langs[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(named, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    return docs.select(*columns).mapInArrow(run, schema)


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None, rounds: int = EM_ROUNDS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``; rows with a null id are held out."""
    model = fit(docs.where(is_training(id)), text, lang, path, rounds)
    named = predict(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")), model)
    return named.select("doc_id", F.coalesce(~is_training("doc_id"), F.lit(True)).alias("held_out"), "lang_pred", "score")
