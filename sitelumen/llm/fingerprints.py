"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A shingle hash is a number below 2**32. A sketch keeps every hash below ``limit``, a fixed fraction of 2**32, so
sketches of very unequal documents can be merged and give containment as well as likeness. A text with fewer than
``floor`` hashes below the limit keeps its ``floor`` smallest ones, and the sketch then states the higher limit
below which it is whole; one that keeps all its hashes is whole up to 2**32, and exact.
Two sketches are compared below the lower of their limits, where both are whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

SHINGLE_WORDS = 5
FRACTION = 1 / 2
FLOOR = 128
WHOLE = 1 << 32
#: Documents in a range of doc_id, the unit that is shuffled and read in order; several ranges make a partition. There
#: are RANGES at most.
RANGE_ROWS, RANGES = 1024, 20_000

Sketch = tuple[int, np.ndarray]


def sketches(texts: list[str | None], fraction: float = FRACTION, floor: int = FLOOR) -> list[Sketch]:
    """(limit, sorted distinct hashes below it) of each text. Null and texts without words: (2**32, nothing)."""
    w = wordhash.words(texts, lower=True)
    hashes, at = wordhash.window_hashes(w, wordhash.word_hashes(w), SHINGLE_WORDS)
    hashes >>= np.uint64(32)
    ends = np.searchsorted(w.doc[at], np.arange(len(texts) + 1))
    low = int(WHOLE * fraction)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        kept = hashes[a:b]
        few = kept[kept < low]
        if len(few) >= floor and len(few := np.unique(few)) >= floor:
            out.append((low, few.astype(np.uint32)))
            continue
        kept = np.unique(kept)
        if len(kept) <= floor:
            out.append((WHOLE, kept.astype(np.uint32)))
        else:
            limit = max(low, int(kept[floor - 1]) + 1)
            out.append((limit, kept[kept < limit].astype(np.uint32)))
    return out


def to_text(sketch: Sketch) -> str:
    """The limit in 9 hex digits, a colon and the hashes in base 64, little-endian."""
    return f"{sketch[0]:09x}:{base64.b64encode(sketch[1].astype('<u4').tobytes()).decode()}"


def from_text(text: str) -> Sketch:
    limit, _, packed = text.partition(":")
    return int(limit, 16), np.frombuffer(base64.b64decode(packed), "<u4")


def _below(a: Sketch, b: Sketch) -> tuple[np.ndarray, np.ndarray]:
    limit = min(a[0], b[0])
    return tuple(s if whole <= limit else s[: np.searchsorted(s, np.uint64(limit))] for whole, s in (a, b))


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts' shingles together."""
    return min(a[0], b[0]), np.union1d(*_below(a, b))


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated share of the shingles of either that both have; 1 if neither has any."""
    x, y = _below(a, b)
    both = _shared(x, y)
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 if ``a`` has none."""
    x, y = _below(a, b)
    return _shared(x, y) / len(x) if len(x) else 1.0


def fingerprint(docs: DataFrame, text: str = "text", fraction: float = FRACTION, floor: int = FLOOR) -> DataFrame:
    """``docs`` with the column ``fingerprint`` in place of ``text``; other columns and repeated rows stay.

    Null and empty texts have the sketch of no shingles. Equal texts have equal fingerprints. No shuffle.
    """
    rest = [c for c in docs.columns if c not in (text, "fingerprint")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            made = [to_text(s) for s in sketches(batch.column(text).to_pylist(), fraction, floor)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(made, pa.string())], [*rest, "fingerprint"])

    kept = docs.select(*rest, text)
    return kept.mapInArrow(run, kept.drop(text).withColumn("fingerprint", F.lit("")).schema)


def _ranges(docs: DataFrame, key: str) -> list[int]:
    """Lower ends of ranges of ``key`` with about RANGE_ROWS rows each, ascending; all but the lowest range."""
    rows = docs.count()
    n = min(RANGES, max(1, -(-rows // RANGE_ROWS)))
    if n == 1:
        return []
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).first()[0]
    return sorted(set(cuts or []))


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, guest, id, text): documents dealt into ranges of id, each with the first row of the range after it.

    The order is descending id, null ids last, rows of one id by text, null first. The row after a range's last row
    is the first row of the range with the next lower ids (after the lowest: of the highest), and is there as a
    ``guest``; where several rows share that id, all are. So each range can be read alone.
    """
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id), F.lit(lowest)).cast("long").alias("key"), F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    cuts = np.array(_ranges(rows.select("key"), "key"), np.int64)

    @F.pandas_udf("long")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(np.int64), "right"))

    dealt = rows.withColumn("bucket", bucket("key"))
    heads = sorted(map(tuple, rows.select("key").withColumn("bucket", bucket("key")).groupBy("bucket").agg(F.max("key").alias("key")).collect()))  # a row a range
    hosts = {key: heads[(i + 1) % len(heads)][0] for i, (_, key) in enumerate(heads)}
    own = dealt.select("bucket", F.lit(False).alias("guest"), "id", "text")
    if not hosts:
        return own
    # A head is a guest of the range just above its own, and the highest head of the lowest range.
    host = F.broadcast(docs.sparkSession.createDataFrame([(k, int(b)) for k, b in hosts.items()], "key long, host long"))  # RANGES rows at most
    visits = F.array_distinct(F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.struct(F.coalesce("host", "bucket").alias("bucket"), F.col("host").isNotNull().alias("guest"))))
    return dealt.join(host, "key", "left").select(F.explode(visits).alias("v"), "id", "text").select("v.bucket", "v.guest", "id", "text")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_contained double"


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many, or all, of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edited(docs: DataFrame, id: str = "doc_id", text: str = "text", fraction: float = FRACTION, floor: int = FLOOR) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness to it and to the next document's.

    The next document is the next lower id (see ``with_next``), the highest after the lowest; a lone document is its
    own next. Null texts count as empty. One row a row of ``docs``, repeated ids included. Texts are shuffled once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row of the range that has been read, to be compared with the next one
        at = None

        def compared(pairs: list[tuple]) -> pa.RecordBatch:
            texts = [edited(a[1], b[1]) for a, b in pairs]
            made = sketches(texts, fraction, floor)
            columns = [[a[0] for a, _ in pairs], [len(a[1]) for a, _ in pairs], [hashlib.sha256(t.encode()).hexdigest() for t in texts], [to_text(a[2]) for a, _ in pairs], [to_text(s) for s in made]]
            columns += [[likeness(a[2], s) for (a, _), s in zip(pairs, made, strict=True)], [likeness(a[2], b[2]) for a, b in pairs], [containment(a[2], s) for (a, _), s in zip(pairs, made, strict=True)]]
            return pa.RecordBatch.from_pydict(dict(zip(schema.names, columns, strict=True)), schema=schema)

        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *((c, pa.float64()) for c in ("near_edited", "near_next", "edited_contained"))])
        for batch in common.slices(batches, "text"):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            rows = zip(batch.column("bucket").to_pylist(), batch.column("guest").to_pylist(), batch.column("id").to_pylist(), texts, sketches(texts, fraction, floor), strict=True)
            pairs = []
            for bucket, guest, key, t, sketch in rows:
                if bucket != at:
                    at, held = bucket, None
                row = (key, t, sketch)
                if held is not None:
                    pairs.append((held, row))
                held = None if guest else row  # the first guest ends its range; others with its id are not needed
            if pairs:
                yield compared(pairs)

    # Ranges are dealt in turn, so partitions differ by one range at most.
    dealt = with_next(docs, id, text).repartitionById(common.wide(docs.sparkSession), F.col("bucket").cast("int"))
    return dealt.sortWithinPartitions("bucket", "guest", F.desc_nulls_last("id"), F.asc_nulls_first("text")).mapInArrow(run, EDITED)
