"""Secret scans: patterns that stand alone, and weak parts of credentials that are linked where they complement each other.

A weak part proves nothing by itself: an identifier, a random-looking string, an endpoint. Parts are joined by
interval within a scope (a paragraph): two parts of complementary roles at most REACH code points apart report
each other. The join is a sweep over a text's spans by start with the furthest end so far, so that a part finds a
complement wherever one lies in reach, and a text costs time in proportion to its length and spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32

BASE = ("assign", "access", "hex")
IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"
WEAK_ID = re.compile(r"\b(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}+\b|\b(?:client_id|account|user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{4,}")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
URL = re.compile(r"\b(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s\"'<>]{4,}")
#: Ends of service hosts; the host is what its characters reach back to.
HOST_END = re.compile(r"\.(?:amazonaws\.com|core\.windows\.net|googleapis\.com)(?![a-z0-9-])")
HOST = frozenset("abcdefghijklmnopqrstuvwxyz0123456789.-")
#: Of each weak kind: the role, the roles that complement it, and what a text must hold for one to be there.
WEAK = {
    "weak_id": (IDENTIFIER, (SECRET,), ("ASIA", "AIDA", "AROA", ":", "=")),
    "weak_secret": (SECRET, (IDENTIFIER, ENDPOINT), ("",)),
    "endpoint": (ENDPOINT, (SECRET,), ("://", ".amazonaws.com", ".windows.net", ".googleapis.com")),
}
KINDS = (*BASE, *WEAK)
#: Roles that base spans play for the weak ones.
BASE_ROLE = {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET}
REACH = 300
#: Bits a character that a weak secret has at least; it also holds letters and digits.
LEAST_ENTROPY = 3.5
SCOPE_END = re.compile(r"\n[\x20\t]*\n")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def base_spans(text: str) -> list[Span]:
    """What the base patterns find, leftmost and non-overlapping by kind; too short finds are dropped."""
    found = [Span("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE] if ":" in text or "=" in text else []
    found += [Span("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return found + [Span("hex", m.start(), m.end()) for m in HEX_RUN.finditer(text) if m.end() - m.start() >= HEX_LENGTH]


#: The same finds as HEX has from HEX_LENGTH on: a run is never part of a longer one.
HEX_RUN = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{HEX_LENGTH},}}")


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def _random_looking(text: str) -> bool:
    body = text.rstrip("=")
    return any(c.isdigit() for c in body) and any(c.islower() for c in body) and any(c.isupper() for c in body) and entropy(body) >= LEAST_ENTROPY


def hosts(text: str) -> list[tuple[int, int]]:
    """Where names of services stand. Each character is looked at a bounded number of times."""
    found: list[tuple[int, int]] = []
    for m in HOST_END.finditer(text):
        limit = found[-1][1] if found else 0
        start = m.start()
        while start > limit and text[start - 1] in HOST:
            start -= 1
        if found and start == limit and text[start] in HOST:
            found[-1] = (found[-1][0], m.end())  # it goes on from the one before
            continue
        while text[start] in ".-" and start < m.start():
            start += 1
        if start < m.start():
            found.append((start, m.end()))
    return found


def weak_parts(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all weak parts, linked or not."""
    there = {kind for kind, (_, _, needed) in WEAK.items() if any(part in text for part in needed)}
    out = [("weak_id", m.start(), m.end()) for m in WEAK_ID.finditer(text)] if "weak_id" in there else []
    out += [("weak_secret", m.start(), m.end()) for m in WEAK_SECRET.finditer(text) if _random_looking(m[0])]
    if "endpoint" in there:
        urls = [(m.start(), m.end()) for m in URL.finditer(text)]
        starts = [a for a, _ in urls]
        out += [("endpoint", a, b) for a, b in urls]
        for a, b in hosts(text):
            k = bisect_left(starts, b)
            if not k or urls[k - 1][1] <= a:  # not within a URL
                out.append(("endpoint", a, b))
    return out


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """The weak parts that have a complement within REACH in their scope; those that overlap a base span are not parts."""
    edges = sorted((s.start, s.end) for s in base)
    starts = [a for a, _ in edges]
    furthest = list(accumulate((b for _, b in edges), max))
    weak = []
    for kind, a, b in weak_parts(text):
        k = bisect_left(starts, b)
        if not k or furthest[k - 1] <= a:
            weak.append(Span(kind, a, b))
    if not weak:
        return []
    scopes = [m.start() for m in SCOPE_END.finditer(text)]
    by_role: dict[str, list[tuple[int, int, int]]] = {IDENTIFIER: [], SECRET: [], ENDPOINT: []}
    for s in (*weak, *base):
        by_role[WEAK[s.kind][0] if s.kind in WEAK else BASE_ROLE[s.kind]].append((bisect_right(scopes, s.start), s.start, s.end))
    ends = {}
    for role, spans in by_role.items():
        spans.sort()
        # The furthest end of a scope's spans up to each; scopes come first, so an end of one can't reach the next.
        reach = accumulate(((scope, end) for scope, _, end in spans), lambda x, y: max(x, y) if x[0] == y[0] else y)
        ends[role] = ([(scope, start) for scope, start, _ in spans], list(reach))
    out = []
    for s in weak:
        scope = bisect_right(scopes, s.start)
        for role in WEAK[s.kind][1]:
            first, reach = ends[role]
            k = bisect_right(first, (scope, s.end + REACH))
            if k and reach[k - 1][0] == scope and reach[k - 1][1] >= s.start - REACH:
                out.append(s)
                break
    return out


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind as listed."""
    base = base_spans(text)
    place = {k: i for i, k in enumerate(KINDS)}
    order = lambda s: (s.start, place[s.kind], s.end)
    return sorted(base, key=order), sorted([*base, *linked_spans(text, base)], key=order)


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) of every row of ``docs``.

    ``spans`` are kind:start:end in code points, the end exclusive, joined by commas. Null and empty texts have
    none. Repeated rows and null ids stay. No shuffle: scopes lie within a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            rows = []
            for key, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base, every = find(t or "")
                n = Counter(s.kind for s in base)
                rows.append((key, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(map(str, base)).encode()).hexdigest(), ",".join(map(str, every)), len(every) - len(base)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with each stretch of spans replaced by ``mark``; endpoints stay, since they hold no secret."""
    out, at = [], 0
    for s in find(text)[1]:
        if s.kind == "endpoint":
            continue
        if s.start >= at:
            out += [text[at : s.start], mark]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the spans found in ``text`` replaced by ``mark``. Null texts stay null; all other columns stay."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            made = [None if t is None else redacted(t, mark) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if c == text else batch.column(c) for c in columns], columns)

    return docs.mapInArrow(run, docs.withColumn(text, F.lit(None).cast("string")).schema)
