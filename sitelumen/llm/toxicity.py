"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

1. Some two dozen voters say toxic, clean, or nothing of a text. Their sources are separate: fixed lists of insults by
   language, patterns of spelling, address, dismissal, shouting and punctuation, families of words of one beginning, and lists
   of terms that are learned from disjoint folds of the labelled training rows, for each fold and kind of term alone.
2. Every training document's votes are counted by pattern of votes. On these counts a label model is fitted by expectation
   maximisation, from the plain share of toxic votes: it estimates each voter's accuracy in each class and then, along a
   tree of the strongest dependences within the classes, its correlation with its parent voter. Gold labels have no part
   in it but to say which of the two classes is the toxic one.
3. The model's posteriors are all that the classifier sees: terms are chosen, and a logistic regression is fitted from
   zero, by the posteriors of a bounded sample of documents. Labels then set its scale and bias (two numbers).
4. The classifier scores every document; nothing but its text counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each class that terms are learned from at most, and documents of each posterior class that the
#: classifier is fitted on: those of the lowest hashed ids.
SAMPLE_ROWS, FIT_ROWS = 20_000, 8_000
#: Disjoint parts of the labelled sample, each the source of voters of its own.
FOLDS = 4
#: Kinds of terms: words, words that are dense in a text, and beginnings of words that are dense in it.
KINDS = {"word": "", "dense": "!", "beginning": "*"}
#: Texts of the class that must hold a term.
LEAST_DOCS = 4
#: Log ratio of document shares from which a term is a voter's.
LEXICON_RATIO = 2.0
#: Word beginnings that are terms of their own.
BEGINNINGS = (4, 6)
#: A term is dense if it stands twice in a text, and once in so many words.
DENSE_WORDS = 128
#: Log ratio of document shares, to either side, from which a term is the classifier's.
LEAST_RATIO = 0.7
#: And the standard errors that its counts are away from equal shares, so that of many rare terms hardly one is used by chance.
LEAST_SPREADS = 4.0
#: Texts of each class that are taken to hold a term besides those that do, so that rare terms weigh less.
EXTRA_DOCS = 2
#: Words from which a text without a voter's terms is said to be clean.
CLEAN_WORDS = 10
#: Words of one beginning, of so many letters, that are a family if so many different ones make up one in so many words.
FAMILY_LETTERS, FAMILY_WORDS, FAMILY_SHARE = 5, 3, 64
#: Least information, in nats, that a voter has about another one within the classes for the model to keep it.
LEAST_INFORMATION = 1e-3
EM_ROUNDS, FIT_ROUNDS = 25, 400
#: Patterns of votes that a task counts in a round.
PATTERN_ROWS = 50_000
#: Documents that each cell of the label model's tables counts besides those seen, and the pull of weights to zero.
EXTRA_VOTES, RIDGE = 1.0, 1e-4

#: Insults, as public lists have them.
INSULTS = {
    "en": "idiot idiots idiotic stupid moron morons moronic dumb dumbass fool fools foolish loser losers scum trash garbage pathetic worthless disgusting clown clowns jerk creep filthy vermin imbecile",
    "de": "dumm dummkopf trottel depp blöd blödmann arschloch versager abschaum widerlich ekelhaft lügner schwachkopf mistkerl",
    "fr": "idiote imbécile crétin stupide connard abruti minable dégoûtant ordure raclure menteur salaud débile",
    "es": "idiota estúpido estúpida imbécil tonto basura patético inútil asqueroso escoria payaso mentiroso perdedor",
}
#: How one is addressed, and sent away.
ADDRESS = re.compile(r"\b(?:you(?:'re| are) (?:an?|so|such|all)|you people|du bist|ihr seid|tu es|vous êtes|eres un[ao]?|sois un[ao]s)\b", re.IGNORECASE)
DISMISSAL = re.compile(r"\b(?:shut up|get lost|go away|drop dead|halt die klappe|verpiss dich|ta gueule|casse-toi|cállate|lárgate)\b", re.IGNORECASE)
SHOUTING = re.compile(r"\b[A-Z]{4,}(?: [A-Z]{4,}){2,}\b")
PUNCTUATION = re.compile(r"[!?]{3,}")
STARRED = re.compile(r"[^\W\d_]\*+[^\W\d_]")
SPACED = re.compile(r"(?<!\w)\w(?:[ ._-]\w){3,}(?!\w)")

WORD = re.compile(r"[^\W\d_]+")
LOOKALIKE = str.maketrans("013457@$", "oieastas")
#: Letters, a digit or sign among them, and what follows up to a space. Each run of letters is read once.
SPELLED = re.compile(r"(?<![^\W\d_])[^\W\d_]*+[0-9@$]\S*+")
#: Words whose terms a task remembers.
KEPT_WORDS = 500_000
TOXIC, CLEAN, ABSTAIN = 2, 1, 0

LEARNED = [f"{kind}{fold}" for fold in range(FOLDS) for kind in KINDS]
VOTERS = [*LEARNED, *INSULTS, "spelled", "spaced", "address", "dismissal", "shouting", "punctuation", "starred", "stretched", "family", "plain"]


def _counted(text: str) -> tuple[Counter, float]:
    """A text's words with their counts, and from how many on a term is dense."""
    words = WORD.findall(text.lower())
    return Counter(words), max(2, len(words) / DENSE_WORDS)


def terms_of(text: str) -> set[str]:
    """A text's terms: lower-case words; those that are dense in it, marked by an exclamation mark; and the beginnings
    of longer words that are dense in it, marked by a star. (A beginning that isn't dense proves little: long texts,
    and other languages, hold it by chance.)"""
    counts, least = _counted(text)
    starts: Counter = Counter()
    for n in BEGINNINGS:
        for w, k in counts.items():
            if len(w) > n:
                starts[w[:n] + "*"] += k
    return counts.keys() | {w + "!" for w, k in counts.items() if k >= least} | {w for w, k in starts.items() if k >= least}


class Known:
    """Finds those of a text's terms that are known. Most words have none, which is remembered by word."""

    def __init__(self, terms: Container[str]) -> None:
        self.terms, self.seen = terms, {}

    def _of(self, w: str) -> tuple[bool, bool, list[str]] | None:
        starts = [w[:n] + "*" for n in BEGINNINGS if len(w) > n and w[:n] + "*" in self.terms]
        own = w in self.terms, w + "!" in self.terms, starts
        return own if any(own) else None

    def terms_of(self, text: str, counted: tuple[Counter, float] | None = None) -> set[str]:
        """``terms_of(text)`` as far as they are known. ``counted``: the text's words, if they are counted already."""
        if len(self.seen) > KEPT_WORDS:
            self.seen.clear()
        counts, least = counted or _counted(text)
        seen, found, starts = self.seen, set(), Counter()
        for w, k in counts.items():
            if w not in seen:
                seen[w] = self._of(w)
            if own := seen[w]:
                if own[0]:
                    found.add(w)
                if own[1] and k >= least:
                    found.add(w + "!")
                for t in own[2]:
                    starts[t] += k
        return found | {t for t, k in starts.items() if k >= least}


def is_training(id: str, folds: int = 5) -> Column:
    return F.crc32(F.col(id).cast("string")) % folds != 0


def label_sample(labels: DataFrame, rows: int = SAMPLE_ROWS, id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(doc_id, toxic, weight) of ``rows`` training rows a class at most, by a hash of the id.

    Rows of one id count as one, toxic if half of them are; null ids and labels don't count. ``weight`` makes up for
    the classes' different shares.
    """
    each = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & is_training(id)).groupBy(F.col(id).cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("toxic"))
    parts = []
    for c in (0, 1):
        of = each.where(F.col("toxic") == c)
        parts.append(of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).crossJoin(F.broadcast(of.agg(F.count(F.lit(1)).alias("all")))))  # one row: the count
    both = parts[0].unionByName(parts[1])
    return both.select("doc_id", "toxic", F.greatest(F.lit(1.0), F.col("all") / rows).alias("weight"))


def _term_counts(sample: DataFrame, parts: int) -> DataFrame:
    """(term, part, toxic, clean): the weight of each class that holds each term, from (text, part, toxic), toxic being 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [(Counter(), Counter()) for _ in range(parts)]

        def told() -> Iterator[pa.RecordBatch]:
            for part, (clean, toxic) in enumerate(counts):
                terms = list(clean.keys() | toxic.keys())
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([part] * len(terms), pa.int32()), *(pa.array([c[t] for t in terms], pa.float64()) for c in (toxic, clean))], ["term", "part", "toxic", "clean"])
                clean.clear(), toxic.clear()

        for batch in common.slices(batches, "text"):
            for t, part, y in zip(*(batch.column(c).to_pylist() for c in ("text", "part", "toxic")), strict=True):
                for term in terms_of(t or ""):
                    counts[part][0][term] += 1 - y
                    counts[part][1][term] += y
            if sum(len(c) for c, _ in counts) > 300_000:
                yield from told()
        yield from told()

    summed = sample.select("text", "part", F.col("toxic").cast("double").alias("toxic")).mapInArrow(run, "term string, part int, toxic double, clean double").groupBy("term", "part")
    return summed.agg(F.round(F.sum("toxic"), 6).alias("toxic"), F.round(F.sum("clean"), 6).alias("clean"))


def telling_terms(sample: DataFrame, parts: int = 1) -> DataFrame:
    """(term, part, toxic, clean, ratio, spreads) of (text, part, toxic): each term's log ratio of shares in a part's texts.

    ``spreads``: the root of the likelihood ratio statistic, which counts as standard errors.
    """
    sizes = F.broadcast(sample.groupBy("part").agg(F.sum("toxic").alias("ones"), F.sum(1 - F.col("toxic")).alias("zeros")))  # a row a part
    n, m, ones, zeros = (F.col(c) for c in ("toxic", "clean", "ones", "zeros"))
    share = (n + m) / (ones + zeros)
    term = lambda k, of: F.when(k > 0, k * F.log(k / (share * of))).otherwise(0.0)
    return _term_counts(sample, parts).where(n + m >= LEAST_DOCS).join(sizes, "part").withColumns({
        "ratio": F.log((n + EXTRA_DOCS) / (ones + 2 * EXTRA_DOCS)) - F.log((m + EXTRA_DOCS) / (zeros + 2 * EXTRA_DOCS)),
        "spreads": F.sqrt(F.greatest(F.lit(0.0), 2 * (term(n, ones) + term(m, zeros)))),
    })


def find_voters(sample: DataFrame) -> dict[str, int]:
    """Of each term of a list, the voters that have it, as bits: the learned ones from ``sample`` (text, part, toxic), and the fixed.

    A fold's lists come from its own rows: terms of LEAST_DOCS toxic texts or more, of a high ratio. The sample is bounded,
    so the lists are.
    """
    lists: dict[str, int] = {}
    found = telling_terms(sample, FOLDS).where((F.col("ratio") >= LEXICON_RATIO) & (F.col("spreads") >= LEAST_SPREADS) & (F.col("toxic") >= LEAST_DOCS))
    for r in found.select("term", "part").collect():
        kind = next(k for k, mark in KINDS.items() if mark == (r.term[-1] if r.term[-1] in "!*" else ""))
        lists[r.term] = lists.get(r.term, 0) | 1 << VOTERS.index(f"{kind}{r.part}")
    for lang, words in INSULTS.items():
        for w in words.split():
            lists[w] = lists.get(w, 0) | 1 << VOTERS.index(lang)
    return lists


def _families(counts: Counter) -> bool:
    """Whether several different words of one beginning make up much of a text."""
    words = Counter([w[:FAMILY_LETTERS] for w in counts if len(w) > FAMILY_LETTERS])
    several = {b for b, n in words.items() if n >= FAMILY_WORDS}
    if not several:
        return False
    uses, total = Counter(), sum(counts.values())
    for w, k in counts.items():
        if w[:FAMILY_LETTERS] in several and len(w) > FAMILY_LETTERS:
            uses[w[:FAMILY_LETTERS]] += k
    return any(FAMILY_SHARE * k >= total for k in uses.values())


_INSULTS = frozenset(w for words in INSULTS.values() for w in words.split())
_LEARNED_BITS = (1 << len(LEARNED)) - 1
#: Patterns that are searched only where one of some strings stands, as most texts have none.
_HINTS = {
    "address": (ADDRESS, ("you", "du bist", "ihr seid", "tu es", "vous êtes", "eres un", "sois un")), "dismissal": (DISMISSAL, ("shut up", "get lost", "go away", "drop dead", "klappe", "verpiss", "ta gueule", "casse-toi", "cállate", "lárgate")),
    "punctuation": (PUNCTUATION, ("!!", "??", "!?", "?!")), "starred": (STARRED, ("*",)),
}
_CAPITALS, _SIGNS = re.compile(r"[A-Z]{4}"), re.compile(r"[0-9@$]")
_LETTER = np.zeros(256, bool)
_LETTER[np.arange(ord("a"), ord("z") + 1)] = True


def _stretched(low: str) -> bool:
    """Whether a letter from a to z stands four times in a row."""
    b = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8)
    same = b[1:] == b[:-1]
    return bool(_LETTER[b[3:][same[2:] & same[1:-1] & same[:-2]]].any())


def votes(text: str, known: Known) -> tuple[int, int]:
    """(toxic, clean): the voters that say so, as bits. ``known``: finds terms, each with the voters that have it."""
    low = text.lower()
    toxic, counted = 0, _counted(text)
    counts = counted[0]
    for t in known.terms_of(text, counted):
        toxic |= known.terms[t]
    says = {name: any(x in low for x in hints) and pattern.search(text) is not None for name, (pattern, hints) in _HINTS.items()}
    says["shouting"] = _CAPITALS.search(text) is not None and SHOUTING.search(text) is not None
    says["stretched"] = _stretched(low)
    says["family"] = _families(counts)
    if _SIGNS.search(text):
        says["spelled"] = any(w in _INSULTS for m in SPELLED.findall(text) if any(map(str.isalpha, m)) for w in WORD.findall(m.lower().translate(LOOKALIKE)))
    if sum([k for w, k in counts.items() if len(w) == 1]) > 3:
        says["spaced"] = any(re.sub(r"[ ._-]", "", m.lower()) in _INSULTS for m in SPACED.findall(text))
    for name, said in says.items():
        toxic |= said << VOTERS.index(name)
    clean = 0
    if sum(counts.values()) >= CLEAN_WORDS:
        clean = _LEARNED_BITS & ~toxic
        if not toxic:
            clean |= 1 << VOTERS.index("plain")
    return toxic, clean


def unpacked(toxic: np.ndarray, clean: np.ndarray, voters: int = len(VOTERS)) -> np.ndarray:
    """A row a pattern and a column a voter: ABSTAIN, CLEAN or TOXIC."""
    bit = np.arange(voters)
    return TOXIC * (toxic[:, None] >> bit & 1) + CLEAN * (clean[:, None] >> bit & 1)


@dataclass
class LabelModel:
    """``prior`` of class 1; ``parent`` of each voter, -1 without one; ``table``: log shares by class, the parent's vote and the own."""

    prior: float
    parent: np.ndarray
    table: np.ndarray  # (voters, 2, 3, 3)

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        score = np.full(len(vote), np.log(self.prior) - np.log1p(-self.prior))
        for v, of in enumerate(self.parent):
            above = vote[:, of] if of >= 0 else 0
            score += self.table[v, 1, above, vote[:, v]] - self.table[v, 0, above, vote[:, v]]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def majority(vote: np.ndarray) -> np.ndarray:
    """The share of toxic votes among those that are given; 0 where there are none."""
    return (vote == TOXIC).sum(1) / np.maximum((vote != ABSTAIN).sum(1), 1)


def pair_counts(vote: np.ndarray, count: np.ndarray, share: np.ndarray) -> np.ndarray:
    """(2, 3 voters, 3 voters): of each class the weight of texts in which two voters vote so. On the diagonal, of one voter."""
    hot = np.zeros((len(vote), vote.shape[1] * 3))
    hot[np.arange(len(vote))[:, None], np.arange(vote.shape[1]) * 3 + vote] = 1
    return np.stack([hot.T @ (hot * (count * s)[:, None]) for s in (1 - share, share)])


def _fitted(pairs: np.ndarray, parent: np.ndarray) -> LabelModel:
    n = len(parent)
    cells = pairs.reshape(2, n, 3, n, 3)
    table = np.zeros((n, 2, 3, 3))
    for v, of in enumerate(parent):
        own = cells[:, v, range(3), v, range(3)]  # (class, vote)
        alone = (own + EXTRA_VOTES / 3) / (own.sum(1, keepdims=True) + EXTRA_VOTES)
        if of < 0:
            table[v] = np.log(alone)[:, None, :]
        else:
            both = cells[:, of, :, v, :] + EXTRA_VOTES * alone[:, None, :]
            table[v] = np.log(both / both.sum(2, keepdims=True))
    sizes = np.array([cells[c, 0, range(3), 0, range(3)].sum() for c in (0, 1)])
    return LabelModel(float(np.clip(sizes[1] / max(sizes.sum(), 1e-9), 1e-4, 1 - 1e-4)), parent, table)


def information(pairs: np.ndarray) -> np.ndarray:
    """What each two voters tell of each other, in nats, from one class's ``pair_counts``; on the diagonal, what a voter tells at all."""
    n = pairs.shape[0] // 3
    cells = pairs.reshape(n, 3, n, 3)
    own = np.stack([cells[v, range(3), v, range(3)] for v in range(n)]) / max(cells[0, range(3), 0, range(3)].sum(), 1e-9)
    both, apart = cells / max(cells[0, range(3), 0, range(3)].sum(), 1e-9), own[:, :, None, None] * own[None, None]
    return np.where(both > 0, both * np.log(np.maximum(both, 1e-300) / np.maximum(apart, 1e-300)), 0).sum((1, 3))


def dependences(pairs: np.ndarray) -> np.ndarray:
    """The parent of each voter: the tree of most information that voters have about each other within the classes."""
    n, size = pairs.shape[1] // 3, [pairs[c, :3, :3].sum() for c in (0, 1)]
    told = sum(information(pairs[c]) * size[c] for c in (0, 1)) / max(sum(size), 1e-9)
    parent, inside, best, to = np.full(n, -1), np.zeros(n, bool), np.zeros(n), np.full(n, -1)
    for _ in range(n):
        v = int(np.argmax(np.where(inside, -1, best)))
        parent[v], inside[v] = to[v] if best[v] > LEAST_INFORMATION else -1, True
        closer = ~inside & (told[v] > best)
        best[closer], to[closer] = told[v][closer], v
    return parent


def fit_label_model(counted: Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray], correlated: bool = True) -> LabelModel:
    """Expectation maximisation from the majority: first with voters apart, then along the tree of their dependences.

    ``counted(share)``: the ``pair_counts`` of all texts, ``share`` giving what part of a text with such votes is of class 1.
    """
    pairs = counted(majority)
    for tree in (False, True)[: 1 + correlated]:
        parent = dependences(pairs) if tree else np.full(pairs.shape[1] // 3, -1)
        model = _fitted(pairs, parent)
        for _ in range(EM_ROUNDS):
            before, pairs = model, counted(model.posterior)
            model = _fitted(pairs, parent)
            if np.abs(np.exp(model.table) - np.exp(before.table)).max() < 1e-3 and abs(model.prior - before.prior) < 1e-5:
                break
    return model


def turned(model: LabelModel) -> LabelModel:
    """The same model with the classes' names changed."""
    return LabelModel(1 - model.prior, model.parent, model.table[:, ::-1])


@dataclass
class Classifier:
    """A bias and a weight of each term."""

    number: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, found: set[str]) -> float:
        total = self.bias + sum(float(self.weights[self.number[t]]) for t in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def fit_classifier(rows: list[list[int]], target: np.ndarray, weight: np.ndarray, terms: int, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Logistic regression with soft targets, from zero, by gradient steps scaled by their spread. ``rows``: the terms of each text."""
    lengths = np.array([len(r) for r in rows], np.int64)
    column, row = np.fromiter((c for r in rows for c in r), np.int64, int(lengths.sum())), np.repeat(np.arange(len(rows)), lengths)
    share = weight / max(weight.sum(), 1e-9)
    w, bias = np.zeros(terms), 0.0
    first, second = np.zeros(terms + 1), np.zeros(terms + 1)
    for k in range(1, (FIT_ROUNDS if len(rows) else 0) + 1):
        said = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[column], len(rows)), -30, 30)))
        slope = share * (said - target)
        full = np.append(np.bincount(column, slope[row], terms) + ridge * w, slope.sum())
        first, second = 0.9 * first + 0.1 * full, 0.99 * second + 0.01 * full**2
        step = 0.05 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
        w, bias = w - step[:-1], bias - float(step[-1])
    return w, bias


def _voted(docs: DataFrame, lists: dict[str, int], *kept: str) -> DataFrame:
    """(kept columns, toxic, clean): the votes on each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(lists)
        for batch in common.slices(batches, "text"):
            said = [votes(t or "", known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([v[k] for v in said], pa.int64()) for k in (0, 1))], [*kept, "toxic_votes", "clean_votes"])

    return docs.select(*kept, "text").mapInArrow(run, docs.select(*kept, F.lit(0).cast("long").alias("toxic_votes"), F.lit(0).cast("long").alias("clean_votes")).schema)


def _counter(patterns: DataFrame) -> Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray]:
    """``fit_label_model``'s counts from (toxic_votes, clean_votes, n): each task adds up its own, of a fixed size."""

    def counted(share: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 3 * len(VOTERS), 3 * len(VOTERS)))
            for batch in batches:
                for start in range(0, batch.num_rows, 8192):
                    part = batch.slice(start, 8192)
                    vote = unpacked(part.column("toxic_votes").to_numpy(), part.column("clean_votes").to_numpy())
                    total += pair_counts(vote, part.column("n").to_numpy().astype(float), share(vote))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        sums = patterns.mapInArrow(run, "sums binary").collect()  # one row of a fixed size a task
        return sum(np.frombuffer(r.sums).reshape(2, 3 * len(VOTERS), -1) for r in sums)

    return counted


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, label_model: Callable[[LabelModel], Callable[[np.ndarray], np.ndarray]] = lambda model: model.posterior) -> Classifier:
    """A classifier of texts. Labels are read from training rows only, and of those, from the sample.

    Votes are counted over all training documents. Of rows that repeat a sampled id, one is taken into the sample, that
    of the smallest text hash. Without labels of both classes, every score is the share of toxic labels (a half if
    there are none). ``label_model`` gives the function from votes to targets, for tests.
    """
    chosen = common.settle(label_sample(labels, sample_rows, id, label))
    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    met = own.join(F.broadcast(chosen), "doc_id")  # 2 * SAMPLE_ROWS rows of numbers at most
    gold = common.settle(met.groupBy("doc_id", "toxic", "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")))
    share = gold.agg(F.sum(F.col("toxic") * F.col("weight")) / F.sum("weight"), F.min("toxic"), F.max("toxic")).first()
    if share[1] == share[2]:
        share = 0.5 if share[0] is None else float(share[0])
        return Classifier({}, np.zeros(0), float(np.log((share + 1e-3) / (1 - share + 1e-3))))

    lists = find_voters(gold)
    voted = common.settle(_voted(own.where(is_training("doc_id")), lists, "doc_id"))
    patterns = common.settle(voted.groupBy("toxic_votes", "clean_votes").agg(F.count(F.lit(1)).alias("n")))
    # Each round reads them again, so they lie in as many parts as their number asks for, not as many as the texts did.
    patterns = common.settle(patterns.repartition(-(-patterns.count() // PATTERN_ROWS) or 1))
    model = fit_label_model(_counter(patterns))
    known = _voted(gold, lists, "toxic", "weight").toPandas()  # bounded as the sample is
    said = model.posterior(unpacked(known.toxic_votes.to_numpy(), known.clean_votes.to_numpy()))
    if np.cov(said, known.toxic, aweights=known.weight)[0, 1] < 0:
        model = turned(model)
    target = label_model(model)

    likely = _with_targets(voted, target).withColumn("side", F.col("target") >= 0.5)
    rows = common.settle(_sample(likely, min(sample_rows, FIT_ROWS)))
    texts = own.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "target", "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # 2 * FIT_ROWS rows of numbers at most
    texts = common.settle(texts)
    telling = telling_terms(texts.select("text", F.lit(0).alias("part"), F.col("target").alias("toxic"))).where((F.abs("ratio") >= LEAST_RATIO) & (F.col("spreads") >= LEAST_SPREADS))
    number = {r.term: k for k, r in enumerate(telling.select("term").orderBy("term").collect())}  # of a bounded sample
    fitted = _term_rows(texts, number, "target", "weight").toPandas()
    weights, bias = fit_classifier([list(r) for r in fitted.terms], fitted.target.to_numpy(), fitted.weight.to_numpy(), len(number))

    checked = _term_rows(gold, number, "toxic", "weight").toPandas()
    margin = np.array([sum(weights[t] for t in r) + bias for r in checked.terms])
    scale, shift = _calibrated(margin, checked.toxic.to_numpy(float), checked.weight.to_numpy())
    return Classifier(number, scale * weights, scale * bias + shift)


def _with_targets(voted: DataFrame, target: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(doc_id, target) of (doc_id, toxic_votes, clean_votes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = target(unpacked(batch.column("toxic_votes").to_numpy(), batch.column("clean_votes").to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made)], ["doc_id", "target"])

    return voted.select("doc_id", "toxic_votes", "clean_votes").mapInArrow(run, "doc_id long, target double")


def _sample(likely: DataFrame, rows: int) -> DataFrame:
    """(doc_id, target, weight): of (doc_id, target, side), ``rows`` documents a side at most, by a hash of the id; ``weight`` makes up for the rest."""
    each = likely.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("target").alias("target"), F.max("side").alias("side"))
    parts = []
    for side in (True, False):
        of = each.where(F.col("side") == side)
        parts.append(of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).crossJoin(F.broadcast(of.agg(F.count(F.lit(1)).alias("all")))))  # one row: the count
    return parts[0].unionByName(parts[1]).select("doc_id", "target", F.greatest(F.lit(1.0), F.col("all") / rows).alias("weight"))


def _term_rows(texts: DataFrame, number: dict[str, int], *kept: str) -> DataFrame:
    """(kept columns, terms): the numbers of each text's known terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(number)
        for batch in common.slices(batches, "text"):
            rows = [sorted(number[t] for t in known.terms_of(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, pa.list_(pa.int32()))], [*kept, "terms"])

    return texts.select(*kept, "text").mapInArrow(run, texts.select(*kept, F.array().cast("array<int>").alias("terms")).schema)


def _calibrated(margin: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of margins by which the labels are likeliest, by Newton's steps; a little pull to 1 and 0. The scale stays positive."""
    a, b, share = 1.0, 0.0, weight / weight.sum()
    for _ in range(100):
        said = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        slope = np.array([(share * (said - toxic) * margin).sum() + 1e-3 * (a - 1), (share * (said - toxic)).sum() + 1e-3 * b])
        spread = share * said * (1 - said)
        bend = np.array([[(spread * margin**2).sum() + 1e-3, (spread * margin).sum()], [(spread * margin).sum(), spread.sum() + 1e-3]])
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))
        a, b = max(0.05, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def score(docs: DataFrame, classifier: Classifier, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, 0 to 1, higher if likelier toxic; null and empty texts too. No shuffle.

    A column of that name is replaced; all others, and repeated rows, stay.
    """
    columns = [c for c in docs.columns if c != name]
    schema = docs.select(*columns).withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(classifier.number)
        for batch in common.slices(batches, text):
            made = [classifier.score(known.terms_of(t) if t else set()) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(made, pa.float64())], [*columns, name])

    return docs.select(*columns).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; rows with a null id are held out."""
    scored = score(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")), fit(docs, labels, id, text, label, sample_rows))
    return scored.select("doc_id", F.coalesce(~is_training("doc_id"), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
