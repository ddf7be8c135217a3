"""Words, stems, tokens, shingles and similarity as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a word is (Latin letters, digits and Devanagari, with inner apostrophes and hyphens).
WORD = r"[A-Za-z0-9ऀ-ॿ]+(?:['’\-][A-Za-z0-9ऀ-ॿ]+)*"
#: Function words, and modifiers that say nothing about what a page is for.
STOP = tuple(
    "a an the and or of to in on at for from by with without into onto over under about"
    " as is are was were be been being this that these those it its your you our we us my"
    " how what why when where which who whom whose vs versus than then there here".split()
)
MARKETING = tuple("best top leading no number 1 #1 1st no1 affordable cheap expert experts guide complete ultimate official free trusted famous popular latest updated new".split())
#: Stop words of the looser tokens, which keep punctuation.
LOOSE_STOP = ("a", "an", "the", "for", "to", "of", "in", "on", "and", "or", "is", "are", "with", "your", "my")
#: Marks of a keyword's intent, and beginnings of questions.
LOCAL = ("near me", "in the us", "california", "los angeles", "usa")
TRANSACTIONAL = ("hire", "buy", "pricing", "price", "cost", "service", "services", "outsourc", "quote", "demo")
COMMERCIAL = ("best", " vs ", "review", "top ", "compare", "alternative")
QUESTION = ("how", "what", "why", "when", "which", "can", "do", "does", "is", "are", "should")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Endings of plurals by pattern, the letters that go, and what takes their place; the first that fits counts.
PLURALS = ((r"..ies$", 3, "y"), (r"(?:sses|ches|shes|xes|zes)$", 2, ""), (r"[^suiy]s$", 1, ""))
#: Fixed value: longer words have a plural.
SHORT = 3


def stem(word: Column) -> Column:
    """A plural's singular, by its ending; words of three letters or fewer stay."""
    w = F.lower(word)
    out = F.when(F.length(w) <= SHORT, w)
    for ending, n, end in PLURALS:
        out = out.when(w.rlike(ending), F.concat(F.substring(w, F.lit(1), F.length(w) - n), F.lit(end)))
    return out.otherwise(w)


def stem_of(word: str) -> str:
    """``stem`` of one lower-case word, by the same table."""
    fits = (word[:-n] + end for ending, n, end in PLURALS if re.search(ending, word))
    return word if len(word) <= SHORT else next(fits, word)


def _meaningful(text: Column, keep_years: bool, keep_numbers: bool) -> Column:
    """A phrase's lower-case words without stop and marketing words, and without numbers unless they are kept."""
    found = F.filter(F.transform(words(F.translate(text, "_-", "  ")), F.lower), lambda w: ~w.isin(*STOP, *MARKETING))
    if not keep_numbers:
        found = F.filter(found, lambda w: ~w.rlike(r"^\d+$") | (w.rlike(r"^(?:19|20)\d\d$") if keep_years else F.lit(False)))
    return found


def tokens(text: Column, keep_years: bool = False, keep_numbers: bool = False) -> Column:
    """A phrase's stems, each once, in order; without stop and marketing words, and without numbers unless they are kept."""
    return F.array_distinct(F.transform(_meaningful(text, keep_years, keep_numbers), lambda w: F.when(w.rlike(r"^\d+$"), w).otherwise(stem(w))))


def token_pairs(text: Column, keep_years: bool = False, keep_numbers: bool = False) -> Column:
    """``tokens`` as structs of stem and word: the word is the first that has the stem."""
    pair = lambda w: F.struct(F.when(w.rlike(r"^\d+$"), w).otherwise(stem(w)).alias("stem"), w.alias("word"))
    kind = "array<struct<stem:string,word:string>>"
    first = lambda found, x: F.when(F.exists(found, lambda y: y["stem"] == x["stem"]), found).otherwise(F.concat(found, F.array(x)))
    return F.aggregate(F.transform(_meaningful(text, keep_years, keep_numbers), pair), F.array().cast(kind), first)


def without_brand(text: Column, brand: str) -> Column:
    """``text`` without the brand's name and the separators about it; other uses of its words stay."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?i)\s*[|\-–—:]?\s*{re.escape(brand)}\s*[|\-–—:]?\s*", " ")) if brand else F.coalesce(text, F.lit(""))


def coverage(target: Column, text: Column) -> tuple[Column, Column]:
    """The target's tokens that ``text`` has, and those that it lacks, compared by stem."""
    have = tokens(F.coalesce(text, F.lit("")), keep_years=True)
    return F.array_intersect(target, have), F.array_except(target, have)


def loose_tokens(text: Column) -> Column:
    """Different lower-case words between white space, longer than two characters, punctuation kept."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*LOOSE_STOP)))


def plain_words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def shingles(words: Column, width: int = 5) -> Column:
    """Hashes of the different windows of ``width`` words; of fewer words, of all of them; none of no words.

    ``words`` must be a column of its table: an expression here would be evaluated again for every window.
    ``sequence`` counts down where its end lies before its beginning, so short texts have a guard.
    """
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - width + 1)), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(width)), " ")))
    return F.when(F.size(words) > 0, F.array_distinct(windows)).otherwise(F.array().cast("array<bigint>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of different things; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def intent(keyword: Column) -> Column:
    """local, transactional or commercial: the first of them that a keyword has a mark of; else informational."""
    padded = F.concat(F.lit(" "), F.lower(keyword), F.lit(" "))
    has = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(padded, m))
    return F.when(has(LOCAL), "local").when(has(TRANSACTIONAL), "transactional").when(has(COMMERCIAL), "commercial").otherwise("informational")


#: Marks of what kind of article answers a keyword.
PRICES, COMPARISONS = "cost|price|pricing|salary|rates", (" vs ", "best ")


def angle(keyword: Column) -> Column:
    """What kind of article answers a keyword."""
    k = F.lower(keyword)
    asks = F.exists(F.array(*map(F.lit, QUESTION)), lambda m: F.startswith(k, m)) | k.endswith("?")
    compares = F.concat(F.lit(" "), k, F.lit(" ")).contains(COMPARISONS[0]) | k.contains(COMPARISONS[1])
    return F.when(asks, "FAQ answer").when(compares, "comparison").when(k.rlike(PRICES), "pricing guide").otherwise("how-to guide")


def short_hash(*parts: Column, length: int = 12) -> Column:
    """The first digits of the SHA-1 of parts joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length)


def slug_bigrams(slug: Column) -> Column:
    """Pairs of neighbouring words of a slug that are longer than two letters."""
    w = F.filter(F.split(F.lower(slug), "[^a-z0-9]+"), lambda x: F.length(x) > 2)
    return F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
