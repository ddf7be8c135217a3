"""Keyword density on hand-made posts."""

from sitelumen.operators import density


def posts(spark, *rows):
    schema = "text string, focus array<string>, title string, h1 string, url string, meta_description string, subheadings array<string>, alts array<string>"
    return {i: r.density for i, r in enumerate(density.analysed(spark.createDataFrame(rows, schema)).collect())}


def test_density(spark):
    empty = ["", "", "", "", [], []]
    words = lambda n: ["word"] * n
    even = words(400)
    even[10] = even[200] = "law college"
    front = words(400)
    for i in range(7):
        front[3 * i] = "law college"
    found = posts(
        spark,
        (" ".join(even), ["law", "college"], "Law colleges", "", "https://a.b/law-college/", "", ["a law, a college"], None),
        (" ".join(front), ["law", "college"], *empty),
        (" ".join(words(80)), ["law"], *empty),
        (None, ["law"], *empty),
        ("law " * 3, None, None, None, None, None, None, None),
    )
    a, b, c, d, e = (found[i] for i in range(5))
    assert (a.words, a.mentions, a.required, a.windows, a.covered, a.verdict, a.shortfall) == (402, 2, 3, 3, 2, "fail", 1) and a.gaps == [3]
    assert a.lacking == ["h1", "meta_description", "image_alt", "last_100_words"]
    assert (b.mentions, b.covered, b.verdict, b.stuffed, b.max_in_window) == (7, 1, "pass-on-average", True, 7) and b.gaps == [2, 3]
    assert (c.verdict, c.words_per_mention, c.percent) == ("fail", None, 0.0) and c.lacking == list(density.PLACES)
    assert (d.words, d.windows, d.verdict, d.gaps, d.required) == (0, 0, "fail", [], 0) and (e.mentions, e.verdict) == (0, "fail")


def test_windows_join_short_tails(spark):
    last = lambda n: posts(spark, (" ".join(["word"] * n), ["x"], "", "", "", "", [], []))[0].windows
    assert [last(n) for n in (1, 149, 150, 224, 225, 300, 374, 375)] == [1, 1, 1, 1, 2, 2, 2, 3]


def test_edges_come_with_the_mentions_and_most_words_are_marked_unstemmed(spark, monkeypatch):
    """the words of a text are found once, and words that begin otherwise than the keyword's are not stemmed."""
    from sitelumen.functions import text as T
    from sitelumen.operators import mentions

    stemmed, stem_of = [], T.stem_of
    monkeypatch.setattr(T, "stem_of", lambda w: stemmed.append(w) or stem_of(w))
    text = "the colleges college's colleges-of law cities city citi other-things boxes of box collie"
    for focus, want in ((["college"], [1, 2, 3]), (["city"], [5, 6]), (["box"], [9, 11]), (["of", "box"], [10])):
        assert mentions.find(text, focus)[0] == want
    stemmed.clear()
    mentions.find("wholly different words " * 50, ["zebra"])
    assert stemmed == []
    row = mentions.mentions(spark.createDataFrame([("a b a c d e d", ["x"]), (None, None)], "text string, focus array<string>"), "focus", edge=3).select("mention.front", "mention.back").collect()
    assert [tuple(r) for r in row] == [("a b", "d e"), ("", "")]
