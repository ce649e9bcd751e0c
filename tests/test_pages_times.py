"""Page ids, names, timed characters, session figures, catalogues."""

from __future__ import annotations

from lorekeep.functions import markdown as M
from lorekeep.functions import unicode as U
from lorekeep.operators import identity, scanners, study
from pyspark.sql import functions as F


def test_page_ids(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    a, b = (one(M.page_id(F.lit("n/a.md"), F.lit(t))) for t in (1_700_000_000_000, 1_700_000_000_001))
    assert len(a) == 26 and a < b and a == one(M.page_id(F.lit("n/a.md"), F.lit(1_700_000_000_000))) and set(a) <= set(M.BASE32)
    assert one(M.page_id(F.lit("x"), F.lit(0))).startswith("0" * 10) and one(M.base32(F.lit(33), 2)) == "11"
    put = lambda s: one(M.assign_page_id(F.lit(s), F.lit("ID")))
    assert put("---\ntype: x\na: 1\n---\nbody\n") == "---\ntype: x\npage_id: ID\na: 1\n---\nbody\n"
    assert put("---\na: 1\ntype: x\ntype: y\n---\n") == "---\na: 1\ntype: x\npage_id: ID\ntype: y\n---\n"
    assert put("---\na: 1\n---") == "---\na: 1\npage_id: ID\n---\n"
    for same in ("---\npage_id: P\n---\nb", "no front matter", ""):
        assert put(same) == same
    assert one(M.assign_page_id(F.lit(None).cast("string"), F.lit("ID"))) is None


def test_squeezed_name(spark):
    rows = spark.createDataFrame([(" Ａ　 Straße\n",), (None,), ("",)], "s string")
    assert [r.x for r in rows.select(U.squeezed_name("s").alias("x")).collect()] == ["a strasse", None, ""]


def test_character_times(spark):
    words = [("He y", 0.0, 1.0), ("you", 1.0, 2.0)]
    assert scanners.character_times("Hey, you", 0.0, 5.0, words) == [
        ("H", 0.0, 1.0), ("e", 0.0, 1.0), ("y", 0.0, 1.0), (",", 1.0, 1.0), ("y", 1.0, 2.0), ("o", 1.0, 2.0), ("u", 1.0, 2.0)]
    assert scanners.character_times("a b", 1.0, 2.0, []) == [("a", 1.0, 2.0), ("b", 1.0, 2.0)]
    assert scanners.character_times("z", 0.0, 9.0, [("abcz", 3.0, 4.0)]) == [("z", 0.0, 0.0)]  # beyond the look ahead
    schema = "k long, text string, start double, end double, words array<struct<word:string,start:double,end:double>>"
    rows = [(1, "ab", 1.0, 3.0, [("a", None, 2.0), ("b", None, None)]), (2, None, 0.0, 1.0, None), (3, "c", None, None, None)]
    got = scanners.timed_characters(spark.createDataFrame(rows, schema), "k").orderBy("k", "place").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a", 1.0, 2.0), (1, 1, "b", 2.0, 2.0), (3, 0, "c", 0.0, 0.0)]


def test_sentence_times(spark):
    spoken = [(ch, float(i), i + 1.0) for i, ch in enumerate("今日は晴れです明日は雨です")]
    sentences = ["今日は 晴れです。", "まったく違う文", "明日は雨です"]
    want = [(0.0, 7.0), None, (7.0, 13.0)]
    assert scanners.greedy_times(sentences, spoken) == want and scanners.block_times(sentences, spoken) == want
    assert scanners.greedy_times(["", "x"], []) == [None, None] == scanners.block_times(["", "x"], [])
    far = [(ch, 0.0, 1.0) for ch in "-" * 40 + "ab"]
    assert scanners.greedy_times(["ab"], far) == [None] and scanners.block_times(["ab"], far) == [(0.0, 1.0)]
    left = spark.createDataFrame([(1, i, t) for i, t in enumerate(sentences)] + [(2, 0, None), (3, 0, "x")], "k long, ord int, text string")
    right = spark.createDataFrame([(1, i, *c) for i, c in enumerate(spoken)] + [(2, 0, "a", 0.0, 1.0), (9, 0, "b", 0.0, 1.0)], "k long, place int, ch string, t0 double, t1 double")
    for align in (scanners.greedy_times, scanners.block_times):
        got = {(r.k, r.ord): (r.t0, r.t1) for r in scanners.time_sentences(left, right, "k", align).collect()}
        none = (None, None)
        assert got == {(1, 0): want[0], (1, 1): none, (1, 2): want[2], (2, 0): none, (3, 0): none}


def test_quote_head():
    text = "Alpha beta gamma delta epsilon"
    start, end = scanners.find_quote(text, "beta gamma delta changed")
    assert start == 6 and text[start:end].startswith("beta gamma")
    assert scanners.find_quote(text, "zeta gamma delta") is None and scanners.find_quote(text, "beta xx") is None


def test_sessions_and_catalogue(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(study.session_percent(F.lit(a), F.lit(b))) for a, b in ((0, 0), (1, 1), (1, 7), (3, 0))] == [0, 50, 13, 100]
    day = lambda s: F.lit(s).cast("date")
    assert [one(study.due_in(day(d), day("2024-01-02"))) for d in (None, "2024-01-01", "2024-01-02", "2024-01-05")] == [0, 0, 0, 3]
    assert [one(study.scroll_percent(F.lit(t), F.lit(h), F.lit(600))) for t, h in ((0, 100), (500, 1600), (9999, 1600))] == [0.0, 50.0, 100.0]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("", 3, "z"), (None, 4, "w")], "id string, n int, t string")
    assert [tuple(r) for r in identity.catalogue(rows, "id", F.col("n"), {"t": F.col("t")}).collect()] == [("a", "y")]
