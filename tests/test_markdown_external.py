"""Page rewriting, outside calls, chains."""

from __future__ import annotations

from lorekeep.functions import markdown as M
from lorekeep.operators import external, identity, study
from pyspark.sql import functions as F


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first().x


def test_zones_links_headings(spark):
    assert one(spark, "a\n> b\n\n## Sources\nc", M.quote_zone) == "> a\n> b\n>\n> c"
    assert one(spark, "[[A.b]] [[A.b#x|y]] [[Axb]]", lambda s: M.rewrite_link(s, "A.b", "N$1")) == "[[N$1]] [[N$1#x|y]] [[Axb]]"
    assert one(spark, "x\n# Old\ny # z", lambda s: M.rewrite_h1(s, F.lit("New"))) == "x\n# New\ny # z"
    assert one(spark, "no head", lambda s: M.rewrite_h1(s, F.lit("New"))) == "no head"
    assert one(spark, "---\na: 1\nb: 2\n---\nbody", lambda s: M.upsert_field(s, "a", F.lit("9"))) == "---\na: 9\nb: 2\n---\nbody"
    assert one(spark, "---\na: 1\n---\nbody", lambda s: M.upsert_field(s, "c", F.lit("3"))) == "---\na: 1\nc: 3\n---\nbody"
    assert one(spark, "body", lambda s: M.upsert_field(s, "c", F.lit("3"))) == "body"
    page = "<!-- human-zone -->\n<!-- /human-zone -->\nend"
    once = one(spark, page, lambda s: M.promote(s, F.lit("7"), F.lit("hi")))
    assert once == "<!-- human-zone -->\n<!-- note:7 -->\nhi\n<!-- /human-zone -->\nend"
    assert one(spark, once, lambda s: M.promote(s, F.lit("7"), F.lit("hi"))) == once


def test_rendering_and_frames(spark):
    assert one(spark, "![[a.png|x]] [[p|q]] [[r]] [src:s#1] ==m== <", M.render_inline) == '<img src="a.png"> <a href="p">q</a> <a href="r">r</a> <cite data-src="s#1"></cite> <mark>m</mark> &lt;'
    assert one(spark, "a b/ü#c.png", M.asset_url) == "a%20b/%C3%BC%23c.png"
    frames = one(spark, "event: log\ndata: a\ndata: b\n\ndata: c\n\n: ping\n\n", M.event_frames)
    assert [(f.event, f.data) for f in frames] == [("log", "a\nb"), ("message", "c")]
    assert one(spark, "# c\nexport A='1'\nB=x=y\n", M.environment) == {"A": "1", "B": "x=y"}
    assert one(spark, "abcdef", lambda s: M.capped(s, 3)).startswith("abc\n[…truncated")
    assert one(spark, 'noise {bad {"b": 1, "a": [2]} tail', M.salvage_json) == '{"a":[2],"b":1}'
    assert one(spark, "none", M.salvage_json) is None and one(spark, '{"b":1, "a":2}', M.canonical_json) == '{"a":2,"b":1}'


def test_cached_calls(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "boom"), (4, "y")], "id int, p string")

    def service(prompt):
        if prompt == "boom":
            raise RuntimeError
        return "" if prompt == "y" else prompt.upper()

    out, cache = external.cached_calls(df, ["p"], service, fallback=lambda p: "F" if p == "y" else "")
    got = {r.id: (r.answer, r.error) for r in out.collect()}
    assert got == {1: ("X", None), 2: ("X", None), 3: (None, "invalid"), 4: ("F", None)}
    again, more = external.cached_calls(df, ["p"], lambda p: "new", cache=cache)
    assert {r.id: r.answer for r in again.collect()} == {1: "X", 2: "X", 3: "new", 4: "F"} and more.count() == 3


def test_chains_and_resets(spark):
    rows = [("a", "1", None), ("a", "2", "1"), ("b", "3", None), ("b", "4", None), ("c", "5", "99"), ("d", "6", "7"), ("d", "7", "6")]
    df = spark.createDataFrame(rows, "k string, id string, sup string")
    assert {r.k: r.verdict for r in identity.chain_verdicts(df, "id", "sup", "k").collect()} == {"a": "ok", "b": "ambiguous", "c": "dangling", "d": "cycle"}
    old = spark.createDataFrame([("s", "x"), ("s", "y")], "section string, tag string")
    new = spark.createDataFrame([("s", "x"), ("s", "z")], "section string, tag string")
    assert {(r.tag, r.verdict) for r in identity.append_only(old, new, "section", "tag").collect()} == {("y", "removed"), ("z", "added")}
    items = spark.createDataFrame([(1, 5.0, 3.0, 1, 4, 1)], "id int, s double, d double, state int, reps int, lapses int").withColumn("due", F.current_date())
    items = items.withColumn("last", F.lit(None).cast("date"))
    new, known, learning = (study.reset(items, x).first() for x in ("new", "known", "learning"))
    assert (new.state, new.s, new.reps, new.due, new.last, new.status) == (0, 0.0, 0, items.first().due, None, "new")
    assert (known.s, known.state, known.due, known.status) == (5.0, 1, None, "known") and known.last == items.first().due
    assert (learning.s, learning.state, learning.due, learning.last, learning.status) == (5.0, 1, items.first().due, None, "learning")


def test_forgotten_items_are_due_the_same_day(spark):
    log = [("a", "2024-01-01", 4), ("a", "2024-02-20", 1), ("b", "2024-01-01", 1), ("c", "2024-01-01", 4), ("c", "2024-02-20", 4), ("d", "2024-01-01", 0)]
    got = {r.k: r for r in study.fold(spark.createDataFrame(log, "k string, day string, g int"), "k", "day", "g", ["day"]).collect()}
    assert [str(got[k].due) for k in "abd"] == ["2024-02-20", "2024-01-01", "2024-01-01"] and all(got[k].status == "learning" for k in "abd")
    assert (got["c"].due - got["c"].last).days >= 21 and got["c"].status == "known" and got["a"].lapses == 1
