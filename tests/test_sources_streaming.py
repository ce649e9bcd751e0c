"""Readers, sinks and streaming twins."""

from __future__ import annotations

import json
import zipfile

import pandas as pd
from lorekeep.operators import intervals, study
from lorekeep.sources import sinks, vault
from lorekeep.streaming import reviews
from pyspark.sql import functions as F


def test_markdown_tree_and_front_matter(spark, tmp_path):
    (tmp_path / "wiki/entities").mkdir(parents=True)
    (tmp_path / "wiki/entities/ATP.md").write_text("---\ntype: entity\naliases: [ATP, 'Adenosine triphosphate']\ntags:\n  - bio\n  - bio/cell\nempty: null\n---\n# ATP\nbody\n")
    (tmp_path / "wiki/index.md").write_text("no front matter")
    pages = vault.front_matter(vault.markdown_tree(spark, str(tmp_path / "wiki")))
    got = {r.rel: r for r in pages.collect()}
    page = got["entities/ATP.md"]
    assert page.kind == "entities" and page.meta == {"type": "entity", "empty": None} and page.body == "# ATP\nbody\n"
    assert page.lists == {"aliases": ["ATP", "Adenosine triphosphate"], "tags": ["bio", "bio/cell"]}
    assert got["index.md"].kind == "" and got["index.md"].meta == {} and got["index.md"].body == "no front matter"


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"language": "en", "segments": [{"text": " hi ", "start": 0.5, "end": 2, "speaker": "A"}, {"text": "yo", "start": 3, "end": 4}]}))
    (tmp_path / "b.json").write_text("{broken")
    rows = [(r.ord, r.start, r.speaker, r.text) for r in vault.transcripts(spark, str(tmp_path)).orderBy("ord").collect()]
    assert rows == [(0, 0.5, "A", "hi"), (1, 3.0, None, "yo")]


def test_epub(spark, tmp_path):
    book = tmp_path / "b.epub"
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package><manifest><item id="c" href="cover.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="c"/><itemref idref="a"/></spine></package>')
        z.writestr("O/cover.xhtml", "<p>cover</p>")
        z.writestr("O/a.xhtml", "<h1>One &amp; two</h1><script>x</script><p>first<p>second <b>bold</b></p>")
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    rows = vault.epub_blocks(spark, str(tmp_path)).orderBy("file", "ord").collect()
    assert [(r.kind, r.text) for r in rows if r.error is None] == [("heading", "One & two"), ("paragraph", "first"), ("paragraph", "second bold")]
    assert [r.error for r in rows if r.error] == ["BadZipFile"]


def test_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-02T03:04:05Z", "s1", "ch 1", ["a", "b"]), ("2024-01-02T03:04:06Z", "s2", None, ["c"])], "at string, source_id string, label string, pages array<string>")
    sinks.append_log(rows.withColumn("at", F.col("at").cast("timestamp")), str(tmp_path / "log"))
    got = [(r.source_id, r.label, r.pages) for r in vault.ingest_log(spark, str(tmp_path / "log")).orderBy("source_id").collect()]
    assert got == [("s1", "ch 1", ["a", "b"]), ("s2", None, ["c"])]


def test_content_addressed_and_changed_only(spark):
    rows = spark.createDataFrame([("x", "png"), ("x", "png"), ("y", "jpg")], "data string, ext string")
    got = {r.file.split(".")[1]: r for r in sinks.content_addressed(rows, "data", "ext").collect()}
    assert got["png"].copies == 2 and got["png"].file[:12] == got["png"].sha256[:12] and len(got["jpg"].file) == 16
    new = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    old = spark.createDataFrame([("a", "1"), ("b", "3")], "k string, v string")
    assert [r.k for r in sinks.changed_only(new, old, "k", "v").collect()] == ["b"]


def test_stream_fold_equals_batch_fold(spark, tmp_path):
    log = [("i1", "2024-01-01 10:00:00", 1, 3), ("i1", "2024-01-05 10:00:00", 2, 1), ("i1", "2024-01-09 10:00:00", 3, 4), ("i2", "2024-01-02 10:00:00", 4, 2), ("i2", "2024-02-02 10:00:00", 5, 3)]
    schema = "item string, ts timestamp, seq long, grade int"
    all_rows = spark.createDataFrame([(a, pd.Timestamp(b).to_pydatetime(), c, d) for a, b, c, d in log], schema)
    src = str(tmp_path / "in")
    all_rows.filter("seq <= 2").coalesce(1).write.parquet(src)
    all_rows.filter("seq > 2").coalesce(1).write.mode("append").parquet(src)
    stream = reviews.fold_reviews(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.outputMode("update").format("memory").queryName("cards").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in sorted(spark.table("cards").collect(), key=lambda r: r.reps):
        last[r.item] = (round(r.stability, 9), round(r.difficulty, 9), r.reps, r.lapses, r.due_days)
    batch = study.fold(all_rows.withColumn("day", F.to_date("ts")), "item", "day", "grade", ["ts", "seq"])
    want = {r.item: (round(r.s, 9), round(r.d, 9), r.reps, r.lapses, (r.due - r.last).days) for r in batch.collect()}
    assert last == want


def test_streaming_windows_and_dedup(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "s1", "a"), ("2024-01-01 00:01:00", "s1", "a"), ("2024-01-01 00:30:00", "s2", "a")]
    df = spark.createDataFrame([(pd.Timestamp(a).to_pydatetime(), b, c) for a, b, c in rows], "at timestamp, source_id string, label string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, stream, mode in (("done", reviews.first_done(read()), "append"), ("wins", reviews.windowed_counts(read(), "at", "label"), "complete"), ("idle", reviews.idle_sessions(read(), "at", "source_id"), "complete")):
        stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("done").count() == 2
    assert sorted(r.n for r in spark.table("wins").collect()) == [1, 2]
    assert sorted(r.lines for r in spark.table("idle").collect()) == [1, 2]


def test_upsert_and_queue(spark):
    log = spark.createDataFrame([("k", 1, "a", "x"), ("k", 2, "", "y"), ("k", 3, None, "")], "k string, n int, f string, g string")
    assert tuple(study.keep_old_on_empty(log, ["k"], ["n"], ["f", "g"]).first()) == ("k", "a", "y")
    assert tuple(study.last_write(log, ["k"], ["n"], ["f", "g"]).first()) == ("k", None, "")
    items = spark.createDataFrame([(1, 0, None), (2, 1, "2024-01-01"), (3, 1, "2024-03-01"), (4, 1, None)], "id int, state int, due string").withColumn("due", F.col("due").cast("date"))
    assert [r.id for r in study.queue(items, "2024-02-01", 10).collect()] == [1, 2]
    assert {str(r.day): r.due for r in study.forecast(items, "2024-02-01", 30).collect()} == {"2024-02-01": 3, "2024-03-01": 1}


def test_intervals(spark):
    a = spark.createDataFrame([("k", 0, 10, 1), ("k", 20, 30, 2)], "k string, s long, e long, i int")
    b = spark.createDataFrame([("k", 5, 25, 7), ("k", 10, 20, 8), ("k", 100, 200, 9)], "k string, t long, u long, j int")
    for bucket in (1, 7, 1000):
        got = sorted((r.i, r.j) for r in intervals.overlap_join(a, b, ["k"], "s", "e", "t", "u", bucket).collect())
        assert got == [(1, 7), (2, 7)]
    c = intervals.coverage(a.unionByName(b.selectExpr("k", "t AS s", "u AS e", "j AS i")), ["k"], "s", "e").first()
    assert (c.covered, c.gaps, c.first, c.last) == (130, 1, 0, 200)
