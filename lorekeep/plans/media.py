"""Transcripts, time anchors and interval queries; turns of a conversation stand for segments, their length for time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import intervals, segment
from .registry import query, table


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text, start_ms, end_ms): fifteen characters a second, times in whole milliseconds."""
    turns = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ms = F.floor(F.length("text") * 1000 / 15).cast("long")
    ends = turns.withColumn("_ms", ms).withColumn("end_ms", F.sum("_ms").over(w))
    return ends.withColumn("start_ms", F.col("end_ms") - F.col("_ms")).drop("_ms")


_SQL = """
c AS (SELECT conv_id, turn, role, text, CAST(floor(length(text) * 1000 / 15) AS BIGINT) AS ms FROM conversations),
s AS (SELECT *, CAST(sum(ms) OVER w AS BIGINT) AS end_ms, CAST(sum(ms) OVER w AS BIGINT) - ms AS start_ms FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


@query(f"""WITH {_SQL}, k AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS cut FROM s),
r AS (SELECT *, sum(cut) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run FROM k)
SELECT conv_id, CAST(run AS BIGINT) AS run, role, min(turn) AS first_turn, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def reader_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive turns of one role."""
    runs = segment.runs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")
    return runs.groupBy("conv_id", F.col("run").cast("long").alias("run"), "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


@query(f"""WITH {_SQL}, w AS (SELECT *, CASE WHEN start_ms < 300000 THEN 0 WHEN start_ms % 1200000 < 120000 THEN start_ms // 1200000 ELSE -1 END AS win FROM s)
SELECT conv_id, turn, win, CAST(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM w WHERE win >= 0""")
def transcript_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five minutes, then the first two of every twenty, with the running length."""
    start = F.col("start_ms")
    win = F.when(start < 300_000, F.lit(0).cast("long")).when(start % 1_200_000 < 120_000, F.floor(start / 1_200_000)).otherwise(-1)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = _segments(spark, sf_dir).withColumn("win", win).filter("win >= 0")
    return taken.select("conv_id", "turn", "win", F.sum(F.length("text") + 1).over(w).alias("running"))


@query(f"""WITH {_SQL} SELECT conv_id, turn, '[' || a || '-' || b || '] ' || role || ': ' || trim(text) AS line FROM (SELECT *,
  CASE WHEN st >= 3600 THEN (st // 3600) || ':' ELSE '' END || printf('%02d:%02d', (st % 3600) // 60, st % 60) AS a, CASE WHEN en >= 3600 THEN (en // 3600) || ':' ELSE '' END || printf('%02d:%02d', (en % 3600) // 60, en % 60) AS b
  FROM (SELECT *, start_ms // 1000 AS st, (end_ms + 999) // 1000 AS en FROM s))""")
def render_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line a segment: start rounded down, end up."""
    from ..operators import render

    return _segments(spark, sf_dir).select("conv_id", "turn", render.transcript_line(F.col("start_ms"), F.col("end_ms"), F.col("role"), F.col("text")).alias("line"))


@query(f"""WITH {_SQL} SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(length(text)) / (sum(ms) / 1000.0), 6) AS density, sum(length(text)) / (sum(ms) / 1000.0) >= 3.0 AS enough FROM s GROUP BY 1 HAVING sum(ms) > 0""")
def coverage_density_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars, secs = F.sum(F.length("text")), F.sum(F.col("end_ms") - F.col("start_ms")) / 1000.0
    g = _segments(spark, sf_dir).groupBy("conv_id").agg(chars.alias("chars"), secs.alias("secs")).filter("secs > 0")
    rate = F.col("chars") / F.col("secs")
    return g.select("conv_id", "chars", F.round(rate, 6).alias("density"), (rate >= 3.0).alias("enough"))


@query(f"""WITH {_SQL}, v AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN start_ms - 900 ELSE start_ms END AS a, CASE WHEN turn % 11 = 5 THEN start_ms - 1 ELSE end_ms END AS b FROM s),
p AS (SELECT *, lag(a) OVER w AS pa, max(b) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN b < a THEN 'inverted' WHEN pa IS NOT NULL AND a < pa THEN 'order' WHEN a < pb THEN 'overlap' END AS code FROM p WHERE b < a OR a < pa OR a < pb""")
def segment_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    bent = _segments(spark, sf_dir).select(
        "conv_id", "turn", F.when(turn % 7 == 3, F.col("start_ms") - 900).otherwise(F.col("start_ms")).alias("a"), F.when(turn % 11 == 5, F.col("start_ms") - 1).otherwise(F.col("end_ms")).alias("b")
    )
    w = Window.partitionBy("conv_id").orderBy("turn")
    seen = bent.withColumn("pa", F.lag("a").over(w)).withColumn("pb", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    code = F.when(F.col("b") < F.col("a"), "inverted").when(F.col("a") < F.col("pa"), "order").when(F.col("a") < F.col("pb"), "overlap")
    return seen.select("conv_id", "turn", code.alias("code")).filter("code IS NOT NULL")


@query("""
WITH p AS (SELECT user_id, event_id, ts + INTERVAL 1 HOUR AS probe FROM events WHERE event_type = 'click'), f AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.user_id, p.event_id, f.event_id AS seen FROM p ASOF LEFT JOIN f ON p.user_id = f.user_id AND p.probe >= f.ts
""")
def playback_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last view of the same user at or before an hour after each click."""
    events = table(spark, sf_dir, "events")
    probes = events.filter("event_type = 'click'").select("user_id", "event_id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("probe"))
    views = events.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return intervals.as_of(probes, views, ["user_id"], "probe", "ts", F.col("view_id"), "seen").select("user_id", "event_id", "seen")


@query(f"""WITH {_SQL}, r AS (SELECT conv_id, turn AS q, start_ms + 500 AS qs, end_ms + 700 AS qe FROM s WHERE turn % 2 = 0)
SELECT r.conv_id, r.q, count(s.turn) AS hits, CAST(sum(least(qe, end_ms) - greatest(qs, start_ms)) AS BIGINT) AS shared FROM r JOIN s ON r.conv_id = s.conv_id AND r.qs < s.end_ms AND s.start_ms < r.qe GROUP BY 1, 2""")
def interval_overlap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that each cited range touches and for how long."""
    segs = _segments(spark, sf_dir).select("conv_id", "turn", "start_ms", "end_ms")
    asked = segs.filter("turn % 2 = 0").select("conv_id", F.col("turn").alias("q"), (F.col("start_ms") + 500).alias("qs"), (F.col("end_ms") + 700).alias("qe"))
    both = intervals.overlap_join(asked, segs, ["conv_id"], "qs", "qe", "start_ms", "end_ms", 30_000)
    shared = F.least("qe", "end_ms") - F.greatest("qs", "start_ms")
    return both.groupBy("conv_id", "q").agg(F.count("*").alias("hits"), F.sum(shared).alias("shared"))


@query("""
WITH s AS (SELECT o_custkey AS k, o_orderkey, epoch(o_orderdate)::BIGINT // 86400 AS a, epoch(o_orderdate)::BIGINT // 86400 + 1 + o_orderkey % 90 AS b FROM orders),
m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT k, CAST(sum(greatest(b - greatest(a, coalesce(reach, a)), 0)) AS BIGINT) AS covered, CAST(count(*) FILTER (WHERE a > reach) AS BIGINT) AS gaps, min(a) AS first, max(b) AS last FROM m GROUP BY 1
""")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that each customer's order periods cover together, and the holes between."""
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), day.alias("a"), (day + 1 + F.col("o_orderkey") % 90).alias("b"))
    return intervals.coverage(spans, ["k"], "a", "b")


@query(f"""WITH {_SQL}, n AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS batch, length(text) AS chars FROM s)
SELECT conv_id, batch, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM n GROUP BY 1, 2""")
def sentence_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-size batches in order."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    numbered = table(spark, sf_dir, "conversations").select("conv_id", F.floor((F.row_number().over(w) - 1) / 4).alias("batch"), F.length("text").alias("chars"))
    return numbered.groupBy("conv_id", "batch").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query(f"""WITH {_SQL}, v AS (SELECT conv_id, turn, start_ms + CASE WHEN turn % 3 = 1 THEN -5000 ELSE 0 END AS t FROM s),
m AS (SELECT *, max(t) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM v) SELECT conv_id, turn, t FROM m WHERE top IS NULL OR t > top""")
def outline_monotone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that move forward of all before them."""
    t = F.col("start_ms") + F.when(F.col("turn") % 3 == 1, -5000).otherwise(0)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    moved = _segments(spark, sf_dir).select("conv_id", "turn", t.alias("t")).withColumn("top", F.max("t").over(w))
    return moved.filter("top IS NULL OR t > top").drop("top")


@query(f"""WITH {_SQL} SELECT conv_id, count(*) AS cards, CAST(max(turn) AS BIGINT) AS last_turn, count(*) = max(turn) - min(turn) + 1 AS whole, bool_and(trim(text) <> '') AS filled, list_sort(list(DISTINCT role))[1] AS first_role FROM s GROUP BY 1""")
def evidence_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a bundle has every index between its first and last, and no empty part."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id")
    return g.agg(
        F.count("*").alias("cards"),
        F.max("turn").alias("last_turn"),
        (F.count("*") == F.max("turn") - F.min("turn") + 1).alias("whole"),
        F.bool_and(F.trim("text") != "").alias("filled"),
        F.min("role").alias("first_role"),
    )


@query("SELECT c.conv_id, c.turn, c.turn BETWEEN 1 AND n.n AS valid FROM (SELECT conv_id, turn + conv_id % 3 AS turn FROM conversations) c JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) n USING (conv_id)")
def card_anchor_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors against the number of cards of their bundle."""
    cards = table(spark, sf_dir, "conversations")
    sizes = cards.groupBy("conv_id").agg(F.count("*").alias("n"))
    cited = cards.select("conv_id", (F.col("turn") + F.col("conv_id") % 3).alias("turn"))
    return cited.join(sizes, "conv_id").select("conv_id", "turn", F.col("turn").between(1, F.col("n")).alias("valid"))


@query("SELECT n, CASE WHEN s >= 3600 THEN (s // 3600) || ':' ELSE '' END || printf('%02d:%02d', (s % 3600) // 60, s % 60) AS clock FROM (SELECT o_orderkey AS n, CAST(floor(o_totalprice / 10) AS BIGINT) AS s FROM orders)")
def clock_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), X.clock(F.col("o_totalprice") / 10).alias("clock"))
