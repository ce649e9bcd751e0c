"""Study queries; ``events`` is the review log: user_id the item, event_type the grade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segment, study
from .registry import query, table

_TODAY = "2024-02-01"
_W = study.WEIGHTS


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 3).otherwise(4)
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.to_date("ts").alias("day"), grade.alias("grade"))


_D0 = f"greatest(1.0, least(10.0, CAST({_W[4]} AS DOUBLE) - (g - 3) * CAST({_W[5]} AS DOUBLE)))"
_D1 = f"greatest(1.0, least(10.0, CAST({_W[7]} AS DOUBLE) * CAST({_W[4] - _W[5]!r} AS DOUBLE) + (1 - CAST({_W[7]} AS DOUBLE)) * (c.d - CAST({_W[6]} AS DOUBLE) * (g - 3))))"
_R = f"pow(1 + CAST({study.FACTOR!r} AS DOUBLE) * greatest(date_diff('day', c.last, l.day), 0) / c.s, -0.5)"
_S_FORGOT = f"least(CAST({_W[11]} AS DOUBLE) * pow({_D1}, -CAST({_W[12]} AS DOUBLE)) * (pow(c.s + 1, CAST({_W[13]} AS DOUBLE)) - 1) * exp((1 - {_R}) * CAST({_W[14]} AS DOUBLE)), c.s)"
_S_KNEW = f"""c.s * (1 + exp(CAST({_W[8]} AS DOUBLE)) * (11 - {_D1}) * pow(c.s, -CAST({_W[9]} AS DOUBLE)) * (exp((1 - {_R}) * CAST({_W[10]} AS DOUBLE)) - 1)
  * CASE WHEN g = 2 THEN CAST({_W[15]} AS DOUBLE) ELSE 1.0 END * CASE WHEN g = 4 THEN CAST({_W[16]} AS DOUBLE) ELSE 1.0 END)"""
_SQL_FOLD = f"""
l AS MATERIALIZED (SELECT user_id, CAST(ts AS DATE) AS day, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS g,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, CAST(CASE g WHEN 1 THEN {_W[0]} WHEN 2 THEN {_W[1]} WHEN 3 THEN {_W[2]} ELSE {_W[3]} END AS DOUBLE) AS s, CAST({_D0} AS DOUBLE) AS d, 1 AS reps, 0 AS lapses, day AS last, g AS lg FROM l WHERE n = 1
  UNION ALL SELECT c.user_id, l.n, CAST(greatest(CASE WHEN g = 1 THEN {_S_FORGOT} ELSE {_S_KNEW} END, 0.1) AS DOUBLE), CAST({_D1} AS DOUBLE), c.reps + 1, c.lapses + CASE WHEN g = 1 THEN 1 ELSE 0 END, l.day, l.g
  FROM f c JOIN l ON l.user_id = c.user_id AND l.n = c.n + 1),
z AS (SELECT *, last + CASE WHEN lg = 1 THEN 0 ELSE CAST(greatest(1, least(3650, round_even(s / {study.FACTOR!r} * (pow(0.9, -2.0) - 1), 0))) AS INTEGER) END AS due FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS rn FROM f) WHERE rn = 1)
"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.fold(_log(spark, sf_dir), "user_id", "day", "grade", ["ts", "event_id"])


@query(f"WITH RECURSIVE {_SQL_FOLD} SELECT user_id, round(s, 6) AS stability, round(d, 6) AS difficulty, reps, lapses, CAST(due AS VARCHAR) AS due, CASE WHEN due - last >= 21 THEN 'known' ELSE 'learning' END AS status FROM z")
def fsrs_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select(
        "user_id", F.round("s", 6).alias("stability"), F.round("d", 6).alias("difficulty"), "reps", "lapses", F.col("due").cast("string").alias("due"), "status"
    )


@query(f"WITH RECURSIVE {_SQL_FOLD} SELECT user_id, CAST(due AS VARCHAR) AS due FROM z WHERE due <= DATE '{_TODAY}' ORDER BY z.due, user_id LIMIT 25")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).select("user_id", "state", "due")
    return study.queue(items, _TODAY, 25).select("user_id", F.col("due").cast("string").alias("due"))


@query(f"WITH RECURSIVE {_SQL_FOLD} SELECT CAST(greatest(due, DATE '{_TODAY}') AS VARCHAR) AS day, count(*) AS due FROM z WHERE due < DATE '{_TODAY}' + 30 GROUP BY 1")
def review_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.forecast(_items(spark, sf_dir).select("due"), _TODAY, 30).select(F.col("day").cast("string").alias("day"), "due")


@query(f"""WITH RECURSIVE {_SQL_FOLD} SELECT count(*) AS items, CAST(sum(reps) AS BIGINT) AS reviews, CAST(sum(lapses) AS BIGINT) AS lapses,
  CAST(count(*) FILTER (WHERE s >= 21) AS BIGINT) AS mature, CAST(count(*) FILTER (WHERE due <= DATE '{_TODAY}') AS BIGINT) AS due FROM z""")
def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).agg(
        F.count("*").alias("items"),
        F.sum("reps").alias("reviews"),
        F.sum("lapses").alias("lapses"),
        F.count_if(F.col("s") >= 21).alias("mature"),
        F.count_if(F.col("due") <= F.lit(_TODAY).cast("date")).alias("due"),
    )


@query(f"""SELECT n, CAST(greatest(1, least(3650, round_even(s / {study.FACTOR!r} * (pow(0.9, -2.0) - 1), 0))) AS INTEGER) AS days FROM (SELECT l_linenumber * 100000 + l_orderkey AS n, CAST(l_quantity AS DOUBLE) * 1.37 AS s FROM lineitem)""")
def fsrs_interval_bankers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_quantity").cast("double") * 1.37
    return table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 100000 + F.col("l_orderkey")).alias("n"), study.interval(s).alias("days"))


_P = "(SELECT p_partkey, p_size * 1.7 AS s, 1 + p_size % 10 AS d, p_partkey % 60 AS t, 1 + p_partkey % 4 AS g FROM part)"


@query(f"""SELECT p_partkey, round(r, 6) AS r, round(CAST({_W[11]} AS DOUBLE) * pow(d, -CAST({_W[12]} AS DOUBLE)) * (pow(s + 1, CAST({_W[13]} AS DOUBLE)) - 1) * exp((1 - r) * CAST({_W[14]} AS DOUBLE)), 6) AS forgotten,
  round(s * (1 + exp(CAST({_W[8]} AS DOUBLE)) * (11 - d) * pow(s, -CAST({_W[9]} AS DOUBLE)) * (exp((1 - r) * CAST({_W[10]} AS DOUBLE)) - 1) * CASE g WHEN 2 THEN CAST({_W[15]} AS DOUBLE) WHEN 4 THEN CAST({_W[16]} AS DOUBLE) ELSE 1.0 END), 6) AS recalled,
  round({_D0}, 6) AS first_difficulty
FROM (SELECT *, pow(1 + CAST({study.FACTOR!r} AS DOUBLE) * t / s, -0.5) AS r FROM {_P})""")
def fsrs_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    grid = part.select("p_partkey", (size * 1.7).alias("s"), (1 + size % 10).alias("d"), (key % 60).alias("t"), (1 + key % 4).alias("g"))
    grid = grid.withColumn("r", study.retrievability(F.col("t"), F.col("s")))
    s, d, r, g = (F.col(x) for x in "sdrg")
    return grid.select(
        "p_partkey",
        F.round("r", 6).alias("r"),
        F.round(study.stability_forgotten(d, s, r), 6).alias("forgotten"),
        F.round(study.stability_recalled(d, s, r, g), 6).alias("recalled"),
        F.round(study.first_difficulty(g), 6).alias("first_difficulty"),
    )


@query("""
WITH l AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS gloss, CASE WHEN value < 20 THEN '' ELSE CAST(event_id AS VARCHAR) END AS note FROM events)
SELECT user_id, max_by(nullif(gloss, ''), (ts, event_id)) FILTER (WHERE gloss <> '') AS gloss, max_by(nullif(note, ''), (ts, event_id)) FILTER (WHERE note <> '') AS note FROM l GROUP BY 1
""")
def vocab_upsert_keep_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id",
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("gloss"),
        F.when(F.col("value") < 20, "").otherwise(F.col("event_id").cast("string")).alias("note"),
    )
    return study.keep_old_on_empty(log, ["user_id"], ["ts", "event_id"], ["gloss", "note"])


@query("""
SELECT h, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM (SELECT sha256(CAST(user_id AS VARCHAR) || chr(31) || event_type) AS h, * FROM events) GROUP BY 1
""")
def translation_cache_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha2(F.concat(F.col("user_id").cast("string"), F.lit("\x1f"), F.col("event_type")), 256)
    log = table(spark, sf_dir, "events").select(key.alias("h"), "ts", "event_id", "value")
    return study.last_write(log.withColumn("id", F.col("event_id")), ["h"], ["ts", "event_id"], ["id", "value"]).withColumnRenamed("id", "event_id")


@query("""
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, n - back + 1 AS seq, greatest(n - 20, 0) AS dropped FROM n WHERE back <= 20
""")
def job_tail_with_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty lines of each job, their sequence numbers and how many were dropped."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    sizes = events.groupBy("user_id").agg(F.count("*").alias("n"))
    last = segment.top_per_group(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20, rank="back")
    return last.join(sizes, "user_id").select("user_id", "event_id", (F.col("n") - F.col("back") + 1).alias("seq"), F.greatest(F.col("n") - 20, F.lit(0)).alias("dropped"))


@query("""
WITH g AS (SELECT user_id, event_id, ts, event_type, lag(ts) OVER w AS pt, lag(event_type) OVER w AS pe FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CASE WHEN pt IS NULL THEN 0 WHEN event_type <> pe OR epoch(ts) - epoch(pt) > 7200 THEN 1 ELSE 0 END AS cut FROM g)
SELECT user_id, event_id, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM b
""")
def paragraph_break_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of one speaker without a long pause."""
    from ..operators import intervals

    return intervals.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "ts", "event_type", 7200).select("user_id", "event_id", F.col("island").cast("long").alias("island"))


@query("""SELECT user_id, event_type, min(ts) AS first_ts, row_number() OVER (PARTITION BY user_id ORDER BY min(ts), event_type) AS place FROM events GROUP BY 1, 2""")
def label_first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"))
    return segment.top_per_group(firsts, ["user_id"], [F.asc("first_ts"), F.asc("event_type")], 1 << 30, rank="place")


@query("""
WITH o AS (SELECT o_custkey, count(*) AS total, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS reviewed, max(CAST(o_orderdate AS DATE)) AS due FROM orders GROUP BY 1)
SELECT o_custkey, reviewed, total, CAST(floor(100e0 * reviewed / total + 0.5) AS BIGINT) AS percent, CAST(greatest(datediff('day', DATE '1998-01-01', due), 0) AS INTEGER) AS due_in FROM o
""")
def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of each session is done and in how many days its last item is due."""
    done = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    sessions = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(done.alias("reviewed"), F.count("*").alias("total"), F.max(F.col("o_orderdate").cast("date")).alias("due"))
    percent = study.session_percent(F.col("reviewed"), F.col("total") - F.col("reviewed"))
    return sessions.select("o_custkey", "reviewed", "total", percent.alias("percent"), study.due_in(F.col("due"), F.lit("1998-01-01").cast("date")).alias("due_in"))
