"""Keyed merges, sets, chains, boxes and rankings over the star-schema tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import boxes, identity, quality, segment
from .registry import query, table


@query("SELECT o_orderkey, o_custkey, CAST(o_orderdate AS VARCHAR) AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def dashboard_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5)
    return orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("string").alias("day"))


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS cited_by, CAST(count(*) AS BIGINT) AS citations FROM lineitem GROUP BY 1")
def cited_by_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("cited_by"), F.count("*").alias("citations"))


@query("SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")).filter("n > 1")


@query("""
SELECT l_partkey, count(*) AS refs, max(l_quantity) AS importance, min(l_orderkey) AS first_order FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY 1
""")
def missing_entity_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that are referred to and have no page, with what a new page needs."""
    known = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    refs = quality.orphans(table(spark, sf_dir, "lineitem"), known, "l_partkey")
    return refs.groupBy("l_partkey").agg(F.count("*").alias("refs"), F.max("l_quantity").alias("importance"), F.min("l_orderkey").alias("first_order"))


@query("""SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS refs, min_by(p_name, p_partkey) AS caption FROM part GROUP BY 1""")
def origin_ref_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one content merged: sorted distinct references, the first caption."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), "|").alias("refs"), F.min_by("p_name", "p_partkey").alias("caption"))


@query("""
WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT k, 'both' AS side FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'left' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'right' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)
""")
def set_ops_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "left")).unionByName(side(b.subtract(a), "right"))


@query("""
SELECT c_nationkey, c_mktsegment, c_custkey, lag(c_custkey) OVER w AS supersedes, lead(c_custkey) OVER w IS NULL AS head FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey)
""")
def supersession_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.supersession_heads(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", "c_custkey")


@query("""
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'sha' WHEN p_retailprice > 1200 THEN 'url' WHEN p_brand LIKE '%1' THEN 'name' ELSE 'none' END AS basis,
  CASE WHEN p_size > 40 THEN sha256(p_name) WHEN p_retailprice > 1200 THEN p_type WHEN p_brand LIKE '%1' THEN p_brand END AS value FROM part
""")
def identity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis, value = identity.identity_basis(
        [
            ("sha", F.when(F.col("p_size") > 40, F.sha2("p_name", 256))),
            ("url", F.when(F.col("p_retailprice") > 1200, F.col("p_type"))),
            ("name", F.when(F.col("p_brand").endswith("1"), F.col("p_brand"))),
        ]
    )
    return table(spark, sf_dir, "part").select("p_partkey", basis.alias("basis"), value.alias("value"))


@query("""
WITH p AS (SELECT o_orderkey, o_custkey AS k, o_orderdate AS d FROM orders),
n AS (SELECT p.o_orderkey, f.d AS after FROM p ASOF LEFT JOIN (SELECT DISTINCT k, d FROM p) f ON p.k = f.k AND f.d > p.d),
b AS (SELECT p.o_orderkey, f.d AS before FROM p ASOF LEFT JOIN (SELECT DISTINCT k, d FROM p) f ON p.k = f.k AND f.d < p.d)
SELECT o_orderkey, CAST(coalesce(after, before) AS VARCHAR) AS nearest FROM n JOIN b USING (o_orderkey)
""")
def nearest_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next order day of the same customer, else the one before: two range windows, no join."""
    day = F.unix_date(F.to_date("o_orderdate"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", day.alias("n"))
    w = Window.partitionBy("o_custkey").orderBy("n")
    after = F.min("o_orderdate").over(w.rangeBetween(1, Window.unboundedFollowing))
    before = F.max("o_orderdate").over(w.rangeBetween(Window.unboundedPreceding, -1))
    return orders.select("o_orderkey", F.coalesce(after, before).cast("string").alias("nearest"))


_BOX = "(SELECT p_partkey AS id, p_brand AS page, p_size % 30 AS x0, p_partkey % 40 AS y0, p_size % 30 + 12 AS x1, p_partkey % 40 + 9 AS y1 FROM part)"
_PAIRS = f"""
b AS {_BOX},
p AS (SELECT a.id AS a, c.id AS b, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) AS i FROM b a JOIN b c ON a.page = c.page AND a.id < c.id),
q AS (SELECT a, b, i / (216.0 - i) AS iou FROM p WHERE i / (216.0 - i) >= 0.5)
"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_brand").alias("page"), (size % 30).alias("x0"), (key % 40).alias("y0"), (size % 30 + 12).alias("x1"), (key % 40 + 9).alias("y1")
    )


@query(f"WITH {_PAIRS} SELECT a, b, round(iou, 6) AS iou FROM q")
def bbox_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes of one page that overlap well, through cells of a grid."""
    return boxes.iou_pairs(_boxes(spark, sf_dir), 0.5, 10, F.round("iou", 6))


@query(f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM q UNION ALL SELECT b, a FROM q),
r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY 1""")
def bbox_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures: connected components of the overlap graph."""
    return boxes.box_components(_boxes(spark, sf_dir), 0.5, 10)


@query("""
SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_returnflag AS rel FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey <> l_suppkey
""")
def argument_map_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ends exist, without loops and repeats."""
    nodes = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("src"))
    ends = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("dst"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("rel")).filter("src <> dst")
    return edges.join(nodes, "src", "left_semi").join(ends, "dst", "left_semi").distinct().select("src", "dst", "rel")


@query("""SELECT l_orderkey, count(*) AS members, sha256(string_agg(sha256(CAST(l_partkey AS VARCHAR)), chr(10) ORDER BY sha256(CAST(l_partkey AS VARCHAR)))) AS bundle FROM lineitem GROUP BY 1""")
def bundle_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.sha2(F.col("l_partkey").cast("string"), 256).alias("h"))
    return identity.ordered_hash(lines, ["l_orderkey"], "h", "bundle")


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY 1")
def cache_newest_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END NULLS LAST, o_orderkey) AS place FROM orders
""")
def citation_group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_totalprice"))
    w = Window.partitionBy("o_custkey").orderBy(at.asc_nulls_last(), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))


@query("""
SELECT p_brand, p_type, count(*) AS n, CASE WHEN count(DISTINCT p_size) = 1 THEN min(p_size) END AS only_size, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS only_id FROM part GROUP BY 1, 2
""")
def sha_to_id_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups that answer only where the answer is unique."""
    g = table(spark, sf_dir, "part").groupBy("p_brand", "p_type")
    return g.agg(
        F.count("*").alias("n"),
        F.when(F.countDistinct("p_size") == 1, F.min("p_size")).alias("only_size"),
        F.when(F.count("*") == 1, F.min("p_partkey")).alias("only_id"),
    )


@query("""
SELECT s_nationkey, s_suppkey, round(100 * cos(2 * pi() * (i - 1) / n), 1) + 0.0 AS x, round(100 * sin(2 * pi() * (i - 1) / n), 1) + 0.0 AS y FROM
  (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
""")
def ring_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours on a ring, evenly spaced."""
    w = Window.partitionBy("s_nationkey")
    i, n = F.row_number().over(w.orderBy("s_suppkey")), F.count("*").over(w)
    at = table(spark, sf_dir, "supplier").withColumn("t", 2 * math.pi * (i - 1) / n)
    return at.select("s_nationkey", "s_suppkey", (F.round(100 * F.cos("t"), 1) + 0.0).alias("x"), (F.round(100 * F.sin("t"), 1) + 0.0).alias("y"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER w - l_quantity AS DOUBLE) AS start, CAST(sum(l_quantity) OVER w AS DOUBLE) AS stop FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def running_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum("l_quantity").over(w)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (stop - F.col("l_quantity")).cast("double").alias("start"), stop.cast("double").alias("stop"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'known' WHEN o_orderpriority LIKE '5%' THEN 'new' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '5%' THEN 0 ELSE CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END END AS state FROM orders
""")
def patch_status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch whose status also moves the review state."""
    first = F.substring("o_orderpriority", 1, 1)
    patched = F.when(first == "1", "known").when(first == "5", "new").otherwise(F.col("o_orderstatus"))
    state = F.when(first == "1", 1).when(first == "5", 0).otherwise((F.col("o_orderstatus") == "F").cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", patched.alias("status"), state.alias("state"))


@query("""
SELECT o_custkey, o_orderstatus AS kind, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_key, count(*) AS writes FROM orders GROUP BY 1, 2
""")
def link_merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("kind")).agg(F.max_by("o_orderkey", place).alias("last_key"), F.count("*").alias("writes"))


@query("SELECT user_id, max_by(value, (ts, event_id)) AS position, CAST(epoch_us(max(ts)) AS BIGINT) AS at FROM events GROUP BY 1")
def reading_progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.max("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("position"), at.alias("at"))


@query("""SELECT p_partkey AS id, p_brand AS kind, '"' || replace(p_name, '"', '""') || '",' || p_brand || ',' || p_size AS line FROM part""")
def wordbank_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit('"'), F.replace("p_name", F.lit('"'), F.lit('""')), F.lit('"'))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.concat_ws(",", quoted, "p_brand", F.col("p_size").cast("string")).alias("line"))


@query("SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events")
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-stream frames of a log."""
    frame = F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\nevent: "), "event_type", F.lit("\ndata: "), "props", F.lit("\n\n"))
    return table(spark, sf_dir, "events").select("event_id", frame.alias("frame"))


@query("SELECT p_partkey, sha256(p_name || chr(31) || p_size) = sha256(p_name || chr(31) || (p_size - p_size % 2)) AS reusable FROM part")
def reuse_hash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda n: F.sha2(F.concat("p_name", F.lit("\x1f"), n.cast("string")), 256)
    return table(spark, sf_dir, "part").select("p_partkey", (key(F.col("p_size")) == key(F.col("p_size") - F.col("p_size") % 2)).alias("reusable"))


@query("""
SELECT s.s_suppkey, CASE WHEN n.n_name IS NOT NULL THEN n.n_name ELSE r.r_name END AS home, CASE WHEN n.n_name IS NOT NULL THEN 'exact' WHEN r.r_name IS NOT NULL THEN 'alias' ELSE 'none' END AS how
FROM supplier s LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s_nationkey = n_nationkey LEFT JOIN region r ON s_nationkey % 7 = r_regionkey
""")
def type_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match first, else the alias."""
    exact = table(spark, sf_dir, "nation").filter("n_regionkey < 3")
    joined = table(spark, sf_dir, "supplier").join(exact, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(
        table(spark, sf_dir, "region"), F.col("s_nationkey") % 7 == F.col("r_regionkey"), "left"
    )
    how = F.when(F.col("n_name").isNotNull(), "exact").when(F.col("r_name").isNotNull(), "alias").otherwise("none")
    return joined.select("s_suppkey", F.coalesce("n_name", "r_name").alias("home"), how.alias("how"))


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem WHERE l_returnflag <> 'N'),
b AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS i FROM lineitem WHERE l_returnflag = 'N')
SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM a LEFT JOIN b USING (l_orderkey, i)
""")
def ordinal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two lists paired by their place."""
    lines = table(spark, sf_dir, "lineitem")
    place = lambda *order: F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("i")
    a = lines.filter("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", place("l_linenumber", "l_partkey"))
    b = lines.filter("l_returnflag = 'N'").select("l_orderkey", "l_partkey", place("l_partkey", "l_linenumber"))
    return a.join(b, ["l_orderkey", "i"], "left").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3
""")
def top_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return segment.top_per_group(rows, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("double").alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )


@query("""
WITH l AS (SELECT source, max(doc_id) AS asset FROM documents WHERE source <> '' GROUP BY 1)
SELECT l.source, l.asset, split_part(coalesce(text, ''), chr(10), 1) AS title, sha256(coalesce(text, '')) AS sha FROM l JOIN documents d ON d.doc_id = l.asset
""")
def source_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, asset and content hash of each source; the last row of an id wins."""
    text = F.coalesce("text", F.lit(""))
    columns = {"asset": F.col("doc_id"), "title": F.substring_index(text, "\n", 1), "sha": F.sha2(text, 256)}
    return identity.catalogue(table(spark, sf_dir, "documents"), "source", F.col("doc_id"), columns)
