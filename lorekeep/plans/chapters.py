"""Chapters, anchors, ranks and gates: the remaining keyed operators with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import quality, segment
from .registry import query, table

_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)"
_HEADS = f"{_LINES}, h AS (SELECT doc_id, CAST(ord AS BIGINT) AS ord, trim(line) AS label, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE length(line) < 40 AND trim(line) <> '')"


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ord, label, k, n): short lines stand for headings; k-th of n."""
    lines = segment.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    heads = lines.filter((F.length("line") < 40) & (F.trim("line") != "")).select("doc_id", F.col("ord").cast("long").alias("ord"), F.trim("line").alias("label"))
    w = Window.partitionBy("doc_id")
    return heads.withColumn("k", F.row_number().over(w.orderBy("ord"))).withColumn("n", F.count("*").over(w))


@query(f"WITH {_HEADS} SELECT doc_id, ord, label FROM h WHERE regexp_matches(label, '(?i)^(the|la|le|der|and) ')")
def section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that a pattern picks."""
    return _heads(spark, sf_dir).filter(F.col("label").rlike("(?i)^(the|la|le|der|and) ")).select("doc_id", "ord", "label")


@query(f"WITH {_HEADS} SELECT doc_id, ord, label FROM h WHERE k BETWEEN 2 AND 4")
def section_nth_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second to the fourth heading of each document."""
    return _heads(spark, sf_dir).filter(F.col("k").between(2, 4)).select("doc_id", "ord", "label")


@query(f"WITH {_HEADS} SELECT doc_id, k, coalesce(lag(label) OVER w, '') AS prev, coalesce(lead(label) OVER w, '') AS next, round(100.0 * k / n, 2) AS percent FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY ord)")
def chapter_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ord")
    return _heads(spark, sf_dir).select(
        "doc_id", "k", F.lag("label", 1, "").over(w).alias("prev"), F.lead("label", 1, "").over(w).alias("next"), F.round(100.0 * F.col("k") / F.col("n"), 2).alias("percent")
    )


@query(f"""WITH {_LINES}, o AS (SELECT doc_id, ord, 1 + (ord * 7) % 5 AS page FROM l WHERE length(line) < 40 AND trim(line) <> ''), m AS (SELECT doc_id, ord, page, lead(page) OVER (PARTITION BY doc_id ORDER BY page, ord) AS next FROM o)
SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(page AS BIGINT) AS first_page, CAST(greatest(coalesce(next, 6), page + 1) AS BIGINT) AS end_page FROM m""")
def page_range_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline entries to half-open page ranges of at least one page."""
    page = (1 + (F.col("ord") * 7) % 5).cast("long")
    heads = _heads(spark, sf_dir).select("doc_id", "ord", page.alias("page"))
    after = F.lead("page").over(Window.partitionBy("doc_id").orderBy("page", "ord"))
    return heads.select("doc_id", "ord", F.col("page").alias("first_page"), F.greatest(F.coalesce(after, F.lit(6)), F.col("page") + 1).alias("end_page"))


@query(f"""WITH {_HEADS}, q AS (SELECT doc_id, lower(substr(label, 1, 6)) AS anchor FROM h WHERE k = 2),
r AS (SELECT q.doc_id, anchor, h.ord, CASE WHEN lower(label) = anchor THEN 3 WHEN starts_with(lower(label), anchor) THEN 2 WHEN contains(lower(label), anchor) THEN 1 ELSE 0 END AS score FROM q JOIN h USING (doc_id))
SELECT doc_id, anchor, min_by(ord, (-score, ord)) AS ord, max(score) AS score FROM r GROUP BY 1, 2""")
def anchor_to_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter of an anchor: same label, then prefix, then part, else the first."""
    heads = _heads(spark, sf_dir)
    asked = heads.filter("k = 2").select("doc_id", F.lower(F.substring("label", 1, 6)).alias("anchor"))
    label = F.lower("label")
    score = F.when(label == F.col("anchor"), 3).when(label.startswith(F.col("anchor")), 2).when(label.contains(F.col("anchor")), 1).otherwise(0)
    ranked = asked.join(heads, "doc_id").select("doc_id", "anchor", "ord", score.alias("score"))
    return ranked.groupBy("doc_id", "anchor").agg(F.min_by("ord", F.struct(-F.col("score"), F.col("ord"))).alias("ord"), F.max("score").alias("score"))


@query("""SELECT p_type AS alias, max_by(p_partkey, p_partkey) AS owner, count(*) AS writers, max(p_size) > 49 AS unknown_source FROM part GROUP BY 1""")
def alias_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page written last owns an alias."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("alias")).agg(
        F.max("p_partkey").alias("owner"), F.count("*").alias("writers"), (F.max("p_size") > 49).alias("unknown_source")
    )


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), a AS (SELECT p_partkey, p_size FROM part WHERE p_size > 3)
SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN a.p_partkey IS NULL THEN 'missing' WHEN a.p_size < 6 THEN 'decorative' WHEN l_suppkey % 10 <> l_partkey % 10 THEN 'foreign' ELSE 'ok' END AS verdict FROM e LEFT JOIN a ON l_partkey = p_partkey
""")
def embed_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeds against the asset list: missing, decorative, of another owner."""
    assets = table(spark, sf_dir, "part").filter("p_size > 3").select("p_partkey", "p_size")
    rows = table(spark, sf_dir, "lineitem").join(assets, F.col("l_partkey") == F.col("p_partkey"), "left")
    verdict = (
        F.when(F.col("p_partkey").isNull(), "missing")
        .when(F.col("p_size") < 6, "decorative")
        .when(F.col("l_suppkey") % 10 != F.col("l_partkey") % 10, "foreign")
        .otherwise("ok")
    )
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", verdict.alias("verdict"))


@query("""
WITH g AS (SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) AS part FROM part), c AS (SELECT lower(p_brand) AS lemma, min(p_partkey) AS card FROM part GROUP BY 1),
k AS (SELECT DISTINCT p_partkey, part FROM g), n AS (SELECT part, min(p_partkey) AS card FROM k GROUP BY 1) SELECT p_partkey, min(n.card) AS card, count(*) AS parts FROM k JOIN n USING (part) GROUP BY 1
""")
def grammar_card_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern or any of its parts finds the card."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(F.lower("p_type"), " ")).alias("part")).distinct()
    cards = parts.groupBy("part").agg(F.min("p_partkey").alias("card"))
    return parts.join(cards, "part").groupBy("p_partkey").agg(F.min("card").alias("card"), F.count("*").alias("parts"))


@query("""
WITH t AS (SELECT doc_id, lower(regexp_extract(text, '[A-Za-z]+')) AS k FROM documents), m AS (SELECT lower(split_part(p_type, ' ', 1)) AS k, min_by(p_name, p_partkey) AS meaning FROM part GROUP BY 1 UNION ALL SELECT 'the', 'article')
SELECT doc_id, t.k AS token, meaning FROM t LEFT JOIN m USING (k)
""")
def gloss_first_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("token"))
    first = F.lower(F.substring_index("p_type", " ", 1)).alias("token")
    meanings = table(spark, sf_dir, "part").groupBy(first).agg(F.min_by("p_name", "p_partkey").alias("meaning"))
    meanings = meanings.unionByName(spark.createDataFrame([("the", "article")], "token string, meaning string"))
    return tokens.join(meanings, "token", "left").select("doc_id", "token", "meaning")


@query("""
WITH b AS (SELECT conv_id, sha256(string_agg(role, chr(10) ORDER BY turn)) AS bundle FROM conversations GROUP BY 1), d AS (SELECT bundle, min(conv_id) AS first, count(*) AS n FROM b GROUP BY 1 HAVING count(*) > 1)
SELECT conv_id, bundle, first, n FROM b JOIN d USING (bundle) WHERE conv_id <> first
""")
def bundle_duplicate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles that an earlier one equals."""
    roles = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"])
    bundles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(roles, "\n"), 256).alias("bundle"))
    firsts = bundles.groupBy("bundle").agg(F.min("conv_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return bundles.join(firsts, "bundle").filter("conv_id <> first").select("conv_id", "bundle", "first", "n")


@query("""
WITH c AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type FROM events)
SELECT user_id, min_by(event_id, (CASE WHEN event_type = 'purchase' THEN 0 WHEN event_type = 'signup' THEN 1 WHEN event_type = 'view' THEN 2 ELSE 3 END, k)) AS event_id FROM c GROUP BY 1
""")
def annotation_reanchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hit by the order of block preference, then by place."""
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(rank, F.col("ts"), F.col("event_id"))).alias("event_id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'O', 'P') THEN 'mode' WHEN o_orderstatus = 'P' AND o_orderpriority LIKE '1%' THEN 'section' WHEN o_totalprice > 400000 THEN 'limit' ELSE 'ok' END AS verdict FROM orders""")
def option_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = (
        F.when(~F.col("o_orderstatus").isin("F", "O", "P"), "mode")
        .when((F.col("o_orderstatus") == "P") & F.col("o_orderpriority").startswith("1"), "section")
        .when(F.col("o_totalprice") > 400000, "limit")
        .otherwise("ok")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", verdict.alias("verdict"))


@query("""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) AS k FROM pages),
d AS (SELECT page_id, href, min(k) AS k FROM h GROUP BY 1, 2) SELECT page_id, href, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS r FROM d) WHERE r <= 20
""")
def download_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty different links of a page; the cap is the feature."""
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("k", "href"))
    firsts = links.groupBy("page_id", "href").agg(F.min("k").alias("k"))
    return segment.top_per_group(firsts, ["page_id"], [F.asc("k")], 20, rank="place").select("page_id", "href", "place")


@query("""
WITH s AS (SELECT doc_id, quality, toxic, n_chars, source FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN quality = 1 AND toxic = 0 THEN 0 ELSE 1 END, CASE WHEN quality = 1 AND toxic = 0 THEN 0 ELSE -n_chars END, doc_id) AS place,
  count(*) FILTER (WHERE quality = 1 AND toxic = 0) OVER (PARTITION BY source) AS pinned FROM s) SELECT source, doc_id, place FROM r WHERE place <= greatest(20, pinned)
""")
def candidate_ranked_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned ones first, all of them; then by score until the cap."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    pin = (F.col("quality") == 1) & (F.col("toxic") == 0)
    w = Window.partitionBy("source")
    ranked = rows.withColumn("place", F.row_number().over(w.orderBy(F.when(pin, 0).otherwise(1), F.when(pin, 0).otherwise(-F.col("n_chars")), "doc_id")))
    sized = ranked.withColumn("pinned", F.count_if(pin).over(w))
    return sized.filter(F.col("place") <= F.greatest(F.lit(20), F.col("pinned"))).select("source", "doc_id", "place")


@query("""SELECT l_orderkey, l_linenumber, 1 + l_linenumber % 5 AS importance, (1 + l_linenumber % 5 >= 4 OR l_returnflag = 'R') AS required,
  CASE WHEN 1 + l_linenumber % 5 = 5 OR (l_returnflag = 'R' AND 1 + l_linenumber % 5 < 4) THEN 'central' WHEN 1 + l_linenumber % 5 >= 4 THEN 'major' ELSE 'minor' END AS role FROM lineitem""")
def required_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    importance, asked = 1 + F.col("l_linenumber") % 5, F.col("l_returnflag") == "R"
    role = F.when((importance == 5) | (asked & (importance < 4)), "central").when(importance >= 4, "major").otherwise("minor")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", importance.alias("importance"), ((importance >= 4) | asked).alias("required"), role.alias("role"))


@query("""SELECT p_partkey, p_size <= 2 OR (p_retailprice / p_size > 100 AND p_retailprice < 1000) AS reject FROM part""")
def tracking_pixel_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", ((size <= 2) | ((price / size > 100) & (price < 1000))).alias("reject"))


@query("""
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_returnflag, l_linenumber, l_partkey, l_suppkey, l_quantity) AS place FROM lineitem
""")
def issue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues in their reporting order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("place"))


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS r FROM documents) WHERE r <= 3""")
def spot_check_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each source by hash; sampling is the feature."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return segment.top_per_group(docs, ["source"], [F.asc("h")], 3).select("source", "doc_id")


@query("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal > 8000 THEN c_name ELSE '' END, ''), nullif(CASE WHEN c_acctbal > 4000 THEN c_mktsegment ELSE '' END, ''), 'none') AS caption FROM customer""")
def caption_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    bal = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.coalesce(F.when(bal > 8000, F.col("c_name")), F.when(bal > 4000, F.col("c_mktsegment")), F.lit("none")).alias("caption")
    )


@query("""SELECT o_orderkey, sha256(o_orderstatus || chr(31) || o_orderpriority || chr(31) || o_custkey) AS digest FROM orders""")
def cache_key_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.concat_ws("\x1f", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(parts, 256).alias("digest"))


@query("""SELECT d.doc_id, sha256(d.text) <> s.recorded AS drift FROM documents d JOIN (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN text || ' ' ELSE text END) AS recorded FROM documents) s USING (doc_id)""")
def sidecar_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets whose bytes are not those their record names."""
    docs = table(spark, sf_dir, "documents")
    recorded = docs.select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("recorded"))
    return docs.select("doc_id", F.sha2("text", 256).alias("now")).join(recorded, "doc_id").select("doc_id", (F.col("now") != F.col("recorded")).alias("drift"))


@query("""
WITH b AS (SELECT doc_id, lang, source, sha256(text) AS h FROM documents), n AS (SELECT *, lag(doc_id) OVER w AS prev, lead(doc_id) OVER w AS next FROM b WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT h, min_by(doc_id, (CASE WHEN prev IS NULL THEN 1 ELSE 0 END, CASE WHEN next IS NULL THEN 1 ELSE 0 END, doc_id)) AS chosen, count(*) AS n FROM n GROUP BY 1 HAVING count(*) > 1
""")
def duplicate_block_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal blocks that with neighbours on both sides, then the first."""
    w = Window.partitionBy("source").orderBy("doc_id")
    blocks = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    lone = lambda c: c.isNull().cast("int")
    placed = blocks.withColumn("a", lone(F.lag("doc_id").over(w))).withColumn("b", lone(F.lead("doc_id").over(w)))
    return placed.groupBy("h").agg(F.min_by("doc_id", F.struct("a", "b", "doc_id")).alias("chosen"), F.count("*").alias("n")).filter("n > 1")


@query("""
SELECT l_orderkey, string_agg(DISTINCT l_shipmode_like, ',' ORDER BY l_shipmode_like) AS kinds, max(l_quantity) AS importance, CAST(count(DISTINCT l_partkey) AS BIGINT) AS claims FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem) GROUP BY 1
""")
def claim_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of one entity: kinds, greatest importance, how many."""
    kind = F.concat("l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("kinds"), F.max("l_quantity").alias("importance"), F.countDistinct("l_partkey").alias("claims")
    )


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def retry_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that have begun and never ended."""
    orders = table(spark, sf_dir, "orders")
    return quality.orphans(orders.filter("o_orderstatus = 'O'").select("o_custkey").distinct(), orders.filter("o_orderstatus = 'F'"), "o_custkey")
