"""Candidates, claims and gates: ``benchmark`` items stand for claims, ``labels`` for flags, ``part`` and ``supplier`` for pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import quality, render, retrieval, segment
from .registry import query, table

_TERMS = """
w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS term FROM benchmark),
q AS (SELECT term, max(1 + item_id % 5) AS importance, bool_or(item_id % 4 = 0) AS required FROM w GROUP BY 1)
"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, importance, required): the strongest flags of each term."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(retrieval.terms("text", "[a-z]{5,}")).alias("term"))
    return words.groupBy("term").agg(F.max(1 + F.col("item_id") % 5).alias("importance"), F.bool_or(F.col("item_id") % 4 == 0).alias("required"))


@query(f"WITH {_TERMS} SELECT * FROM q")
def term_dedupe_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir)


@query(f"""WITH {_TERMS}, t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) AS term FROM documents),
a AS (SELECT doc_id, lower(regexp_extract(text, '^[A-Za-z]+')) AS alias FROM documents),
s AS (SELECT doc_id, importance AS pts, false AS pin FROM t JOIN q USING (term) UNION ALL SELECT doc_id, 100 + 10 * importance, required FROM a JOIN q ON alias = term)
SELECT doc_id, CAST(sum(pts) AS BIGINT) AS score, bool_or(pin) AS pinned FROM s GROUP BY 1""")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a term gain its importance; a term that is the document's alias counts 100 and ten times it, and pins where required."""
    asked, docs = _terms(spark, sf_dir), table(spark, sf_dir, "documents")
    body = docs.select("doc_id", F.explode(F.array_distinct(retrieval.terms("text", "[a-z]{5,}"))).alias("term")).join(asked, "term")
    alias = docs.select("doc_id", F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("term")).join(asked, "term")
    points = body.select("doc_id", F.col("importance").alias("pts"), F.lit(False).alias("pin")).unionByName(
        alias.select("doc_id", (100 + 10 * F.col("importance")).alias("pts"), F.col("required").alias("pin"))
    )
    return points.groupBy("doc_id").agg(F.sum("pts").alias("score"), F.bool_or("pin").alias("pinned"))


@query("""
SELECT brand, o.p_partkey AS owner, o.p_size AS size FROM (SELECT p_brand AS brand, max((p_size, -p_partkey)) AS m FROM part GROUP BY 1) g JOIN part o ON o.p_brand = brand AND o.p_size = m[1] AND -o.p_partkey = m[2]
""")
def alias_owner_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pages that share an alias the largest owns it, the oldest of equals."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("owner"), F.col("p_size").alias("size"))
    return quality.best_of(part, ["brand"], [F.col("size"), -F.col("owner")], ["owner", "size"])


@query("""
SELECT b.item_id, count(d.doc_id) AS pages, min(d.doc_id) AS first_page FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1
""")
def claim_coverage_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each claim the pages that hold it word for word."""
    claims = table(spark, sf_dir, "benchmark")
    found = retrieval.quotes_in(claims, "item_id", "text", table(spark, sf_dir, "documents"), "doc_id", "text")
    g = found.groupBy("item_id").agg(F.count("*").alias("pages"), F.min("doc_id").alias("first_page"))
    return claims.select("item_id").join(g, "item_id", "left").select("item_id", F.coalesce("pages", F.lit(0)).alias("pages"), "first_page")


_DISPOSITION = """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL AND n_chars > 2000 THEN 'missing' WHEN l.doc_id IS NULL THEN 'skipped' WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'modified' ELSE 'covered' END AS disposition
FROM documents d LEFT JOIN labels l USING (doc_id)
"""


def _dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("has", F.lit(True))
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    kind = (
        F.when(F.col("has").isNull() & (F.col("n_chars") > 2000), "missing")
        .when(F.col("has").isNull(), "skipped")
        .when(F.col("toxic") == 1, "rejected")
        .when(F.col("quality") == 1, "modified")
        .otherwise("covered")
    )
    return joined.select("doc_id", kind.alias("disposition"))


@query(_DISPOSITION)
def candidate_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dispositions(spark, sf_dir)


@query(f"SELECT disposition, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM ({_DISPOSITION}) GROUP BY 1")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dispositions(spark, sf_dir).groupBy("disposition").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS para, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)
SELECT doc_id, k AS para, CAST(len(regexp_extract_all(para, '[.!?]+')) AS BIGINT) AS sentences, CAST(length(regexp_replace(para, '[^A-Za-z0-9]', '', 'g')) AS BIGINT) AS alnum,
  len(regexp_extract_all(para, '[.!?]+')) <= 1 AND length(regexp_replace(para, '[^A-Za-z0-9]', '', 'g')) < 40 AS fact_card FROM p
""")
def fact_card_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs too short to be prose."""
    paras = segment.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    n = F.size(F.regexp_extract_all("line", F.lit("[.!?]+"), F.lit(0))).cast("long")
    alnum = F.length(F.regexp_replace("line", "[^A-Za-z0-9]", "")).cast("long")
    rows = paras.select("doc_id", F.col("ord").cast("long").alias("para"), n.alias("sentences"), alnum.alias("alnum"))
    return rows.withColumn("fact_card", (F.col("sentences") <= 1) & (F.col("alnum") < 40))


@query("""
WITH f AS (SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)), a AS (SELECT p_partkey FROM part WHERE p_size < 10)
SELECT p_partkey, 'orphan' AS verdict FROM f WHERE p_partkey NOT IN (SELECT p_partkey FROM a) UNION ALL SELECT p_partkey, 'stale' FROM a WHERE p_partkey NOT IN (SELECT p_partkey FROM f)
""")
def orphan_assets_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return quality.allow_list(part.select("p_partkey").join(used, "p_partkey", "left_anti"), part.filter("p_size < 10").select("p_partkey"), "p_partkey")


@query("""
WITH p AS (SELECT DISTINCT substr(c_name, 1, 15 + c_custkey % 4) AS prefix FROM customer)
SELECT prefix, count(c_name) AS hits, CASE WHEN count(c_name) = 1 THEN min(c_name) END AS c_name FROM p LEFT JOIN customer ON starts_with(c_name, prefix) GROUP BY 1
""")
def done_label_prefix_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer")
    prefixes = names.select(F.substring(F.col("c_name"), F.lit(1), (15 + F.col("c_custkey") % 4).cast("int")).alias("prefix")).distinct()
    return quality.prefix_match(prefixes, "prefix", names.select("c_name"), "c_name", [15, 16, 17, 18])


@query("SELECT o_orderkey, o_orderpriority AS label FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_pending_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return quality.orphans(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label")), done, "o_orderkey")


@query("""
WITH a AS (SELECT c_nationkey AS k, list(DISTINCT c_mktsegment) AS s FROM customer WHERE c_acctbal > 0 GROUP BY 1), b AS (SELECT c_nationkey AS k, list(DISTINCT c_mktsegment) AS s FROM customer WHERE c_acctbal > 9900 GROUP BY 1)
SELECT k, list_has_all(a.s, b.s) AS holds, list_has_any(a.s, b.s) AS touches, CAST(len(list_intersect(a.s, b.s)) AS INTEGER) AS shared FROM a JOIN b USING (k)
""")
def merge_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one page's aliases hold another's."""
    sets = lambda cond, name: table(spark, sf_dir, "customer").filter(cond).groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_set("c_mktsegment").alias(name))
    both = sets("c_acctbal > 0", "a").join(sets("c_acctbal > 9900", "b"), "k")
    return both.select("k", (F.size(F.array_except("b", "a")) == 0).alias("holds"), F.arrays_overlap("a", "b").alias("touches"), F.size(F.array_intersect("a", "b")).alias("shared"))


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '#' || substr(o_orderpriority, 1, 1) ELSE o_orderstatus END AS ref FROM orders WHERE o_orderkey % 3 = 0),
n AS (SELECT DISTINCT o_custkey AS k, o_orderstatus || '#' || substr(o_orderpriority, 1, 1) AS ref FROM orders WHERE o_orderkey % 3 <> 0)
SELECT k, ref FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k = o.k AND (n.ref = o.ref OR (NOT contains(o.ref, '#') AND starts_with(n.ref, o.ref || '#'))))
""")
def anchor_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old citations that the new text neither keeps nor makes more precise."""
    orders = table(spark, sf_dir, "orders")
    full = F.concat("o_orderstatus", F.lit("#"), F.substring("o_orderpriority", 1, 1))
    ref = F.when(F.col("o_orderkey") % 2 == 0, full).otherwise(F.col("o_orderstatus"))
    old = orders.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k"), ref.alias("ref")).distinct()
    new = orders.filter("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("k"), full.alias("ref"))
    # Each new anchor also preserves its bare form.
    keeps = new.unionByName(new.select("k", F.substring_index("ref", "#", 1).alias("ref"))).distinct()
    return old.join(keeps, ["k", "ref"], "left_anti")


@query("""
SELECT l_orderkey, l_linenumber, code FROM (SELECT l_orderkey, l_linenumber, unnest([CASE WHEN l_quantity > 48 THEN 'importance' END, CASE WHEN l_discount >= 0.1 THEN 'range' END, CASE WHEN p_partkey IS NULL THEN 'reference' END]) AS code
  FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 45) ON l_partkey = p_partkey) WHERE code IS NOT NULL
""")
def artifact_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of a record's rules, one row each."""
    known = table(spark, sf_dir, "part").filter("p_size < 45").select("p_partkey")
    rows = table(spark, sf_dir, "lineitem").join(known, F.col("l_partkey") == F.col("p_partkey"), "left")
    codes = F.array_compact(
        F.array(F.when(F.col("l_quantity") > 48, "importance"), F.when(F.col("l_discount") >= 0.1, "range"), F.when(F.col("p_partkey").isNull(), "reference"))
    )
    return rows.select("l_orderkey", "l_linenumber", F.explode(codes).alias("code"))


@query("""
SELECT event_id, CASE WHEN TRY_CAST(props->>'k' AS INTEGER) IS NULL THEN 'shape' WHEN value < 0 THEN 'negative' WHEN value > 95 THEN 'large' WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'kind' ELSE 'ok' END AS verdict FROM events
""")
def annotation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    verdict = (
        F.when(k.isNull(), "shape")
        .when(F.col("value") < 0, "negative")
        .when(F.col("value") > 95, "large")
        .when(~F.col("event_type").isin("click", "view", "purchase", "signup"), "kind")
        .otherwise("ok")
    )
    return table(spark, sf_dir, "events").select("event_id", verdict.alias("verdict"))


@query("""
WITH q AS (SELECT doc_id, substr(text, 101, 12) AS quote, substr(text, 91, 10) AS prefix, text FROM documents WHERE length(text) > 200),
h AS (SELECT doc_id, quote, prefix, text, unnest(range(1, length(text) - 10)) AS p FROM q),
m AS (SELECT doc_id, p, CASE WHEN substr(text, p - 10, 10) = prefix AND p > 10 THEN 2 ELSE 0 END AS score FROM h WHERE substr(text, p, 12) = quote)
SELECT doc_id, arg_max(p, (score, -p)) - 1 AS at, max(score) AS score, count(*) AS hits FROM m GROUP BY 1
""")
def quote_relocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote found again: of its places that whose text before agrees, the first of equals."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 200)
    marked = docs.select("doc_id", "text", F.substring("text", 101, 12).alias("quote"), F.substring("text", 91, 10).alias("prefix"))
    places = marked.select("doc_id", F.posexplode(segment.quote_places("text", "quote", "prefix")).alias("_", "h"))
    best = places.groupBy("doc_id").agg(F.max_by("h.at", F.struct("h.score", -F.col("h.at"))).alias("at"), F.max("h.score").alias("score"), F.count("*").alias("hits"))
    return best.select("doc_id", F.col("at").cast("long").alias("at"), "score", "hits")


@query("SELECT p_partkey, p_size < 5 OR p_name LIKE '%1%' AS decorative, p_size >= 10 AND p_retailprice > 1000 AS keep FROM part")
def decorative_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", ((size < 5) | F.col("p_name").contains("1")).alias("decorative"), ((size >= 10) & (F.col("p_retailprice") > 1000)).alias("keep")
    )


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, n, regexp_extract(line, '([A-Z][a-z]+), ([a-z]+)', 1) AS subject FROM l WHERE regexp_matches(line, '[A-Z][a-z]+, [a-z]+')
""")
def conflict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = segment.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").filter(F.col("line").rlike("[A-Z][a-z]+, [a-z]+"))
    return lines.select("doc_id", F.col("ord").cast("long").alias("n"), F.regexp_extract("line", "([A-Z][a-z]+), ([a-z]+)", 1).alias("subject"))


@query("""
SELECT doc_id, strpos(lower(text), 'the') - 1 AS at, replace(text, 'the', '<mark>the</mark>') AS shown FROM documents WHERE contains(lower(text), 'the')
""")
def list_filter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.locate("the", F.lower("text"))
    shown = F.replace("text", F.lit("the"), F.lit("<mark>the</mark>"))
    return table(spark, sf_dir, "documents").filter(hit > 0).select("doc_id", (hit - 1).cast("long").alias("at"), shown.alias("shown"))


@query("SELECT c_custkey, 'sec=' || replace(replace(c_mktsegment, ' ', '%20'), '&', '%26') || '%2C%20' || CAST(c_nationkey AS VARCHAR) || '%25%20%23' AS anchor, c_mktsegment || ', ' || CAST(c_nationkey AS VARCHAR) || '% #' AS label FROM customer")
def section_anchor_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode a label and decode it again."""
    label = F.concat("c_mktsegment", F.lit(", "), F.col("c_nationkey").cast("string"), F.lit("% #"))
    coded = table(spark, sf_dir, "customer").select("c_custkey", X.encode_anchor(label).alias("anchor"))
    return coded.withColumn("label", X.decode_anchor(F.col("anchor")))


@query("SELECT doc_id, '/reader/' || doc_id || '#q=' || replace(replace(substr(regexp_extract(text, '[A-Za-z ]+'), 1, 20), ' ', '%20'), '+', '%2B') AS link FROM documents")
def deep_link_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = F.substring(F.regexp_extract("text", "[A-Za-z ]+", 0), 1, 20)
    coded = F.substring(X.encode_anchor(quote), 5, 1 << 20)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/reader/"), F.col("doc_id").cast("string"), F.lit("#q="), coded).alias("link"))


@query("SELECT doc_id, 'see [src:new-' || doc_id || '#a] and [src:old-x]' AS body FROM documents")
def citation_id_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("see [src:old-"), F.col("doc_id").cast("string"), F.lit("#a] and [src:old-x]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(body, r"\[src:old-([0-9]+)", "[src:new-$1").alias("body"))


@query("SELECT source, string_agg('- [[' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || ']]', chr(10) ORDER BY doc_id) AS page FROM documents GROUP BY 1")
def render_moc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.index_page(table(spark, sf_dir, "documents"), ["source"], F.lpad(F.col("doc_id").cast("string"), 8, "0"), "page")


@query("SELECT p_brand AS label, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size > 48) THEN '- [x] ' ELSE '- [ ] ' END || p_brand AS line FROM (SELECT DISTINCT p_brand FROM part)")
def progress_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), "p_size")
    return render.checklist(labels.select("label").distinct(), labels.filter("p_size > 48"), "label")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN ' ' ELSE '' END || CASE WHEN turn % 2 = 0 THEN '## card ' || turn ELSE '# card ' || turn END || chr(10) || role AS body FROM conversations")
def render_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.when(F.col("turn") % 2 == 0, "## card ").otherwise("# card "), F.col("turn").cast("string"), F.lit("\n"), "role")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", render.escape_card_headings(head).alias("body"))


@query("""
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}')) AS a FROM documents), b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}')) AS b FROM benchmark)
SELECT item_id, doc_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS shared FROM t, b WHERE len(list_intersect(a, b)) >= 3
""")
def candidate_page_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with at least three words in common, by counting shared words."""
    words = lambda df, key: df.select(key, F.explode(F.array_distinct(retrieval.terms("text", "[a-z]{6,}"))).alias("w"))
    docs = words(table(spark, sf_dir, "documents"), "doc_id")
    both = docs.join(words(table(spark, sf_dir, "benchmark"), "item_id"), "w")
    return both.groupBy("item_id", "doc_id").agg(F.count("*").alias("shared")).filter("shared >= 3")


@query("""SELECT lang, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END), 6) AS ratio, avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END) >= 0.8 AS accepted FROM documents GROUP BY 1""")
def alignment_ratio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.avg((F.col("n_chars") > 1000).cast("double"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(ratio, 6).alias("ratio"), (ratio >= 0.8).alias("accepted"))


@query("""
WITH b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark) SELECT item_id, CAST(len(w) AS BIGINT) AS words, array_to_string(list_slice(w, 1, 8), ' ') || CASE WHEN len(w) > 8 THEN ' […' || (len(w) - 8) || ' more]' ELSE '' END AS shown FROM b
""")
def truncate_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("text", " ", -1)
    more = F.when(F.size(w) > 8, F.concat(F.lit(" […"), (F.size(w) - 8).cast("string"), F.lit(" more]"))).otherwise(F.lit(""))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(w).cast("long").alias("words"), F.concat(F.array_join(F.slice(w, 1, 8), " "), more).alias("shown"))


@query("""SELECT item_id, alias, row_number() OVER (PARTITION BY item_id ORDER BY length(alias) DESC, alias) AS place FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS alias FROM benchmark)""")
def longest_alias_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order in which aliases are linked: longest first."""
    names = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))).alias("alias"))
    w = Window.partitionBy("item_id").orderBy(F.desc(F.length("alias")), "alias")
    return names.withColumn("place", F.row_number().over(w))
