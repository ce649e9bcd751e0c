"""Identity, segmentation and text queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import identity, segment
from .registry import query, table


@query("""
SELECT d.doc_id, d.sha256, g.canonical, g.n FROM (SELECT doc_id, sha256(text) AS sha256 FROM documents) d
JOIN (SELECT sha256(text) AS sha256, min(doc_id) AS canonical, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) g USING (sha256)
""")
def doc_dedup_by_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", F.sha2("text", 256), "sha256")


@query("""
SELECT d.doc_id, d.norm8, g.canonical, g.n
FROM (SELECT doc_id, substr(sha256(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g')), 1, 8) AS norm8 FROM documents) d
JOIN (SELECT substr(sha256(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g')), 1, 8) AS norm8, min(doc_id) AS canonical, count(*) AS n
      FROM documents GROUP BY 1 HAVING count(*) > 1) g USING (norm8)
""")
def doc_dedup_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", X.hash8(X.without_space(F.col("text"))), "norm8")


@query("""
WITH l AS (SELECT doc_id, line, ord FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)),
h AS (SELECT *, CASE WHEN length(line) < 40 AND trim(line) <> '' THEN ord END AS h_at FROM l),
s AS (SELECT doc_id, line, ord, coalesce(max(h_at) OVER (PARTITION BY doc_id ORDER BY ord), 0) AS section FROM h)
SELECT doc_id, section, CAST(sum(length(trim(line))) AS BIGINT) AS chars, count(*) AS lines FROM s GROUP BY 1, 2
""")
def section_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under a short line are its section; trimmed sizes."""
    lines = segment.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    heading = (F.length("line") < 40) & (F.trim("line") != "")
    sections = segment.carry_forward(lines, ["doc_id"], "ord", F.when(heading, F.col("ord")), "section", 0)
    return sections.groupBy("doc_id", "section").agg(F.sum(F.length(F.trim("line"))).alias("chars"), F.count("*").alias("lines"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents),
h AS (SELECT doc_id, ord, trim(line) AS label FROM l WHERE length(line) < 40 AND trim(line) <> ''),
r AS (SELECT doc_id, label, ord AS first_line, lead(ord) OVER (PARTITION BY doc_id ORDER BY ord) AS next_line FROM h)
SELECT r.doc_id, label, first_line, coalesce(next_line, n + 1) AS end_line FROM r JOIN (SELECT doc_id, max(ord) AS n FROM l GROUP BY 1) USING (doc_id)
""")
def chapter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open line ranges between headings."""
    docs = table(spark, sf_dir, "documents")
    lines = segment.lines(docs.select("doc_id", "text", F.size(F.split("text", "\n", -1)).alias("n")), "text")
    heads = lines.filter((F.length("line") < 40) & (F.trim("line") != ""))
    after = F.lead("ord").over(Window.partitionBy("doc_id").orderBy("ord"))
    return heads.select(
        "doc_id", F.trim("line").alias("label"), F.col("ord").cast("long").alias("first_line"), F.coalesce(after, F.col("n") + 1).cast("long").alias("end_line")
    )


@query("""
WITH f AS (SELECT doc_id, lang, split_part(text, chr(10), 1) AS label FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, label ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY lang, label) AS n FROM f)
SELECT doc_id, CASE WHEN n > 1 THEN label || ' [occurrence ' || i || '/' || n || ']' ELSE label END AS label FROM n
""")
def stable_occurrence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.substring_index("text", "\n", 1).alias("label"))
    return segment.occurrence_labels(docs, ["lang"], "label", "doc_id").select("doc_id", "label")


@query("""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[^.!?]+[.!?]+')) AS BIGINT) AS sentences,
  CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]+'), lambda x: length(trim(x, ' ' || chr(10))))), 0) AS BIGINT) AS chars
FROM documents
""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.sentences("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(found).cast("long").alias("sentences"),
        F.aggregate(found, F.lit(0).cast("long"), lambda s, x: s + F.length(F.trim(x, F.lit(" \n")))).alias("chars"),
    )


@query("""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS w, generate_subscripts(regexp_extract_all(text, '[a-zA-Z]+'), 1) AS pos FROM documents)
SELECT doc_id, lower(w) AS word, min(pos) AS first_pos, count(*) AS n FROM t GROUP BY 1, 2
""")
def content_words_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("p", "w"))
    return words.groupBy("doc_id", F.lower("w").alias("word")).agg((F.min("p") + 1).cast("long").alias("first_pos"), F.count("*").alias("n"))


@query("""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[a-zA-Z]+')) AS BIGINT) AS tokens,
  CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS BIGINT) AS distinct_words,
  CAST(len(regexp_extract_all(text, '[.!?]+')) AS BIGINT) AS sentence_ends FROM documents
""")
def reading_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).cast("long").alias("tokens"),
        F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).cast("long").alias("distinct_words"),
        F.size(F.regexp_extract_all("text", F.lit("[.!?]+"), F.lit(0))).cast("long").alias("sentence_ends"),
    )


@query("""
SELECT doc_id, CASE WHEN length(l) > 150 THEN trim(substr(l, 1, 150)) || '…' ELSE l END AS excerpt
FROM (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS l FROM documents)
""")
def excerpt_150(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.excerpt(F.substring_index("text", "\n", 1)).alias("excerpt"))


@query("""
SELECT d.source, d.lang, count(*) AS docs, CAST(sum(d.n_chars) AS BIGINT) AS chars FROM documents d GROUP BY GROUPING SETS ((d.source, d.lang), (d.source), ())
""")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupingSets([["source", "lang"], ["source"], []], "source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("""
SELECT lang, source, docs FROM (SELECT lang, source, count(*) AS docs, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY 1, 2) WHERE r <= 3
""")
def tag_top_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("docs"))
    return segment.top_per_group(counts, ["lang"], [F.desc("docs"), F.asc("source")], 3)


@query("""
SELECT doc_id, CASE WHEN NOT regexp_matches(source, '^[a-z]+[0-9]+$') THEN 'syntax' WHEN length(source) > 5 THEN 'depth'
  WHEN source NOT IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9') THEN 'unknown' ELSE 'ok' END AS verdict FROM documents
""")
def taxonomy_tag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(f"src{i}",) for i in range(10)], "tag string")
    docs = table(spark, sf_dir, "documents").join(F.broadcast(known), F.col("source") == F.col("tag"), "left")
    return docs.select(
        "doc_id",
        F.when(~F.col("source").rlike("^[a-z]+[0-9]+$"), "syntax").when(F.length("source") > 5, "depth").when(F.col("tag").isNull(), "unknown").otherwise("ok").alias("verdict"),
    )


@query("""
SELECT source, CASE WHEN bool_or(lang = 'en') THEN 'en' WHEN bool_or(lang = 'de') THEN 'de' WHEN bool_or(lang = 'fr') THEN 'fr' ELSE 'uncat' END AS domain, count(*) AS docs
FROM documents GROUP BY source
""")
def primary_domain_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda x: F.bool_or(F.col("lang") == x)
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.when(has("en"), "en").when(has("de"), "de").when(has("fr"), "fr").otherwise("uncat").alias("domain"), F.count("*").alias("docs")
    )


@query("""
SELECT source, lang, count(*) AS members, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id)) AS member_hash FROM documents GROUP BY 1, 2
""")
def moc_member_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an index page and the hash that tells whether it must be rendered anew."""
    return identity.ordered_hash(table(spark, sf_dir, "documents"), ["source", "lang"], "doc_id", "member_hash")


@query("""
SELECT doc_id, CAST(length(regexp_replace(text, '(?i)\\b(the chapter|the section|the source|the text|the book|the author|according to|it is argued that)\\b', '', 'g')) AS BIGINT) AS rest,
  regexp_matches(text, '(?i)\\b(the chapter|the section|the source|the text|the book|the author|according to|it is argued that)\\b') AS forbidden FROM documents
""")
def forbidden_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that make the source speak; fixed list."""
    phrases = ("the chapter", "the section", "the source", "the text", "the book", "the author", "according to", "it is argued that")
    pattern = r"(?i)\b(" + "|".join(phrases) + r")\b"
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(F.regexp_replace("text", pattern, "")).cast("long").alias("rest"), F.col("text").rlike(pattern).alias("forbidden")
    )


@query("""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
a AS (SELECT line, count(*) AS n FROM l WHERE source = 'src0' GROUP BY 1), b AS (SELECT line, count(*) AS n FROM l WHERE source = 'src1' GROUP BY 1)
SELECT line, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM a FULL OUTER JOIN b USING (line) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)
""")
def paragraph_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = segment.lines(table(spark, sf_dir, "documents").filter(F.col("source").isin("src0", "src1")).select("source", "text"), "text")
    counts = lines.groupBy("line").agg(*[F.count(F.when(F.col("source") == s, 1)).alias(c) for s, c in (("src0", "before"), ("src1", "after"))])
    return counts.filter("before <> after")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CAST(sum(CASE WHEN regexp_matches(line, '^[A-Z][a-z]+') THEN 1 ELSE 0 END) AS BIGINT) AS capital_lines,
  CAST(max(length(line)) AS BIGINT) AS longest, CAST(count(DISTINCT line) AS BIGINT) AS distinct_lines, count(*) AS lines FROM l GROUP BY 1
""")
def entity_size_warn(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = segment.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return lines.groupBy("doc_id").agg(
        F.sum(F.col("line").rlike("^[A-Z][a-z]+").cast("long")).alias("capital_lines"),
        F.max(F.length("line")).cast("long").alias("longest"),
        F.countDistinct("line").alias("distinct_lines"),
        F.count("*").alias("lines"),
    )


@query("""
SELECT doc_id, '[src:' || doc_id || '#sec=' || lang || '%20' || source || ']' AS cite, CAST(doc_id AS VARCHAR) AS source_id, lang || ' ' || source AS label FROM documents
""")
def citation_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations written into text, parsed back and decoded."""
    label = F.concat_ws(" ", "lang", "source")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("claim [src:"), F.col("doc_id").cast("string"), F.lit("#"), X.encode_anchor(label), F.lit("]")).alias("body")
    )
    cites = segment.citations(docs, "body")
    return cites.select("doc_id", F.concat(F.lit("[src:"), "source_id", F.lit("#"), "raw_anchor", F.lit("]")).alias("cite"), "source_id", F.col("anchor").alias("label"))


@query("""
SELECT doc_id, trim(regexp_replace(regexp_replace(source || ' | ' || lang || ': ' || split_part(text, ' ', 1), '[|:]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS chapter,
  replace('a/' || source, '/', '__') AS tag FROM documents
""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("source", F.lit(" | "), "lang", F.lit(": "), F.substring_index("text", " ", 1))
    return table(spark, sf_dir, "documents").select("doc_id", X.chapter_key(title).alias("chapter"), X.tag_slug(F.concat(F.lit("a/"), "source")).alias("tag"))


@query("""
WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM benchmark),
q AS (SELECT item_id, term FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY length(term) DESC, term) AS r FROM (SELECT DISTINCT item_id, term FROM w)) WHERE r <= 3),
t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM documents),
s AS (SELECT item_id, doc_id, CAST(count(*) AS BIGINT) AS score FROM q JOIN t USING (term) GROUP BY 1, 2)
SELECT item_id, doc_id, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 20
""")
def candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents by the rarest-looking terms of each benchmark item."""
    term = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)))).alias("term")
    terms = table(spark, sf_dir, "benchmark").select("item_id", term("text"))
    wanted = segment.top_per_group(terms, ["item_id"], [F.desc(F.length("term")), F.asc("term")], 3)
    held = table(spark, sf_dir, "documents").select("doc_id", term("text"))
    scores = held.join(wanted, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("score"))
    return segment.top_per_group(scores, ["item_id"], [F.desc("score"), F.asc("doc_id")], 20, rank="rank")


@query("""
SELECT b.item_id, d.doc_id, CAST(strpos(d.text, b.text) - 1 AS BIGINT) AS at, CAST(strpos(d.text, b.text) - 1 + length(b.text) AS BIGINT) AS until
FROM benchmark b JOIN documents d ON contains(d.text, b.text)
""")
def quote_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First place of each benchmark passage in the documents that hold it, by a shared rare word."""
    from ..operators import retrieval

    found = retrieval.quotes_in(table(spark, sf_dir, "benchmark"), "item_id", "text", table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("item_id", "doc_id", F.col("at").cast("long"), (F.col("at") + F.col("size")).cast("long").alias("until"))


@query("""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf, min(doc_id) AS first_doc FROM p GROUP BY 1
""")
def search_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import retrieval

    return retrieval.postings(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.min("doc_id").alias("first_doc")
    )


@query("""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY 1),
c AS (SELECT count(*) AS n, avg(len) AS avg_len FROM l), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark),
s AS (SELECT item_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN l ON l.doc_id = p.doc_id, c GROUP BY 1, 2)
SELECT item_id, doc_id, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM s) WHERE r <= 10
""")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import retrieval

    return retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", k=10)


@query("""
SELECT doc_id, trim(regexp_replace(regexp_replace(t, '[*_~]+', '', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS clean
FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '[ \\t]\\|[ \\t]') THEN replace(text, '|', ' · ') || ' x · ' ELSE coalesce(text, '') || ' ' END || lang || ' ' || source AS t FROM documents)
""")
def markdown_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("> **"), F.coalesce("text", F.lit("")), F.lit("** [[x|"), "lang", F.lit("]] [`"), "source", F.lit("`](http://h/p)"))
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_markdown(md).alias("clean"))


@query("""
SELECT doc_id, source || ' ' || lang AS title FROM documents
""")
def title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("2024-01-31-"), "source", F.lit("--"), "lang", F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_title(name).alias("title"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)
SELECT doc_id, string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE ord <= 5) AS head, CAST(greatest(count(*) - 5, 0) AS BIGINT) AS elided FROM l GROUP BY 1
""")
def page_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(F.slice(lines, 1, 5), "\n").alias("head"), F.greatest(F.size(lines) - 5, F.lit(0)).cast("long").alias("elided")
    )


@query("""
SELECT l.doc_id, d.doc_id IS NULL AS orphan FROM (SELECT doc_id + 700 AS doc_id FROM labels) l LEFT JOIN documents d USING (doc_id) WHERE d.doc_id IS NULL
""")
def citation_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "labels").select((F.col("doc_id") + 700).alias("doc_id"))
    return cited.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_anti").withColumn("orphan", F.lit(True))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unused_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""
SELECT source, CAST(count(l.doc_id) AS BIGINT) AS declared, CAST(count(*) - count(l.doc_id) AS BIGINT) AS missing,
  CAST(coalesce(sum(l.quality), 0) AS BIGINT) AS good, CAST(coalesce(sum(l.toxic), 0) AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1
""")
def frontmatter_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(
        table(spark, sf_dir, "labels").withColumn("has", F.lit(1)), "doc_id", "left"
    )
    return joined.groupBy("source").agg(
        F.count("has").alias("declared"),
        (F.count("*") - F.count("has")).alias("missing"),
        F.coalesce(F.sum("quality"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
    )
