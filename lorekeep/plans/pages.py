"""Reader blocks, titles and URLs of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import segment
from .registry import query, table

_TAGGED = "<(?:h[1-4]|p|li)[^>]*>[^<]*"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, ord, kind, text) of headings and paragraphs in page order."""
    found = F.regexp_extract_all("html", F.lit(_TAGGED), F.lit(0))
    raw = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("ord", "raw"))
    return raw.select(
        "page_id",
        (F.col("ord") + 1).cast("long").alias("ord"),
        F.when(F.col("raw").rlike("^<h"), "heading").otherwise("paragraph").alias("kind"),
        X.squeeze(F.regexp_replace("raw", "^<[^>]*>", "")).alias("text"),
    )


_SQL_BLOCKS = """
r AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:h[1-4]|p|li)[^>]*>[^<]*')) AS raw,
  CAST(generate_subscripts(regexp_extract_all(html, '<(?:h[1-4]|p|li)[^>]*>[^<]*'), 1) AS BIGINT) AS ord FROM pages),
b AS (SELECT page_id, ord, CASE WHEN raw LIKE '<h%' THEN 'heading' ELSE 'paragraph' END AS kind,
  trim(regexp_replace(regexp_replace(raw, '^<[^>]*>', ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text FROM r),
i AS (SELECT *, CASE WHEN kind = 'heading' THEN 'h-' ELSE 'p-' END || substr(sha256(kind || chr(31) || regexp_replace(text, '[ \\t\\n\\r\\f\\v\\x{A0}]+', '', 'g')), 1, 8) AS block_id FROM b)
"""


@query(f"WITH {_SQL_BLOCKS} SELECT page_id, ord, kind, block_id, CAST(length(text) AS BIGINT) AS chars FROM i")
def block_ids_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("page_id", "ord", "kind", X.block_id(F.col("kind"), F.col("text")).alias("block_id"), F.length("text").cast("long").alias("chars"))


@query(f"""WITH {_SQL_BLOCKS} SELECT page_id, ord, block_id, coalesce(lag(block_id) OVER w, '') AS prev, coalesce(lead(block_id) OVER w, '') AS next
FROM i WINDOW w AS (PARTITION BY page_id ORDER BY ord)""")
def block_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("ord")
    ids = _blocks(spark, sf_dir).select("page_id", "ord", X.block_id(F.col("kind"), F.col("text")).alias("block_id"))
    return ids.select("page_id", "ord", "block_id", F.lag("block_id", 1, "").over(w).alias("prev"), F.lead("block_id", 1, "").over(w).alias("next"))


@query(f"""WITH {_SQL_BLOCKS} SELECT page_id, ord, coalesce(last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM i""")
def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.when(F.col("kind") == "heading", F.col("text"))
    return _blocks(spark, sf_dir).select("page_id", "ord", F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit("")).alias("section"))


@query("""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'),
  '(?is)<nav[^>]*>.*?</nav>', ' ', 'g'), '(?is)<footer[^>]*>.*?</footer>', ' ', 'g') AS h FROM pages),
t AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS h FROM s)
SELECT page_id, sha256(x) AS text_sha256, CAST(length(x) AS BIGINT) AS chars FROM (SELECT page_id,
  trim(regexp_replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS x FROM t)
""")
def html_boilerplate_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = X.plain_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", plain.alias("x")).select("page_id", F.sha2("x", 256).alias("text_sha256"), F.length("x").cast("long").alias("chars"))


@query("""
SELECT page_id, title, h1, title <> h1 AS mismatch FROM (SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)', 1)) AS title, trim(regexp_extract(html, '<h1>([^<]*)', 1)) AS h1 FROM pages)
""")
def html_title_h1_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lambda tag: F.trim(F.regexp_extract("html", f"<{tag}>([^<]*)", 1)).alias(tag)
    return table(spark, sf_dir, "pages").select("page_id", got("title"), got("h1")).withColumn("mismatch", F.col("title") != F.col("h1"))


@query("""
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '')
  || CASE WHEN rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') END
  || regexp_extract(url, '(\\?[^#]*)', 1) AS canonical FROM pages
""")
def feed_url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL in a noisy spelling of itself, made canonical."""
    noisy = F.concat(F.regexp_replace(F.regexp_replace("url", "^http://", "HTTP://me@"), "^https://", "HTTPS://"), F.lit("#part"))
    return table(spark, sf_dir, "pages").select("page_id", X.canonical_url(noisy).alias("canonical"))


@query("SELECT page_id, substr(regexp_replace(regexp_replace(url, '^https?://', ''), '[^A-Za-z0-9._-]+', '-', 'g'), 1, 80) AS slug FROM pages")
def url_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.url_slug(F.col("url")).alias("slug"))


@query("""
SELECT kind, count(*) AS pages FROM (SELECT CASE WHEN regexp_matches(url, '(youtube\\.com|youtu\\.be)/') THEN 'video' WHEN regexp_matches(lower(url), '\\.pdf([?#]|$)') THEN 'pdf'
  WHEN regexp_matches(lower(url), '\\.epub([?#]|$)') THEN 'epub' WHEN regexp_matches(url, '^https?://') THEN 'url' ELSE 'file' END AS kind FROM pages) GROUP BY 1
""")
def source_kind_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader that a source goes to, by scheme and extension."""
    url = F.col("url")
    kind = (
        F.when(url.rlike(r"(youtube\.com|youtu\.be)/"), "video")
        .when(F.lower(url).rlike(r"\.pdf([?#]|$)"), "pdf")
        .when(F.lower(url).rlike(r"\.epub([?#]|$)"), "epub")
        .when(url.rlike("^https?://"), "url")
        .otherwise("file")
    )
    return table(spark, sf_dir, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("pages"))


@query(f"""WITH {_SQL_BLOCKS}, r2 AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY page_id ORDER BY ord) THEN 0 ELSE 1 END AS c FROM i),
r3 AS (SELECT *, sum(c) OVER (PARTITION BY page_id ORDER BY ord) - 1 AS run FROM r2)
SELECT page_id, CAST(run AS BIGINT) AS run, kind, min(ord) AS first_ord, count(*) AS n FROM r3 GROUP BY 1, 2, 3""")
def reader_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = segment.runs(_blocks(spark, sf_dir), ["page_id"], "ord", "kind")
    return numbered.groupBy("page_id", F.col("run").cast("long").alias("run"), "kind").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n"))


@query("""
SELECT page_id, CAST(len(regexp_extract_all(html, 'href="[^"]*"')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<script')) AS BIGINT) AS scripts,
  regexp_matches(html, '(?i)<(script|iframe|object|embed)[ >]') AS raw_html, regexp_matches(html, '(?i) on[a-z]+=') AS handlers FROM pages
""")
def raw_html_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return table(spark, sf_dir, "pages").select(
        "page_id", n('href="[^"]*"').alias("links"), n("<script").alias("scripts"),
        F.col("html").rlike("(?i)<(script|iframe|object|embed)[ >]").alias("raw_html"), F.col("html").rlike("(?i) on[a-z]+=").alias("handlers"),
    )


@query("""
SELECT page_id, x AS candidate FROM (SELECT page_id, unnest(string_split('a-' || page_id || '.png 1x, data:zz 2x,b-' || page_id || '.png 300w', ',')) AS part FROM pages), LATERAL (SELECT split_part(trim(part), ' ', 1) AS x) WHERE x NOT LIKE 'data:%'
""")
def srcset_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id").cast("string")
    srcset = F.concat(F.lit("a-"), page, F.lit(".png 1x, data:zz 2x,b-"), page, F.lit(".png 300w"))
    firsts = F.transform(F.split(srcset, ","), lambda p: F.substring_index(F.trim(p), " ", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.filter(firsts, lambda p: ~p.startswith("data:") & (p != ""))).alias("candidate"))
