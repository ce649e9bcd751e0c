"""Alias and link queries; terms stand for page names, as links of the test pages are single words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, segment
from .registry import query, table


def _key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second word of each page's title name the page."""
    title = F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)", 1), "[^A-Za-z ]", "")
    words = table(spark, sf_dir, "pages").select("page_id", F.explode(F.slice(F.split(F.trim(title), " +"), 1, 2)).alias("w"))
    return graph.alias_map(words, "page_id", _key(F.col("w")))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.anchors_of(table(spark, sf_dir, "pages"), "page_id", "html")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve(_links(spark, sf_dir), _aliases(spark, sf_dir), _key(F.col("href")))


_SQL = """
w AS (SELECT page_id, unnest(list_slice(regexp_split_to_array(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '[^A-Za-z ]', '', 'g')), ' +'), 1, 2)) AS w FROM pages),
a AS (SELECT DISTINCT lower(regexp_replace(w, '[^A-Za-z]', '', 'g')) AS norm, page_id AS id FROM w WHERE regexp_replace(w, '[^A-Za-z]', '', 'g') <> ''),
l AS (SELECT page_id AS id, unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>', 1)) AS href, CAST(generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>', 1), 1) - 1 AS INTEGER) AS place FROM pages),
k AS (SELECT *, lower(regexp_replace(href, '[^A-Za-z]', '', 'g')) AS norm FROM l),
r AS (SELECT k.id, k.place, k.href, k.norm, count(a.id) AS others, min(a.id) AS target FROM k LEFT JOIN a ON a.norm = k.norm AND a.id <> k.id GROUP BY 1, 2, 3, 4),
e AS (SELECT DISTINCT id AS src, target AS dst FROM r WHERE others = 1)
"""


@query(f"WITH {_SQL} SELECT norm, id FROM a")
def alias_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aliases(spark, sf_dir)


@query(f"WITH {_SQL} SELECT norm, count(DISTINCT id) AS owners, min(id) AS owner FROM a GROUP BY 1 HAVING count(DISTINCT id) > 1")
def alias_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.alias_degree(_aliases(spark, sf_dir)).filter("owners > 1")


@query(f"""WITH {_SQL}, q AS (SELECT item_id, lower(regexp_replace(split_part(text, ' ', 1), '[^A-Za-z]', '', 'g')) AS norm FROM benchmark)
SELECT item_id, q.norm, count(a.id) AS hits, min(a.id) AS first FROM q LEFT JOIN a ON a.norm = q.norm GROUP BY 1, 2""")
def alias_lookup_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select("item_id", _key(F.substring_index("text", " ", 1)).alias("norm"))
    owners = _aliases(spark, sf_dir).groupBy("norm").agg(F.count("*").alias("hits"), F.min("id").alias("first"))
    return asked.join(owners, "norm", "left").select("item_id", "norm", F.coalesce("hits", F.lit(0)).alias("hits"), "first")


@query(f"WITH {_SQL} SELECT id, place, href FROM r WHERE others = 0 AND NOT EXISTS (SELECT 1 FROM a WHERE a.norm = r.norm)")
def wikilink_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir).withColumn("norm", _key(F.col("href")))
    return links.join(_aliases(spark, sf_dir).select("norm").distinct(), "norm", "left_anti").select("id", "place", "href")


@query(f"WITH {_SQL} SELECT id, place, href, others FROM r WHERE others > 1")
def wikilink_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).filter("others > 1").select("id", "place", "href", F.col("others").cast("long").alias("others"))


@query(f"WITH {_SQL} SELECT src, dst FROM e")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(_resolved(spark, sf_dir))


@query(f"WITH {_SQL} SELECT dst AS page, count(DISTINCT src) AS backlinks FROM e GROUP BY 1")
def backlink_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(_resolved(spark, sf_dir)).groupBy(F.col("dst").alias("page")).agg(F.count("*").alias("backlinks"))


@query(f"""WITH {_SQL}, n AS (SELECT src AS page, dst AS other, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, src, 0, 1 FROM e)
SELECT page, other, CASE WHEN max(o) + max(i) = 2 THEN 'both' WHEN max(o) = 1 THEN 'out' ELSE 'in' END AS direction FROM n GROUP BY 1, 2""")
def page_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(graph.edges(_resolved(spark, sf_dir)))


@query(f"""WITH {_SQL}, d AS (SELECT dst AS page, 1 AS b, 0 AS f FROM e UNION ALL SELECT src, 0, 1 FROM e),
g AS (SELECT page, CAST(sum(b) AS BIGINT) AS backlinks, CAST(sum(f) AS BIGINT) AS forward FROM d GROUP BY 1)
SELECT page, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, backlinks, forward, row_number() OVER (ORDER BY backlinks DESC, forward DESC, page) AS rank FROM g JOIN pages ON page = page_id ORDER BY rank LIMIT 50""")
def link_graph_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty pages with the most backlinks."""
    degrees = graph.degrees(graph.edges(_resolved(spark, sf_dir)))
    best = degrees.orderBy(F.desc("backlinks"), F.desc("forward"), "page").limit(50)
    hosts = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    # After the limit the ranking has fifty rows, whatever the size of the graph.
    ranked = segment.top_per_group(best.withColumn("_one", F.lit(1)), ["_one"], [F.desc("backlinks"), F.desc("forward"), F.asc("page")], 50, rank="rank")
    return ranked.join(hosts, "page").select("page", "host", "backlinks", "forward", "rank")


@query(f"""WITH {_SQL} SELECT 'orphan' AS code, id AS page, count(*) AS n FROM r WHERE others = 0 AND NOT EXISTS (SELECT 1 FROM a WHERE a.norm = r.norm) GROUP BY 2
UNION ALL SELECT 'ambiguous', id, count(*) FROM r WHERE others > 1 GROUP BY 2
UNION ALL SELECT 'no-title', page_id, 1 FROM pages WHERE regexp_extract(html, '<title>([^<]*)', 1) = ''""")
def lint_issues_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda code, df: df.groupBy(F.lit(code).alias("code"), F.col("id").alias("page")).agg(F.count("*").alias("n"))
    untitled = table(spark, sf_dir, "pages").filter(F.regexp_extract("html", "<title>([^<]*)", 1) == "")
    return (
        count("orphan", wikilink_orphans(spark, sf_dir))
        .unionByName(count("ambiguous", wikilink_ambiguous(spark, sf_dir)))
        .unionByName(untitled.select(F.lit("no-title").alias("code"), F.col("page_id").alias("page"), F.lit(1).cast("long").alias("n")))
    )
