"""Queries of the character-level operators; tests hold them against plain loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.unicode import normalize_name
from ..operators import scanners
from .registry import query, table


@query()
def autolink_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types stand for page names and are looked for in a text that names two of them."""
    part = table(spark, sf_dir, "part")
    names = [r["p_type"] for r in part.select("p_type").distinct().collect()]  # a fixed vocabulary of 150 types
    text = F.concat(F.lit("about "), "p_type", F.lit(" and `"), "p_type", F.lit("` or [["), "p_brand", F.lit("]] with "), "p_type")
    return scanners.autolink(part.select("p_partkey", text.alias("t")), "p_partkey", "t", {n: n for n in names})


@query()
def zone_stack_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone marks by event kinds, in order of each user."""
    mark = (
        F.when(F.col("event_type") == "view", "<!-- llm-zone -->")
        .when(F.col("event_type") == "click", "<!-- /llm-zone -->")
        .when(F.col("event_type") == "signup", "<!-- human-zone -->")
        .when(F.col("event_type") == "purchase", "<!-- /human-zone -->")
        .otherwise("text")
    )
    lines = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", mark.alias("m")).alias("r"))
    pages = lines.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["m"]), "\n").alias("text"))
    return scanners.zone_check(pages, "user_id", "text")


@query()
def nfkc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", normalize_name("text").alias("name"))


@query()
def char_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document aligned with the next of its source."""
    docs = table(spark, sf_dir, "documents")
    # Only ids are sorted by source; the texts meet by id.
    w = Window.partitionBy("source").orderBy("doc_id")
    follows = docs.select("doc_id", F.lead("doc_id").over(w).alias("next"))
    later = docs.select(F.col("doc_id").alias("next"), F.col("text").alias("b"))
    pairs = docs.select("doc_id", F.col("text").alias("a")).join(follows, "doc_id").join(later, "next", "left")
    pairs = pairs.select("doc_id", "a", F.coalesce("b", F.lit("")).alias("b"))
    return scanners.alignment(pairs, "doc_id", "a", "b")
