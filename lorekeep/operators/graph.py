"""Aliases, links and the page graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alias_map(df: DataFrame, id_col: str, alias: Column) -> DataFrame:
    """(norm, id) long form of an alias multimap; empty aliases are left out."""
    return df.select(alias.alias("norm"), F.col(id_col).alias("id")).filter(F.coalesce(F.col("norm"), F.lit("")) != "").distinct()


def alias_degree(aliases: DataFrame) -> DataFrame:
    """Per alias how many ids bear it, and the least."""
    return aliases.groupBy("norm").agg(F.countDistinct("id").alias("owners"), F.min("id").alias("owner"))


def anchors_of(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, place, href, label) of ``<a href="...">label`` in page order."""
    found = F.regexp_extract_all(html_col, F.lit(r'<a href="([^"]*)"[^>]*>'), F.lit(1))
    return df.select(F.col(id_col).alias("id"), F.posexplode(found).alias("place", "href"))


def resolve(links: DataFrame, aliases: DataFrame, key: Column) -> DataFrame:
    """Each link with the number of ids its key names, other than its own page, and the least of them.

    The alias table is reduced to one row for each key before the join, so that
    common keys do not multiply.
    """
    owners = aliases.groupBy("norm").agg(F.count("*").alias("owners"), F.min("id").alias("o1"), F.max("id").alias("o2"))
    joined = links.withColumn("norm", key).join(owners, "norm", "left")
    own = aliases.select(F.col("norm"), F.col("id"), F.lit(1).alias("is_own"))
    joined = joined.join(own, ["norm", "id"], "left")
    others = F.coalesce(F.col("owners"), F.lit(0)) - F.coalesce(F.col("is_own"), F.lit(0))
    target = F.when(F.col("o1") != F.col("id"), F.col("o1")).otherwise(F.when(F.col("o2") != F.col("id"), F.col("o2")))
    return joined.withColumn("others", others).withColumn("target", target).drop("owners", "o1", "o2", "is_own")


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct unambiguous links between different pages."""
    return resolved.filter("others = 1 AND target IS NOT NULL").select(F.col("id").alias("src"), F.col("target").alias("dst")).distinct()


def neighbours(edge_list: DataFrame) -> DataFrame:
    """(page, other, direction): ``out``, ``in`` or ``both``."""
    both = edge_list.select(F.col("src").alias("page"), F.col("dst").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edge_list.select(F.col("dst").alias("page"), F.col("src").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    g = both.groupBy("page", "other").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    return g.select("page", "other", F.when(F.col("o") + F.col("i") == 2, "both").when(F.col("o") == 1, "out").otherwise("in").alias("direction"))


def degrees(edge_list: DataFrame) -> DataFrame:
    """(page, backlinks, forward) over pages with any link."""
    ends = edge_list.select(F.col("dst").alias("page"), F.lit(1).alias("b"), F.lit(0).alias("f")).unionByName(
        edge_list.select(F.col("src").alias("page"), F.lit(0).alias("b"), F.lit(1).alias("f"))
    )
    return ends.groupBy("page").agg(F.sum("b").alias("backlinks"), F.sum("f").alias("forward"))
