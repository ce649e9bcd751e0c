"""Claims, candidates and gates: coverage, elections, dispositions, reference checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(refs: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """References whose key no owner has."""
    return refs.join(owners.select(key).distinct(), key, "left_anti")


def best_of(df: DataFrame, keys: list[str], order: list[Column], fields: list[str]) -> DataFrame:
    """One row for each group: that with the greatest ``order``; the fields break ties."""
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *fields)
    return df.groupBy(*keys).agg(F.max(place).alias("_m")).select(*keys, *[F.col(f"_m.{f}").alias(f) for f in fields])


def allow_list(found: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """(key, verdict): ``orphan`` for findings not allowed, ``stale`` for allowances that nothing needs."""
    bad = found.join(allowed, key, "left_anti").select(key, F.lit("orphan").alias("verdict"))
    return bad.unionByName(allowed.join(found, key, "left_anti").select(key, F.lit("stale").alias("verdict")))


def prefix_match(prefixes: DataFrame, prefix: str, labels: DataFrame, label: str, sizes: list[int]) -> DataFrame:
    """(prefix, hits, label): labels that start with the prefix, the label itself where it is the only one.

    Prefixes have stated lengths, so the comparison is one equi-join on the cut labels.
    """
    cut = labels.select(F.col(label), F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n")).select(
        label, F.substring(F.col(label), F.lit(1), F.col("n")).alias(prefix), "n"
    ).filter(F.length(label) >= F.col("n"))
    hits = prefixes.withColumn("n", F.length(prefix)).join(cut, [prefix, "n"], "left").groupBy(prefix).agg(F.count(label).alias("hits"), F.min(label).alias("_l"))
    return hits.select(prefix, "hits", F.when(F.col("hits") == 1, F.col("_l")).alias(label))
