"""Ordered and interval operators: islands, coverage, overlap and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], ts: str, speaker: str, gap_seconds: float) -> DataFrame:
    """Number the runs of one speaker without a pause over ``gap_seconds``, from 0 in each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    secs = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    before = F.lag(ts).over(w)
    cut = F.when(before.isNull(), 0).when((F.lag(speaker).over(w) != F.col(speaker)) | (secs(F.col(ts)) - secs(before) > gap_seconds), 1).otherwise(0)
    return df.withColumn("_cut", cut).withColumn("island", F.sum("_cut").over(w)).drop("_cut")


def coverage(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, covered, gaps, first, last): length of the union of each group's intervals and the holes in it."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_reach", reach)
    new = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce("_reach", F.col(start))), F.lit(0))
    hole = F.col("_reach").isNotNull() & (F.col(start) > F.col("_reach"))
    return marked.groupBy(*keys).agg(
        F.sum(new).alias("covered"), F.count_if(hole).alias("gaps"), F.min(start).alias("first"), F.max(end).alias("last")
    )


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l_start: str, l_end: str, r_start: str, r_end: str, bucket: float) -> DataFrame:
    """Pairs of half-open intervals of a group that overlap, through equal buckets of length ``bucket``.

    Both sides are exploded to the buckets they touch; a pair is kept in the bucket
    where the later of the two starts, so that it comes out once.
    """
    slots = lambda s, e: F.sequence(F.floor(F.col(s) / bucket), F.floor((F.greatest(F.col(e), F.col(s))) / bucket))
    a = left.withColumn("_b", F.explode(slots(l_start, l_end)))
    b = right.withColumn("_b", F.explode(slots(r_start, r_end)))
    hit = a.join(b, [*keys, "_b"]).filter((F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end)))
    return hit.filter(F.col("_b") == F.floor(F.greatest(l_start, r_start) / bucket)).drop("_b")


def as_of(probes: DataFrame, facts: DataFrame, keys: list[str], at: str, ts: str, value: Column, name: str) -> DataFrame:
    """Each probe with the last fact at or before it in its group: one sort of both sides, no join."""
    rest = [c for c in probes.columns if c not in (*keys, at)]
    a = probes.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_p"), F.struct(*rest).alias("_rest"), F.lit(None).alias("_v"))
    b = facts.select(*keys, F.col(ts).alias("_t"), F.lit(0).alias("_p"), F.lit(None).alias("_rest"), F.struct(F.col(ts).alias("ts"), value.alias("v")).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t", "_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_p = 1")
    return both.select(*keys, F.col("_t").alias(at), "_rest.*", F.col("_last.v").alias(name), F.col("_last.ts").alias(f"{name}_ts"))
