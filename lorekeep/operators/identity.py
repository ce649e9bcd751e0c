"""Content identity: duplicate groups, ordered hashes, supersession chains, identity cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(df: DataFrame, id_col: str, key: Column, key_name: str) -> DataFrame:
    """Rows whose key occurs more than once, with the canonical (least) id and the group's size.

    Groups are counted with partial aggregation and joined back, so that no group
    is gathered; a hot key is one skewed join key, which adaptive execution splits.
    """
    keyed = df.select(id_col, key.alias(key_name))
    groups = keyed.groupBy(key_name).agg(F.min(id_col).alias("canonical"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(groups, key_name)


def ordered_hash(df: DataFrame, keys: list[str], member: str, name: str) -> DataFrame:
    """Per group the number of members and the sha256 of the members in order, joined by newlines."""
    texts = F.transform(F.sort_array(F.collect_list(member)), lambda x: x.cast("string"))
    return df.groupBy(*keys).agg(F.count("*").alias("members"), F.sha2(F.array_join(texts, "\n"), 256).alias(name))


def supersession_heads(df: DataFrame, keys: list[str], id_col: str, order: str) -> DataFrame:
    """Each row with the id it supersedes (the one before it in its chain) and whether it is the chain's head."""
    w = Window.partitionBy(*keys).orderBy(order, id_col)
    return df.select(
        *keys, id_col, F.lag(id_col).over(w).alias("supersedes"), F.lead(id_col).over(w).isNull().alias("head")
    )


def identity_basis(candidates: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(basis, value) of the first candidate that is present; ``none`` and null if none is."""
    basis, value = F.lit("none"), F.lit(None).cast("string")
    for name, c in reversed(candidates):
        there = c.isNotNull() & (F.trim(c) != "")
        basis = F.when(there, F.lit(name)).otherwise(basis)
        value = F.when(there, F.trim(c)).otherwise(value)
    return basis, value


def chain_verdicts(df: DataFrame, id_col: str, supersedes: str, key: str) -> DataFrame:
    """(key, heads, dangling, verdict) of every identity's chain: ``ok`` with exactly one head and no dangling link."""
    ids = df.select(F.col(id_col).alias("_t")).distinct()
    linked = df.join(ids, df[supersedes] == F.col("_t"), "left")
    later = df.select(F.col(supersedes).alias("_s")).filter("_s IS NOT NULL").distinct()
    marked = linked.join(later, F.col(id_col) == F.col("_s"), "left")
    g = marked.groupBy(key).agg(
        F.count_if(F.col("_s").isNull()).alias("heads"),
        F.count_if(F.col(supersedes).isNotNull() & F.col("_t").isNull()).alias("dangling"),
        F.count_if(F.col(id_col) == F.col(supersedes)).alias("loops"),
    )
    verdict = F.when(F.col("dangling") + F.col("loops") > 0, "dangling").when(F.col("heads") == 1, "ok").when(F.col("heads") == 0, "cycle").otherwise("ambiguous")
    return g.select(key, "heads", "dangling", verdict.alias("verdict"))


def append_only(old: DataFrame, new: DataFrame, section: str, tag: str) -> DataFrame:
    """(section, tag, verdict): entries that went (``removed``) or came (``added``)."""
    a, b = old.select(section, tag).distinct(), new.select(section, tag).distinct()
    return a.exceptAll(b).withColumn("verdict", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("verdict", F.lit("added")))


def catalogue(df: DataFrame, id_col: str, order: Column, columns: dict[str, Column]) -> DataFrame:
    """One row of ``columns`` for each id that is neither null nor empty: that of the last row in ``order``."""
    known = df.filter(F.coalesce(F.col(id_col).cast("string"), F.lit("")) != "")
    last = known.groupBy(id_col).agg(F.max_by(F.struct(*[c.alias(n) for n, c in columns.items()]), order).alias("_last"))
    return last.select(id_col, "_last.*")
