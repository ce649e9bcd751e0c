"""Segmentation: lines, sections, sentences, citations, occurrence labels, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def lines(df: DataFrame, text_col: str) -> DataFrame:
    """Every line with its 1-based place; the text column is gone."""
    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.posexplode(F.split(text_col, "\n", -1)).alias("_p", "line")).select(*rest, "line", (F.col("_p") + 1).alias("ord"))


def carry_forward(df: DataFrame, keys: list[str], order: str, value: Column, name: str, default) -> DataFrame:
    """Last non-null ``value`` at or before each row of its group."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)).cast("long"))


def sentences(text_col: str) -> Column:
    """Array of runs that end in ``.``, ``!`` or ``?``; the pattern also takes an open end, so that no text is scanned twice."""
    runs = F.regexp_extract_all(text_col, F.lit(r"[^.!?]++(?:[.!?]++|\z)"), F.lit(0))
    return F.filter(runs, lambda x: x.rlike(r"[.!?]\z"))


def occurrence_labels(df: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """Equal labels of a group become ``label [occurrence i/n]`` in order."""
    group = Window.partitionBy(*keys, label)
    i, n = F.row_number().over(group.orderBy(order)), F.count("*").over(group)
    numbered = df.withColumn("_i", i).withColumn("_n", n)
    text = F.concat(F.col(label), F.lit(" [occurrence "), F.col("_i").cast("string"), F.lit("/"), F.col("_n").cast("string"), F.lit("]"))
    return numbered.withColumn(label, F.when(F.col("_n") > 1, text).otherwise(F.col(label))).drop("_i", "_n")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each group; the filter on the rank lets Spark cut groups before the shuffle."""
    out = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= k)
    return out.withColumnRenamed("_r", rank) if rank else out.drop("_r")


def citations(df: DataFrame, text_col: str) -> DataFrame:
    """One row for each source of each ``[src:id#anchor, ...]`` group, in order, anchors decoded."""
    rest = [c for c in df.columns if c != text_col]
    groups = F.regexp_extract_all(text_col, F.lit(r"\[src:([^\]]*)\]"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda p: F.regexp_replace(F.trim(p), r"(?i)^src:\s*", ""))))
    out = df.select(*rest, F.posexplode(parts).alias("ord", "part"))
    source = F.trim(F.substring_index("part", "#", 1))
    raw = F.when(F.instr("part", "#") > 0, F.trim(F.substring(F.col("part"), F.instr("part", "#") + 1, F.lit(1 << 30)))).otherwise(F.lit(""))
    out = out.select(*rest, "ord", source.alias("source_id"), raw.alias("raw_anchor"))
    return out.filter("source_id <> ''").withColumn("anchor", X.decode_anchor(F.col("raw_anchor")))


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Number the runs of equal ``value`` in each group, from 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(0))
    first = F.row_number().over(w) == 1
    return df.withColumn("_c", F.when(first, 0).otherwise(changed)).withColumn("run", F.sum("_c").over(w)).drop("_c")


def quote_places(text: str, quote: str, prefix: str) -> Column:
    """Array of (at, score): every place of the quote, overlapping ones too; 2 where the text before is the prefix, else 0.

    Places come from a look-ahead split, whose pieces end where the quote begins.
    """
    literal = f"concat('(?=\\\\Q', replace({quote}, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E)')"
    pieces = F.expr(f"split({text}, {literal}, -1)")
    ends = F.aggregate(
        F.transform(pieces, lambda p: F.length(p)),
        F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")),
        lambda acc, n: F.struct((acc["n"] + n).alias("n"), F.concat(acc["at"], F.array(acc["n"])).alias("at")),
        lambda acc: acc["at"],
    )
    size, before = F.length(F.col(quote)), F.length(F.col(prefix))
    hit = F.filter(ends, lambda a: F.substring(F.col(text), a + 1, size) == F.col(quote))
    same = lambda a: (a >= before) & (F.substring(F.col(text), a - before + 1, before) == F.col(prefix))
    return F.transform(hit, lambda a: F.struct(a.alias("at"), F.when(same(a), 2).otherwise(0).alias("score")))
