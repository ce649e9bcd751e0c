"""Sinks: blocks and alias indexes as JSON, rendered pages, word banks, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks_json(blocks: DataFrame, path: str) -> None:
    """One folder of JSON lines a source; blocks keep their order column."""
    blocks.write.mode("overwrite").partitionBy("source_id").json(path)


def alias_index(aliases: DataFrame, path: str) -> None:
    """(norm, id) as JSON lines ``{"norm", "ids"}``, ids sorted."""
    aliases.groupBy("norm").agg(F.sort_array(F.collect_set("id")).alias("ids")).write.mode("overwrite").json(path)


def word_bank(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").option("header", True).csv(path)


def append_log(lines: DataFrame, path: str) -> None:
    """Append (at, source_id, label, pages) as log lines."""
    label = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit("#"), "label")).otherwise(F.lit(""))
    at = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ssXXX")
    lines.select(F.concat(at, F.lit("  "), "source_id", label, F.lit("  pages: "), F.array_join("pages", ", ")).alias("value")).write.mode("append").text(path)


def changed_only(new: DataFrame, old: DataFrame, key: str, content: str) -> DataFrame:
    """Rows whose content differs from what is there: what an idempotent sink has to write."""
    there = old.select(F.col(key).alias("_k"), F.sha2(content, 256).alias("_h"))
    return new.join(there, F.col(key).eqNullSafe(F.col("_k")) & (F.sha2(content, 256) == F.col("_h")), "left_anti")


def content_addressed(assets: DataFrame, data: str, ext: str, digits: int = 12) -> DataFrame:
    """(sha256, file, copies): each content once, named by the shortest of ``digits``, ``2 * digits`` or all digits that is its own."""
    once = assets.groupBy(F.sha2(data, 256).alias("sha256")).agg(F.min(ext).alias("ext"), F.count("*").alias("copies"))
    sizes = [digits, 2 * digits]
    named = once
    for n in sizes:
        taken = once.groupBy(F.substring("sha256", 1, n).alias(f"p{n}")).agg(F.count("*").alias(f"n{n}"))
        named = named.withColumn(f"p{n}", F.substring("sha256", 1, n)).join(taken, f"p{n}")
    stem = F.col("sha256")
    for n in reversed(sizes):
        stem = F.when(F.col(f"n{n}") == 1, F.col(f"p{n}")).otherwise(stem)
    return named.select("sha256", F.concat(stem, F.lit("."), "ext").alias("file"), "copies")
