"""Rendered text: transcript lines, index pages, checklists, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock


def transcript_line(start_ms: Column, end_ms: Column, speaker: Column, text: Column) -> Column:
    """``[start-end] SPEAKER: text``; the start is rounded down and the end up."""
    who = F.when(F.coalesce(speaker, F.lit("")) != "", F.concat(speaker, F.lit(": "))).otherwise(F.lit(""))
    return F.concat(F.lit("["), clock(start_ms / 1000), F.lit("-"), clock(F.ceil(end_ms / 1000)), F.lit("] "), who, F.trim(text))


def index_page(df: DataFrame, keys: list[str], item: Column, name: str) -> DataFrame:
    """One bullet list for each group, items in order."""
    bullets = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.concat(F.lit("- [["), x, F.lit("]]")))
    return df.groupBy(*keys).agg(F.array_join(bullets, "\n").alias(name))


def checklist(sections: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """``- [x] label`` for labels in ``done``, ``- [ ] label`` for the rest."""
    marked = sections.join(done.select(key).distinct().withColumn("_d", F.lit(True)), key, "left")
    return marked.withColumn("line", F.concat(F.when(F.col("_d"), "- [x] ").otherwise("- [ ] "), F.col(key))).drop("_d")


def escape_card_headings(text: Column) -> Column:
    """A line that looks like a card heading is indented by one space."""
    return F.regexp_replace(text, r"(?m)^(## card [0-9]+[ \t]*)$", " $1")
