"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, PII redaction, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read back as the next stage's ``docs``; all but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.bpe_transducer import encode_documents
from lorekeep.llm.common import delete_path, materialise, relax_executors, scratch, ship, split_by_keys
from lorekeep.llm.kn_langid import accepted, fit
from lorekeep.llm.latent_decontam import decontaminate
from lorekeep.llm.pii_bootstrap import redact
from lorekeep.llm.simhash_tiles import near_copies

#: The stages have no counterpart in SQL; tests hold them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or far from every language's model."""
    ship(spark)
    return accepted(docs, fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of exact and near copies stays: that with the least id, null ids last.

    Groups are of texts, so rows that share an id but not the text are judged apart;
    of rows with equal id and text one stays.  Null texts count as empty.
    """
    ship(spark)
    relax_executors(spark)
    classes = materialise(near_copies(docs), "dedup-classes")
    gone = classes.filter("NOT stays").select(F.col("doc_id").alias("__stage_id"), F.col("h").alias("__stage_h")).distinct()
    gone = materialise(gone, "dedup-losers")
    again = classes.filter("stays").groupBy("doc_id", "h").count().filter("count > 1")
    again = materialise(again.select(F.col("doc_id").alias("__stage_id"), F.col("h").alias("__stage_h")), "dedup-repeated")
    kept = without(docs, gone)
    if again.isEmpty():
        return kept
    # Rows repeated with id and text: one of them, whichever comes first.
    clear, doubtful = split_by_keys(kept, named(), again)
    once = doubtful.withColumn("__stage_h", named()[1]).dropDuplicates(["doc_id", "__stage_h"]).drop("__stage_h")
    return clear.unionByName(once)


def named() -> list[Column]:
    """What names a row: its id and its text's hash; null texts count as empty."""
    return [F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))]


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows named by ``gone``; only rows that may be in that list meet it, the other texts are not shuffled."""
    doc_id, h = named()
    clear, doubtful = split_by_keys(docs, [doc_id, h], gone)
    same = doc_id.eqNullSafe(F.col("__stage_id")) & (h == F.col("__stage_h"))
    return clear.unionByName(doubtful.join(gone, same, "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or a paraphrase of one; rows that only share an id with one stay."""
    ship(spark)
    relax_executors(spark)
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("__stage_id"), F.col("h").alias("__stage_h")).distinct()
    return without(docs, materialise(bad, "leaks"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the text."""
    relax_executors(spark)
    out = redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in out.columns else out


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode to byte-level BPE ids and decode again: (doc_id, n_tokens, ids, ids_sha256, decoded_sha256)."""
    ship(spark)
    relax_executors(spark)
    # Smaller tables than alone: the executors' memory also holds what the earlier stages left in the JVM.
    return encode_documents(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, max_states=32_000, max_words=400_000
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii_redaction", pii),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return docs
