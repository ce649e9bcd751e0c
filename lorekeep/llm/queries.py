"""The registered queries of this subpackage: ``opN_<name>`` over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kn_langid import fit, held_out, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out("doc_id", 3, 1)))
    return predict(docs, model).withColumn("held_out", held_out("doc_id", 3, 1))


def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivot_topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op3_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_bootstrap import KINDS, find, spelled

    found = find(table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        *[count(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)],
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_transducer import encode_documents

    return encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .latent_decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


def op6_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_radix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown_lm import fit, score
    from .kn_langid import held_out

    docs = table(spark, sf_dir, "documents")
    model, counts = fit(docs.filter(~held_out("doc_id", 7, 2)))
    return score(docs, model, counts).withColumn("held_out", held_out("doc_id", 7, 2))


def op8_warc_zst(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_zst import archive_pages, read_archives

    return read_archives(archive_pages(table(spark, sf_dir, "pages"))).drop("uri")


def op9_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_scan import token_counts

    return token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_tiles import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_pivot_topk": op2_pivot_topk,
    "op3_pii_bootstrap": op3_pii_bootstrap,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_latent_decontamination": op5_latent_decontamination,
    "op6_suffix_radix": op6_suffix_radix,
    "op7_brown_lm": op7_brown_lm,
    "op8_warc_zst": op8_warc_zst,
    "op9_token_scan": op9_token_scan,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {
    "op2_pivot_topk": """
WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (SELECT vec_id, list_resize(v, (SELECT max(len(v)) FROM w), CAST(0 AS DOUBLE)) AS v FROM w),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5
""",
    # Base32 of a SHA-1: five hexadecimal digits are four base32 digits.
    "op8_warc_zst": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1),
d AS (SELECT page_id, first, h, sha1(h) AS x FROM p JOIN f USING (h)),
n AS (SELECT *, list_transform(range(8), lambda j: CAST('0x' || substr(x, 5 * j + 1, 5) AS INTEGER)) AS chunks FROM d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((chunks[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM n
""",
}
