"""Search: postings, BM25, quotes located in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segment import top_per_group


def terms(c: str, pattern: str = "[a-z]+"):
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, term, tf)."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.explode(terms(text_col)).alias("term"))
    return words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, query_id: str, query_text: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query id, doc_id, score, rank) of the ``k`` best documents by BM25, scores to six places, ties to the smaller id.

    Only postings of query terms are scored; lengths are taken before that filter.
    """
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.size(terms(text_col)).alias("len")).filter("len > 0")
    whole = sizes.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    wanted = queries.select(F.col(query_id), F.explode(F.array_distinct(terms(query_text))).alias("term"))
    words = docs.select(F.col(id_col).alias("doc_id"), terms(text_col).alias("ws")).select("doc_id", F.size("ws").alias("len"), F.explode("ws").alias("term"))
    held = words.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    # Each posting is weighed once, before it meets the queries that ask for its term.
    parts = held.join(df, "term").crossJoin(F.broadcast(whole)).select("doc_id", "term", part.alias("part"))
    sums = parts.join(wanted, "term").groupBy(query_id, "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_per_group(sums, [query_id], [F.desc("score"), F.asc("doc_id")], k, rank="rank")


def quotes_in(quotes: DataFrame, quote_id: str, quote_text: str, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(quote, document, at, size): first exact place of each quote in each document that holds it.

    Candidates share the quote's rarest word (of those with the least document
    frequency the longest), so that no document is compared with every quote.
    """
    word = r"[^ \t\n\r\f\x0B]+"
    inner = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(word), F.lit(0)))
    # Words inside the quote stand whole in any document that holds it; the first and last may be cut.
    whole = F.regexp_extract_all(quote_text, F.lit(word), F.lit(0))
    core = F.array_distinct(F.slice(whole, 2, F.greatest(F.size(whole) - 2, F.lit(0))))
    asked = quotes.select(F.col(quote_id), F.col(quote_text).alias("_q"), F.explode(core).alias("w"))
    held = docs.select(F.col(id_col), F.explode(inner(text_col)).alias("w")).join(asked.select("w").distinct(), "w", "left_semi")
    df = held.groupBy("w").agg(F.count("*").alias("df"))
    key = top_per_group(asked.join(df, "w"), [quote_id], [F.asc("df"), F.desc(F.length("w")), F.asc("w")], 1)
    pairs = held.join(key.select(quote_id, "_q", "w"), "w").select(quote_id, "_q", id_col)
    short = quotes.filter(F.size(whole) <= 2).select(F.col(quote_id), F.col(quote_text).alias("_q"))
    texts = docs.select(F.col(id_col), F.col(text_col).alias("_t"))
    found = pairs.join(texts, id_col)
    # Quotes of one or two words have no inner word; they are a small, stated query set against all rows.
    found = found.unionByName(texts.join(short, F.contains("_t", "_q")).select(*found.columns))
    at = F.expr("locate(_q, _t)")
    return found.withColumn("at", at - 1).filter("at >= 0").select(quote_id, id_col, "at", F.length("_q").alias("size"))
