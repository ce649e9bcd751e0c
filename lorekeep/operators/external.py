"""Calls to outside services (completion, captioning, translation) as a cached, retried table operator.

The service is a plain function from prompt to text; none is built in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cached_calls(
    df: DataFrame,
    parts: list[str],
    call: Callable[[str], str],
    cache: DataFrame | None = None,
    fallback: Callable[[str], str] | None = None,
    valid: Callable[[str], bool] = bool,
    tries: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """(df with ``answer`` and ``error``, cache of (key, answer)).

    The key is the sha256 of the parts joined by U+001F.  Each different prompt
    that the cache lacks is asked once: up to ``tries`` times, then the fallback;
    answers that are not valid count as failures.  Failures are not cached.
    """
    key = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)
    asked = df.withColumn("_key", key).withColumn("_prompt", F.concat_ws("\n", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]))
    fresh = asked.select("_key", "_prompt").dropDuplicates(["_key"])
    if cache is not None:
        fresh = fresh.join(cache.select(F.col("key").alias("_key")), "_key", "left_anti")

    def attempt(prompt: str) -> tuple[str | None, str | None]:
        error = None
        for f in [call] * tries + ([fallback] if fallback else []):
            try:
                answer = f(prompt)
                if valid(answer):
                    return answer, None
                error = "invalid"
            except Exception as e:  # the service may raise anything; it becomes a row
                error = type(e).__name__
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [attempt(p) for p in pdf["_prompt"]]
            yield pd.DataFrame({"key": pdf["_key"], "answer": [a for a, _ in got], "error": [e for _, e in got]})

    # Asked once: the answers are kept in the shared checkpoint folder, or in memory where the session names none.
    answers = fresh.mapInPandas(run, "key string, answer string, error string")
    answers = answers.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else answers.persist()
    known = answers.select("key", "answer", "error")
    if cache is not None:
        known = known.unionByName(cache.select("key", "answer", F.lit(None).cast("string").alias("error")))
    out = asked.join(known.withColumnRenamed("key", "_key"), "_key", "left").drop("_key", "_prompt")
    return out, known.filter("answer IS NOT NULL").select("key", "answer")
