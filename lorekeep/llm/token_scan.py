"""Token counts from flat token files by a scan for separators.

A token file is nothing but little-endian 16-bit ids, an end-of-document id after
each document; it has no index.  Files are read in blocks of equal size by any
number of tasks; in a block the separators are found by one vectorised comparison.
A document may begin in one block and end in a later one: an exclusive prefix scan
over the block summaries (separators so far, tokens since the last one) stitches
the counts and gives each separator its ordinal in the file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, materialise, scratch, utf8

_CODECS: dict[str, object] = {}


def _codec(rank_file: str, data: bytes, pattern: str):
    """tiktoken's encoder for a rank file, one a worker."""
    if rank_file not in _CODECS:
        import tiktoken

        from .bpe_transducer import parse_ranks

        _CODECS[rank_file] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=parse_ranks(data), special_tokens={})
    return _CODECS[rank_file]


def write_token_files(
    docs: DataFrame, rank_file: str, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text", roll_tokens: int = 1 << 24
) -> tuple[DataFrame, DataFrame]:
    """Encode whole texts into flat files in the shared folder.

    Returns (files, order): (file, tokens) and the (file, ordinal, doc_id) list of what was
    appended; both name only files of finished tasks.
    """
    spark = docs.sparkSession
    with open(rank_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    folder = scratch(spark, "tokens")
    fields = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        encode = _codec(rank_file, ranks.value, pattern).encode_ordinary
        out, name, ordinal, size = None, "", 0, 0
        for batch in batches:
            for block in blocks(batch, "text", 2 << 20):
                rows: list[tuple] = []
                for doc, raw in zip(block.column(0).to_pylist(), block.column(1).to_pylist()):
                    if out is None:
                        name, ordinal, size = f"{folder}/{uuid.uuid4().hex}.bin", 0, 0
                        out = fs.open_output_stream(f"{base}/{name.rsplit('/', 1)[1]}")
                    ids = np.array([*encode(raw.decode()), separator], dtype="<u2")
                    out.write(ids.tobytes())
                    rows.append((name, ordinal, doc, None))
                    ordinal, size = ordinal + 1, size + len(ids)
                    if size >= roll_tokens:
                        out.close()
                        rows.append((name, None, None, size))
                        out = None
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), fields)], schema=fields)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((name, None, None, size), fields)], schema=fields)

    said = materialise(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(
            run, "file string, ordinal long, doc_id long, tokens long"
        ),
        "token-order",
    )
    return said.filter("tokens IS NOT NULL").select("file", "tokens"), said.filter("ordinal IS NOT NULL").select("file", "ordinal", "doc_id")


def scan_block(ids: np.ndarray, separator: int) -> tuple[np.ndarray, int]:
    """(tokens before each separator since the one before or the block's start, tokens after the last)."""
    at = np.flatnonzero(ids == separator)
    return np.diff(at, prepend=-1) - 1, len(ids) - (int(at[-1]) + 1 if len(at) else 0)


def separator_scan(files: DataFrame, separator: int, block_tokens: int = 1 << 20) -> DataFrame:
    """(file, ordinal, n_tokens) of every document that a separator ends."""
    spans = files.select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)) - 1)).alias("block"))
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fields = pa.schema([("file", pa.string()), ("block", pa.int64()), ("counts", pa.list_(pa.int64())), ("tail", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, tokens, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                fs, path = pa.fs.FileSystem.from_uri(file)
                with fs.open_input_file(path) as f:
                    first = block * block_tokens
                    raw = f.read_at(2 * max(0, min(block_tokens, tokens - first)), 2 * first)
                counts, tail = scan_block(np.frombuffer(raw, dtype="<u2"), separator)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block]), pa.array([counts], pa.list_(pa.int64())), pa.array([tail])], schema=fields
                )

    found = materialise(spans.repartition(tasks, "file", "block").mapInArrow(run, "file string, block long, counts array<long>, tail long"), "token-blocks")
    # Exclusive prefix scan over the summaries of a file: separators before the block, and tokens since the last of them.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "block", F.size("counts").cast("long").alias("n"), "tail")
    scanned = summary.select(
        "file", "block", "tail", "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seps"),
        F.last(F.when(F.col("n") > 0, F.col("block")), ignorenulls=True).over(before).alias("last_cut"),
        F.coalesce(F.sum("tail").over(before), F.lit(0)).alias("tails"),
    )
    # Tokens carried in = tails of the blocks since the last one with a separator, that one included.
    at_cut = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = scanned.withColumn(
        "carry", F.col("tails") - F.coalesce(F.last(F.when(F.col("n") > 0, F.col("tails")), ignorenulls=True).over(at_cut), F.lit(0))
    ).select("file", "block", "seps", "carry")
    return (
        found.join(scanned, ["file", "block"])
        .select("file", "seps", "carry", F.posexplode("counts").alias("k", "inner"))
        .select("file", (F.col("seps") + F.col("k")).alias("ordinal"), (F.col("inner") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))
    )


def token_counts(
    docs: DataFrame, rank_file: str, pattern: str, separator: int = 50256, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 20
) -> DataFrame:
    """(doc_id, n_tokens) of every document, through flat token files.

    Null and empty texts have no tokens.  Repeated ids keep one row each; an empty
    table gives no rows; other columns are ignored.
    """
    files, order = write_token_files(docs, rank_file, pattern, separator, id_col, text_col)
    return separator_scan(files, separator, block_tokens).join(order, ["file", "ordinal"]).select("doc_id", "n_tokens")
