"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_OWNER: list[tuple[str, Callable[[], None]]] = []


def claim(owner: str, drop: Callable[[], None] = lambda: None) -> None:
    """Called by an operator in a Python worker: what the operator before it keeps over tasks is dropped.

    Workers outlive stages; without this the tables of one stage would stay beside those of the next.
    """
    if _OWNER and _OWNER[0][0] == owner:
        return
    if _OWNER:
        _OWNER.pop()[1]()
    _OWNER.append((owner, drop))


def relax() -> None:
    """Give what a finished task freed back to the system: idle workers stay beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def relax_executors(spark: SparkSession) -> None:
    """Let the executors' heaps shrink to what lives, between stages: what an earlier stage freed stays theirs else, beside the Python workers of the next.

    Some tasks for each core ask their JVM for a collection; one that gets none is only larger.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl) -> DataFrame:
    """``mapInArrow`` whose worker gives freed memory back at the end of each task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        relax()

    return df.mapInArrow(wrapped, ddl)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per application.

    Where the session does not say how large Arrow batches are, they are bounded by
    bytes: ten thousand long texts at once would fill an executor beside its heap.
    """
    sc = spark.sparkContext
    if not any(k in spark.conf.getAll for k in _BATCHES):
        for k, v in _BATCHES.items():
            spark.conf.set(k, v)
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="lorekeep-"), "lorekeep_ship.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local master (tests, a laptop) gets a temporary
    one; on a cluster that is an error, because executors would not see it.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lorekeep-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else "file://" + os.path.abspath(base)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lorekeep/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` made, once everything computed from them is written."""
    for table in tables:
        delete_path(table.sparkSession, table._scratch_path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder through Hadoop's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: A key is heavy if it holds more than this share of the rows, so that at most so many keys are.
HEAVY_KEYS = 256


def skew_join(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, total: int, sieve: bool = False) -> DataFrame:
    """Inner join of ``rows`` with unique ``keys``, of which column ``weight`` says how many rows hold them.

    Keys of more than ``total / HEAVY_KEYS`` rows, of which there are at most
    ``HEAVY_KEYS``, are broadcast; the others meet in a shuffle that no key
    dominates.  ``rows`` is read twice.  With ``sieve`` only rows that a bit table of
    the keys does not rule out are shuffled, which pays where most rows have no key.
    """
    heavy = F.col(weight) * HEAVY_KEYS > total
    hot = rows.join(F.broadcast(keys.filter(heavy)), on)
    light = keys.filter(~heavy)
    cold = split_by_keys(rows, [F.col(c) for c in on], light.select(*on))[1] if sieve else rows
    cold = cold.join(F.broadcast(keys.filter(heavy).select(*on)), on, "left_anti").join(light, on)
    return hot.unionByName(cold)


def utf8(column: str):
    """Text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def map_rows(
    df: DataFrame,
    columns: list,
    kernel: Callable[[dict[str, list]], dict[str, object]],
    schema: str,
    arrow_schema: pa.Schema,
    block_bytes: int = 4 << 20,
    text: str | None = None,
    owner: tuple[str, Callable[[], None]] | None = None,
) -> DataFrame:
    """Apply ``kernel`` to column dictionaries of Arrow blocks of at most ``block_bytes`` of ``text`` (one row at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(*(owner or (kernel.__module__,)))
        for batch in batches:
            for block in blocks(batch, text, block_bytes):
                out = kernel({n: block.column(i).to_pylist() for i, n in enumerate(block.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], f.type) for f in arrow_schema], schema=arrow_schema
                )

    return in_arrow(df.select(*columns), run, schema)


def blocks(batch: pa.RecordBatch, text: str | None, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``text`` column holds about ``block_bytes`` at most."""
    if text is None or not batch.num_rows:
        if batch.num_rows:
            yield batch
        return
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + block_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


#: Bits of the table that ``split_by_keys`` broadcasts: at most 2**18 rows of two longs.
_TABLE_BITS = 1 << 24


def split_by_keys(df: DataFrame, columns: list, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outside, inside): rows of ``df`` that certainly have no equal in ``keys``, and the few that may have.

    ``columns`` are the key expressions over ``df``; ``keys`` has as many columns, in
    that order.  Only a bit table of fixed size is broadcast, so that most rows need
    no shuffle for a later join with ``keys``; a full table only makes ``inside`` larger.
    """
    place = lambda cs: F.pmod(F.xxhash64(*cs), F.lit(_TABLE_BITS))
    bits = (
        keys.select(place([F.col(c) for c in keys.columns]).alias("p"))
        .select(F.shiftright("p", 6).alias("__word"), F.expr("shiftleft(1L, cast(p & 63 AS int))").alias("b"))
        .groupBy("__word")
        .agg(F.bit_or("b").alias("__bits"))
    )
    tagged = df.withColumn("__place", place(columns)).join(F.broadcast(bits), F.shiftright("__place", 6) == F.col("__word"), "left")
    hit = F.coalesce(F.expr("shiftright(__bits, cast(__place & 63 AS int)) & 1 = 1"), F.lit(False))
    return tagged.filter(~hit).select(*df.columns), tagged.filter(hit).select(*df.columns)
