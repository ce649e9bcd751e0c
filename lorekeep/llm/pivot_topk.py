"""Exact top-k inner-product search over a pivot-distance index.

Vectors are turned into integers.  With M the largest norm, the extra component
sqrt(M^2 - |x|^2) for rows and 0 for queries makes the largest inner product the
least Euclidean distance: |q - x|^2 = |q|^2 + M^2 - 2 <q, x>.  Each row is keyed by
its nearest pivot and its distance to it; the table is range-partitioned and sorted
by that key and packed into chunks of rows, so that a chunk is an annulus [a, b]
around a pivot.  For a query at distance D from the pivot no row of the annulus is
nearer than max(0, D - b, a - D).

Queries are packed the same way into blocks that lie near each other.  A block
first meets the few chunks of least bound; its k-th best distances then decide which
other chunks it can need, before any of their rows are read.  Inside a chunk narrower
annuli are expanded nearest first, and a query skips those beyond its k-th distance.
Bounds have slack for rounding and keep ties; scores are exact integers.  Where
products may pass 2**53, doubles with an error bound choose the pairs whose scores
are computed in whole numbers of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

_ANNULUS = 512
_PACK_BYTES = 2 << 20
_NEAR = 4
_KEY_BYTES = 280  # holds any sum of products of doubles
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_NONE = np.iinfo(np.int64).min


def usable(vec: str) -> Column:
    """True for vectors without null or non-finite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<double>) of the usable vectors, whole numbers; shorter ones end in zeros."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable("e"))
    # The floor of a double as a double; from 2**53 on it is its own.
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    rows = rows.select("vec_id", F.transform("e", lambda x: whole(x * scale)).alias("v")).filter(usable("v"))
    d = rows.agg(F.max(F.size("v")).alias("d")).first()["d"] or 0
    zeros = F.array_repeat(F.lit(0.0), F.greatest(F.lit(max(d, 1)) - F.size("v"), F.lit(0)))
    return rows.select("vec_id", F.when(F.size("v") < max(d, 1), F.concat("v", zeros)).otherwise(F.col("v")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d2, 0))


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first rows of a lifted sample."""
    chosen = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(pivots, len(sample)):
        far = int(near.argmax())
        if near[far] == 0:
            break
        chosen.append(far)
        near = np.minimum(near, _distances(sample, sample[far : far + 1])[:, 0])
    return sample[chosen]


class Geometry:
    """Largest norm and pivots.  Distances are of vectors times 2**-shift, so that squares stay finite."""

    def __init__(self, largest: float, dims: int):
        self.shift = max(0, math.frexp(largest)[1] - 400)
        self.exact = dims * largest * largest < 2.0**53 if largest < 2.0**27 else False
        self.m2 = 0.0
        self.pivots = np.zeros((0, dims + 1))

    def scaled(self, v: np.ndarray) -> np.ndarray:
        return np.ldexp(v, -self.shift) if self.shift else v

    def lifted(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        x = self.scaled(v)
        top = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.m2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, top[:, None]])

    def best(self, ids: np.ndarray, q: np.ndarray, vec: np.ndarray, x: np.ndarray, k: int, least: list[int | None]):
        """(query row, vec_id, exact score) of pairs that can be among the k best, given scores ``least`` that are reached."""
        s = self.scaled(q) @ self.scaled(x).T
        if self.exact:
            floor = np.array([_NONE if z is None else z for z in least], dtype=np.float64)
            a, b = np.nonzero((s >= floor[:, None]) & (ids[:, None] != vec[None, :]))
            return a, vec[b], [int(z) for z in s[a, b]]
        norms = [np.sqrt((self.scaled(z) ** 2).sum(axis=1)) for z in (q, x)]
        err = (4 * q.shape[1] + 8) * 2.0**-53 * norms[0][:, None] * norms[1][None, :] + 1e-290
        low = np.where(ids[:, None] != vec[None, :], s - err, -np.inf)
        floor = np.array([-np.inf if z is None else _shifted(z, 2 * self.shift) for z in least])
        if low.shape[1] >= k:
            floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
        a, b = np.nonzero((s + err >= floor[:, None]) & (ids[:, None] != vec[None, :]))
        qs, xs = ([[int(z) for z in row] for row in m] for m in (q, x))
        return a, vec[b], [sum(y * z for y, z in zip(qs[i], xs[j])) for i, j in zip(a.tolist(), b.tolist())]


def _shifted(score: int, bits: int) -> float:
    """A double at most score * 2**-bits."""
    z = (score >> bits) - 1
    return float(z) - abs(float(z)) * 2.0**-52


def _reach(geometry: Geometry, norm2: np.ndarray, least: list[int | None]) -> np.ndarray:
    """Largest distance that still counts for each query, infinite where nothing is reached yet."""
    floor = np.array([-np.inf if z is None else _shifted(z, 2 * geometry.shift) for z in least])
    slack = 1e-6 * (1 + math.sqrt(geometry.m2) + np.sqrt(norm2))
    return np.sqrt(np.maximum(norm2 + geometry.m2 - 2.0 * floor, 0)) + slack


def _order_key(score: int) -> bytes:
    """Bytes that sort as the scores do, whatever their size."""
    return (score + (1 << (8 * _KEY_BYTES - 1))).to_bytes(_KEY_BYTES, "big")


_CHUNK = pa.schema([("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.binary()), ("dist", pa.binary()), ("v", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("key", pa.binary())])


class PivotIndex:
    """The chunked table and what the driver keeps of it: pivots, the largest norm, a bounded sample of rows."""

    def __init__(self, rows: DataFrame, pivots: int = 32, sample_rows: int = 1024, pack_rows: int = 4096):
        self.spark = rows.sparkSession
        top = rows.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("m"), F.max(F.size("v")).alias("d")).first()
        self.dims = top["d"] or 1
        self.geometry = g = Geometry(top["m"] or 0.0, self.dims)
        self.pack_rows = max(1, min(pack_rows, _PACK_BYTES // (8 * self.dims)))
        if g.shift:
            square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x * F.lit(2.0 ** -(g.shift // 2)) * F.lit(2.0 ** -(g.shift - g.shift // 2))) ** 2)
        else:
            square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        g.m2 = float(rows.agg(F.max(square).alias("m")).first()["m"] or 0.0) * (1 + 1e-12)
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample_rows).toArrow()
        self.sample_ids, self.sample = sample.column("vec_id").to_numpy(), _matrix(sample.column("v"))
        if len(self.sample):
            g.pivots = choose_pivots(g.lifted(self.sample), pivots)
        self.table = materialise(self._packed(self._keyed(rows, False)).withColumn("chunk", F.monotonically_increasing_id()), "pivot-index")

    def _keyed(self, rows: DataFrame, query: bool) -> DataFrame:
        """Rows sorted by nearest pivot and distance."""
        g = self.geometry
        fields = pa.schema([("pivot", pa.int32()), ("dist", pa.float64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))])

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = _distances(g.lifted(_matrix(batch.column(1)), query), g.pivots)
                    nearest = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nearest, pa.int32()), pa.array(d[np.arange(len(d)), nearest]), batch.column(0), batch.column(1).cast(pa.list_(pa.float64()))], schema=fields
                    )

        keyed = rows.select("vec_id", "v").mapInArrow(key, "pivot int, dist double, vec_id long, v array<double>")
        # Written first, so that sampling for the ranges does not key the rows twice.
        self.keyed = materialise(keyed, "pivot-keyed")
        return self.keyed.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")

    def _packed(self, keyed: DataFrame) -> DataFrame:
        """Sorted rows -> one row for each run of a pivot of at most ``pack_rows`` rows."""
        most = self.pack_rows

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def out() -> pa.RecordBatch:
                dist, ids, v = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
                pivot = held[0][0]
                held.clear()
                row = (pivot, float(dist.min()), float(dist.max()), ids.tobytes(), dist.tobytes(), v.tobytes())
                return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _CHUNK)], schema=_CHUNK)

            size = 0
            for batch in batches:
                pivot, dist, ids = (batch.column(i).to_numpy() for i in range(3))
                v = _matrix(batch.column(3))
                at = 0
                while at < len(ids):
                    if held and held[0][0] != pivot[at]:
                        yield out()
                        size = 0
                    end = min(len(ids), at + most - size)
                    end = at + int(np.argmax(np.append(pivot[at:end] != pivot[at], True)))
                    held.append((int(pivot[at]), dist[at:end], ids[at:end], v[at:end]))
                    size += end - at
                    at = end
                    if size == most:
                        yield out()
                        size = 0
            if held:
                yield out()

        return keyed.mapInArrow(pack, "pivot int, lo double, hi double, ids binary, dist binary, v binary")

    def _blocks(self, queries: DataFrame, k: int) -> DataFrame:
        """Packed queries with their distances to the pivots and what the sample rows reach."""
        g, sample_ids, sample, dims = self.geometry, self.sample_ids, self.sample, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    pivot, ids, v = (batch.column(c)[i].as_py() for c in (0, 3, 5))
                    q, qid = np.frombuffer(v).reshape(-1, dims), np.frombuffer(ids, dtype=np.int64)
                    at, _, scores = g.best(qid, q, sample_ids, sample, k, [None] * len(q))
                    tops: dict[int, list[int]] = {}
                    for a, s in zip(at.tolist(), scores):
                        tops.setdefault(a, []).append(s)
                    least = [sorted(tops[a])[-k] if len(tops.get(a, ())) >= k else None for a in range(len(q))]
                    yield _block(g, pivot, ids, v, q, least)

        return self._packed(self._keyed(queries, True)).mapInArrow(run, _BLOCK_STORED)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, rank, vec_id, score): the k best rows of another id for each query (vec_id, v)."""
        blocks = materialise(self._blocks(queries, k).withColumn("block", F.monotonically_increasing_id()), "pivot-queries")
        discard(self.keyed)
        bound = F.greatest(F.lit(0.0), F.get("near_q", F.col("pivot")) - F.col("hi"), F.col("lo") - F.get("far_q", F.col("pivot")))
        chunks = self.table
        # Bounds of all pairs of a block and a chunk, from their summaries alone.
        pairs = (
            blocks.drop("ids", "v", "least", "pivot").crossJoin(chunks.drop("ids", "dist", "v"))
            .select("block", "chunk", bound.alias("bound"), "reach").filter("bound <= reach")
        )
        order = Window.partitionBy("block").orderBy("bound", "chunk")
        near = pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= _NEAR)
        near = materialise(near.groupBy("block").agg(F.collect_list("chunk").alias("near")), "pivot-near")
        first = blocks.join(near, "block", "left").drop("pivot")
        seen = F.coalesce(F.array_contains("near", F.col("chunk")), F.lit(False))
        met = materialise(self._meet(first, chunks, seen, k), "pivot-first")
        # What the nearest chunks reached shrinks what is left to expand.
        tight = materialise(self._tightened(blocks, met, k).join(near, "block", "left").drop("pivot"), "pivot-tight")
        rest = self._meet(tight, chunks, ~seen & (bound <= F.col("reach")), k)
        found = met.select(*_FOUND.names).unionByName(rest.select(*_FOUND.names))
        order = Window.partitionBy("query_id").orderBy(F.desc("key"), F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def _tightened(self, blocks: DataFrame, met: DataFrame, k: int) -> DataFrame:
        """Blocks with the k-th scores of what their nearest chunks held."""
        g, dims = self.geometry, self.dims
        order = Window.partitionBy("query_id").orderBy(F.desc("key"), F.desc("score"), "vec_id")
        last = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
        # At most one row for each query of a block, so the list is as bounded as the block.
        lists = last.groupBy("block").agg(F.collect_list(F.struct("query_id", "score", "key")).alias("reached"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.schema.names
                for i in range(batch.num_rows):
                    block, pivot, ids, v, least, reached = (batch.column(names.index(c))[i].as_py() for c in ("block", "pivot", "ids", "v", "least", "reached"))
                    row = {int(z): n for n, z in enumerate(np.frombuffer(ids, dtype=np.int64))}
                    now = [None if z is None else int(z) for z in least]
                    for r in reached or ():
                        score = int.from_bytes(r["key"], "big") - (1 << (8 * _KEY_BYTES - 1)) if r["key"] else r["score"]
                        at = row[r["query_id"]]
                        now[at] = score if now[at] is None else max(now[at], score)
                    out = _block(g, pivot, ids, v, np.frombuffer(v).reshape(-1, dims), now)
                    yield out.append_column("block", pa.array([block], pa.int64()))

        both = blocks.join(lists, "block", "left").select("block", "pivot", "ids", "v", "least", "reached")
        return both.mapInArrow(run, f"{_BLOCK_STORED}, block long")

    def _meet(self, blocks: DataFrame, chunks: DataFrame, wanted: Column, k: int) -> DataFrame:
        """(block, query_id, vec_id, score, key) of the k best of every block and each chunk that ``wanted`` lets meet it.

        The queries are a stated set; pairs of packs that the bounds rule out are never read.
        """
        g, dims = self.geometry, self.dims
        left = blocks.select("block", F.col("ids").alias("qids"), F.col("v").alias("q"), "least", "reach", "near_q", "far_q", "near")
        pairs = left.join(chunks, wanted, "inner").select("block", "qids", "q", "least", "pivot", "ids", "dist", "v")
        schema = pa.schema([("block", pa.int64()), *_FOUND])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}  # block -> k-th scores so far in this task
            for batch in batches:
                for i in range(batch.num_rows):
                    block, qids, q, least, pivot, ids, dist, v = (c[i].as_py() for c in batch.columns)
                    q, qid = np.frombuffer(q).reshape(-1, dims), np.frombuffer(qids, dtype=np.int64)
                    if block not in held:
                        if len(held) >= 64:
                            held.clear()
                        held[block] = [None if z is None else int(z) for z in least]
                    tops = _scan(g, qid, q, held[block], pivot, np.frombuffer(ids, dtype=np.int64), np.frombuffer(dist), np.frombuffer(v).reshape(-1, dims), k)
                    if tops:
                        rows = [(block, int(qid[a]), c, max(_LEAST, min(_MOST, s)), b"" if g.exact else _order_key(s)) for a, best in tops.items() for s, c in best]
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        return pairs.mapInArrow(run, "block long, query_id long, vec_id long, score long, key binary")


_BLOCK = pa.schema([("pivot", pa.int32()), ("ids", pa.binary()), ("least", pa.list_(pa.string())), ("v", pa.binary()), ("reach", pa.float64()), ("near_q", pa.list_(pa.float64())), ("far_q", pa.list_(pa.float64()))])
_BLOCK_STORED = "pivot int, ids binary, least array<string>, v binary, reach double, near_q array<double>, far_q array<double>"


def _block(g: Geometry, pivot: int, ids: bytes, v: bytes, q: np.ndarray, least: list[int | None]) -> pa.RecordBatch:
    """A stored block of queries; scores are decimal strings, for they may be of any size."""
    away = _distances(g.lifted(q, True), g.pivots)
    reach = _reach(g, (g.scaled(q) ** 2).sum(axis=1), least)
    row = (pivot, ids, [None if z is None else str(z) for z in least], v, float(reach.max()), away.min(axis=0).tolist(), away.max(axis=0).tolist())
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)


def _scan(g: Geometry, ids: np.ndarray, q: np.ndarray, least: list, pivot: int, vec: np.ndarray, dist: np.ndarray, x: np.ndarray, k: int) -> dict[int, list[tuple[int, int]]]:
    """query row -> its best (score, vec_id) of a chunk, annuli expanded nearest first; raises ``least`` on the way."""
    norm2 = (g.scaled(q) ** 2).sum(axis=1)
    away = _distances(g.lifted(q, True), g.pivots[pivot : pivot + 1])[:, 0]
    reach = _reach(g, norm2, least)
    tops: dict[int, list[tuple[int, int]]] = {}
    annuli = [(lo, min(lo + _ANNULUS, len(vec))) for lo in range(0, len(vec), _ANNULUS)]
    bounds = [np.maximum(0, np.maximum(away - dist[lo:hi].max(), dist[lo:hi].min() - away)) for lo, hi in annuli]
    for n in np.argsort([float(b.mean()) for b in bounds], kind="stable"):
        (lo, hi), bound = annuli[n], bounds[n]
        live = np.flatnonzero(bound <= reach)
        if not len(live):
            continue
        rows = np.arange(lo, hi)
        if dist[lo] == dist[hi - 1]:  # equal vectors: only the k + 1 least ids can be among any k best
            _, group = np.unique(x[lo:hi], axis=0, return_inverse=True)
            order = np.lexsort((vec[lo:hi], group.ravel()))
            ordered = group.ravel()[order]
            rows = rows[order[np.arange(len(ordered)) - np.searchsorted(ordered, ordered) <= k]]
        at, cand, scores = g.best(ids[live], q[live], vec[rows], x[rows], k, [least[i] for i in live.tolist()])
        for a, c, s in zip(live[at].tolist(), cand.tolist(), scores):
            tops.setdefault(a, []).append((s, c))
        for a in set(live[at].tolist()):
            best = tops[a] = sorted(tops[a], key=lambda z: (-z[0], z[1]))[:k]
            if len(best) == k and (least[a] is None or best[-1][0] > least[a]):
                least[a] = best[-1][0]
        reach = _reach(g, norm2, least)
    return tops


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    scale: int = 256,
    query_modulus: int = 50,
    pivots: int = 32,
    pack_rows: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``query_modulus``.

    Null vectors, null or non-finite components (before or after scaling) and null
    ids take no part.  Vectors of different lengths meet as if the shorter ended in
    zeros.  Scores are ranked as whole numbers of any size; those beyond a long are
    given as the nearest long.  Ties go to the smaller id.  Rows that share an id
    are candidates of their own, never for a query of that id; of a repeated query
    id the least vector asks.  No rows, no results.
    """
    rows = materialise(quantised(vectors, id_col, vec_col, scale), "pivot-rows")
    index = PivotIndex(rows, pivots, pack_rows=pack_rows)
    discard(index.keyed)
    queries = rows.filter(F.pmod("vec_id", F.lit(query_modulus)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return index.search(queries, k)
