"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints are 64-bit majority votes over XXH64 hashes of word shingles.  Pairs
within ``radius`` differing bits are found exactly: the 64 bits are cut into
``blocks`` blocks, two fingerprints within the radius agree on at least
``blocks - radius`` of them, so every combination of that many blocks is a bucket
key.  Inside a bucket the distinct fingerprints, sorted by population count, are
compared tile against tile with numpy's exclusive-or and bit counts; tile pairs
whose population counts differ beyond the radius are skipped.  A tile pair leaves
a spanning forest of its links, never all pairs.

Buckets above ``tile_rows`` rows are cut into sub-tiles by population count and
hash, and the tile pairs are dealt to different tasks.

``near_copies``, the pipeline's near-dedup, takes the tiles' links as its first
candidates, confirms every link by the exact Jaccard similarity of word shingles and
adds the similar pairs whose fingerprints are further apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import accumulate, combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, discard, in_arrow, map_rows, materialise, skew_join, split_by_keys, utf8
from .components import components

SEED = 42
_VOTE_ROWS = 1 << 15


def simhash64(data: bytes, shingle: int = 3) -> int:
    """Fingerprint of UTF-8 text: A-Z lower-cased, words split at ASCII white space."""
    words = data.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return digest(joined, SEED)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return majority(np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts, starts[shingle:])], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    hashes = hashes.astype(">u8")
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _VOTE_ROWS):
        part = hashes[i : i + _VOTE_ROWS]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long; null and empty texts have fingerprint 0."""

    def kernel(cols):
        fps = np.array([simhash64(t, shingle) for t in cols["text"]], dtype=np.uint64)
        return {"doc_id": cols["doc_id"], "fp": fps.view(np.int64)}

    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    return map_rows(
        docs,
        [F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")],
        kernel,
        "doc_id long, fp long",
        schema,
        text="text",
    )


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of every combination of ``blocks - radius`` of the blocks that 64 bits are cut into."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << edges[i + 1]) - 1) & ~((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(single[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the pairs (a, b) into ``parent``, whose roots are the least index of each set."""
    while True:
        pa_, pb = parent[a], parent[b]
        differ = pa_ != pb
        if not differ.any():
            return parent
        np.minimum.at(parent, np.maximum(pa_, pb)[differ], np.minimum(pa_, pb)[differ])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def link_tiles(fps: np.ndarray, side: np.ndarray | None, radius: int, tile: int = 512) -> np.ndarray:
    """Union-find parents of ``fps`` (uint64) linked within ``radius`` bits.

    ``side``: None compares all; else only rows of side 0 with rows of side 1.
    """
    pop = np.bitwise_count(fps)
    order = np.argsort(pop, kind="stable")
    s, p = fps[order], pop[order].astype(np.int16)
    k = None if side is None else side[order]
    parent = np.arange(len(s))
    for i in range(0, len(s), tile):
        for j in range(i, len(s), tile):
            if p[j] - p[min(i + tile, len(s)) - 1] > radius:
                break
            near = np.bitwise_count(s[i : i + tile, None] ^ s[None, j : j + tile]) <= radius
            if k is not None:
                near &= k[i : i + tile, None] != k[None, j : j + tile]
            a, b = np.nonzero(near)
            if len(a):
                parent = _merge(parent, a + i, b + j)
    out = np.empty(len(s), dtype=np.int64)
    out[order] = order[parent]
    return out


def _links(radius: int):
    """Kernel over partitions sorted by (combo, key, pair): yields links between representatives."""

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def flush(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        fp = np.concatenate([r[0] for r in rows]).view(np.uint64)
        rep = np.concatenate([r[1] for r in rows])
        side = np.concatenate([r[2] for r in rows])
        if len(fp) < 2:
            return rep[:0], rep[:0]
        parent = link_tiles(fp, side if side.max() != side.min() else None if side[0] == 0 else side, radius)
        moved = parent != np.arange(len(parent))
        return rep[moved], rep[parent[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            combo, key, pair, fp, rep, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            if not len(fp):
                continue
            change = np.flatnonzero((np.diff(key) != 0) | (np.diff(combo) != 0) | (np.diff(pair) != 0)) + 1
            bounds = [0, *change.tolist(), len(fp)]
            a, b = [], []
            for lo, hi in zip(bounds, bounds[1:]):
                here = (combo[lo], key[lo], pair[lo])
                if here != last:
                    if len(held) > 1 or held and len(held[0][0]) > 1:
                        x, y = flush(held)
                        a.append(x)
                        b.append(y)
                    last, held = here, []
                held.append((fp[lo:hi], rep[lo:hi], side[lo:hi]))
            if sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)
        if held and sum(len(h[0]) for h in held) > 1:
            x, y = flush(held)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], schema=schema)

    return run


def links(distinct: DataFrame, radius: int = 3, blocks: int | None = None, tile_rows: int = 8192) -> DataFrame:
    """Spanning links (a, b) between the representatives of distinct fingerprints within ``radius`` bits.

    distinct: (fp long, rep long).  ``blocks`` defaults to one more than the
    radius for up to 2**24 fingerprints and one further block for every 2**8
    times as many, so that the mean bucket stays small.
    """
    if blocks is None:
        n, blocks = distinct.count(), radius + 1
        while n > 1 << 24 and blocks < radius + 4:
            blocks, n = blocks + 1, n >> 8
    masks = [_signed(m) for m in block_masks(radius, blocks)]
    rows = distinct.select(
        "fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("m")
    ).select("m.combo", "m.key", F.bit_count("fp").cast("int").alias("pop"), "fp", "rep")
    # Buckets above tile_rows: sub-tiles by population count and hash, every tile pair a task of its own.
    big = rows.groupBy("combo", "key").agg(F.count("*").alias("n")).filter(F.col("n") > tile_rows)
    tagged = rows.join(big, ["combo", "key"], "left")
    plain = tagged.filter("n IS NULL").select("combo", "key", F.lit(0).cast("long").alias("pair"), "fp", "rep", F.lit(0).alias("side"))
    hot = tagged.filter("n IS NOT NULL")
    tiles = hot.groupBy("combo", "key", "pop").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("s"))
    around = tiles.groupBy("combo", "key").agg(F.map_from_entries(F.collect_list(F.struct("pop", "s"))).alias("s_of"))
    placed = hot.join(around, ["combo", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.element_at("s_of", F.col("pop"))).cast("int"))
    others = F.flatten(
        F.transform(
            F.filter(F.sequence(F.col("pop") - radius, F.col("pop") + radius), lambda q: F.try_element_at("s_of", q).isNotNull()),
            lambda q: F.transform(
                F.sequence(F.lit(0), F.element_at("s_of", q) - 1), lambda j: F.struct(q.alias("q"), j.alias("j"))
            ),
        )
    )
    mine = F.col("pop").cast("long") * (1 << 24) + F.col("own")
    theirs = F.col("o.q").cast("long") * (1 << 24) + F.col("o.j")
    paired = (
        placed.select("combo", "key", "fp", "rep", "pop", "own", F.explode(others).alias("o"))
        .select("combo", "key", "fp", "rep", mine.alias("t"), theirs.alias("u"))
        .select(
            "combo", "key", F.xxhash64(F.least("t", "u"), F.greatest("t", "u")).alias("pair"), "fp", "rep",
            F.when(F.col("t") <= F.col("u"), 0).otherwise(1).alias("side"),
        )
    )
    dealt = plain.unionByName(paired).repartition("combo", "key", "pair").sortWithinPartitions("combo", "key", "pair", "side", "fp")
    return in_arrow(dealt, _links(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 3,
    blocks: int | None = None,
    tile_rows: int = 8192,
) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least id reachable over links of at most ``radius`` bits.

    Null and empty texts have fingerprint 0 and link like any other.  Repeated ids
    keep one row each; rows of null id get the least id of their class, null if it
    has none.  Empty input gives no rows; other columns are ignored.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    distinct = materialise(distinct, "simhash-distinct")
    edges = links(distinct.filter("rep IS NOT NULL").select("fp", "rep"), radius, blocks, tile_rows)
    labels = components(edges, "a", "b")
    # Only classes of more than one document need a lookup; the rest are their own component.
    classes = (
        distinct.join(labels, distinct["rep"] == labels["node"], "left")
        .filter((F.col("copies") > 1) | F.col("component").isNotNull())
        .select("fp", F.coalesce("component", "rep").alias("component"), F.lit(True).alias("found"))
    )
    return prints.join(classes, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("found"), F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _shingles(raw: bytes, shingle: int) -> list[bytes]:
    """Word shingles of UTF-8 text, as they come; texts of at most ``shingle`` words are one, texts without words have none."""
    words = raw.lower().split()
    if len(words) <= shingle:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return [joined[s : e - 1] for s, e in zip(starts, starts[shingle:])]


def _shingle_hashes(raw: bytes, shingle: int) -> np.ndarray:
    """Sorted different hashes of the shingles."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in _shingles(raw, shingle)], dtype=np.uint64))


def prefix_length(size: int, similarity: float) -> int:
    """So many first elements, in any common order, of sets of this size cannot all be missing from a set that similar."""
    return size - ceil(similarity * size - 1e-9) + 1 if size else 0


_ROWS = 1 << 16
_LEAST_BITS, _MOST_BITS = 1 << 10, 1 << 16


def parity_bits(hashes: np.ndarray) -> bytes:
    """A bitmap of a set: a bit is 1 if an odd number of its elements fall on it.

    An element in one of two sets alone changes one bit at most, so the bits that
    differ are never more than the elements that do.  It has two to four bits an
    element, within limits, and the halves' exclusive-or is the bitmap of half as many.
    """
    width = min(_MOST_BITS, max(_LEAST_BITS, 1 << (2 * len(hashes)).bit_length()))
    return np.packbits((np.bincount(hashes % np.uint64(width), minlength=width) & 1).astype(np.uint8)).tobytes()


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as a matrix of words of 64 bits, all of ``width`` bytes."""
    if len({len(b) for b in bits}) == 1:
        return np.bitwise_xor.reduce(np.frombuffer(b"".join(bits), dtype=np.uint64).reshape(len(bits), -1, width // 8), axis=1)
    out = np.zeros((len(bits), width // 8), dtype=np.uint64)
    for i, b in enumerate(bits):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(b, dtype=np.uint64).reshape(-1, width // 8), axis=0)
    return out


def most_apart(sizes, similarity: float):
    """So many elements at most are in one of two sets alone whose sizes add up to ``sizes`` and whose Jaccard similarity is that."""
    return (1 - similarity) / (1 + similarity) * sizes + 1e-6


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of whole runs of equal first values, of batches sorted by it, and the length of each run."""
    held: list[np.ndarray] | None = None

    def out(cols):
        edges = np.concatenate([[0], np.flatnonzero(np.diff(cols[0])) + 1, [len(cols[0])]])
        return cols, np.diff(edges)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = cols if held is None else [np.concatenate(c) for c in zip(held, cols)]
        change = np.flatnonzero(np.diff(cols[0]))
        if len(change):
            yield out([c[: change[-1] + 1] for c in cols])
            cols = [c[change[-1] + 1 :] for c in cols]
        held = cols
    if held is not None:
        yield out(held)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(similarity: float):
    """Kernel over (token, id, size, comp) sorted by token: pairs of a token, not of one component, whose sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, lengths in _whole_runs(batches):
            _, ids, size, comp = cols
            at = np.arange(len(ids))
            ends = np.repeat(np.cumsum(lengths), lengths)
            for step in range(1, int(lengths.max())):
                at = at[at + step < ends[at]]
                i, j = at, at + step
                near = (comp[i] != comp[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6)
                i, j = i[near], j[near]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], schema=_PAIR)

    return run


def _near_tiles(similarity: float, size, label, side, bits, settled: Callable[[slice, slice], bool], tile: int = 128) -> Iterator[tuple]:
    """(i, j, bits apart) of rows, in order of size, that are of different labels and may be that similar; a batch for a pair of tiles.

    Tiles are compared by exclusive-or and bit counts; tile pairs whose sizes, or
    whose numbers of bits, differ too much are skipped, and those that ``settled``
    says need no look.  Rows of side -1 meet each other, those of side 0 meet those
    of side 1.  The caller may change ``label`` between two batches.
    """
    # Bitmaps grow with the sizes; a tile is of one width.
    widths = np.array([len(b) for b in bits])
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(widths)) + 1, [len(bits)]]).tolist()
    edges = [slice(s, min(s + tile, hi)) for lo, hi in zip(cuts, cuts[1:]) for s in range(lo, hi, tile)]
    for n, x in enumerate(edges):
        mine = folded(bits[x], widths[x.start])
        for y in edges[n:]:
            i, j, largest = x.start, y.start, size[x][-1]
            if largest < similarity * size[j] - 1e-6:
                break
            if settled(x, y):
                continue
            both = size[x][:, None], size[y][None, :]
            near = np.minimum(*both) >= similarity * np.maximum(*both) - 1e-6
            near &= (label[x][:, None] != label[y][None, :]) & (side[x][:, None] + side[y][None, :] == np.where(side[x] < 0, -2, 1)[:, None])
            if i == j:
                near = np.triu(near)
            if not near.any():
                continue
            theirs = folded(bits[y], widths[i])
            count = [np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m in (mine, theirs)]
            reach = most_apart(largest + size[y][-1], similarity)
            if count[1].min() - count[0].max() > reach or count[0].min() - count[1].max() > reach:
                continue
            apart = np.zeros(near.shape, dtype=np.int64)
            for w in range(0, mine.shape[1], 16):
                apart += np.bitwise_count(mine[:, None, w : w + 16] ^ theirs[None, :, w : w + 16]).sum(axis=2, dtype=np.int64)
            near &= apart <= most_apart(size[x][:, None] + size[y][None, :], similarity)
            a, b = np.nonzero(near)
            if len(a):
                yield a + i, b + j, apart[a, b]


_MET = pa.schema([("id", pa.int64()), ("comp", pa.int64()), ("root", pa.int64())])


def _tiled(similarity: float):
    """Kernel over (cell, id, size, comp, side, bits) sorted by cell: the rows of a cell that may be that similar to one of another component.

    Each such row comes once, with a component to which a path of such pairs leads
    from its own: the pairs themselves grow with the square of a crowd.
    """

    def met(ids, size, comp, side, bits):
        order = np.argsort(size, kind="stable")
        ids, size, comp, side, bits = (c[order] for c in (ids, size, comp, side, bits))
        parent, found = np.arange(len(ids)), np.zeros(len(ids), dtype=bool)

        def settled(x, y):
            # All are known to be near another row, and lie together already.
            return bool(found[x].all() and found[y].all() and (parent[x] == parent[x.start]).all() and (parent[y] == parent[x.start]).all())

        for a, b, _ in _near_tiles(similarity, size, comp, side, bits, settled):
            found[a] = found[b] = True
            parent[:] = _merge(parent, a, b)
        return ids[found], comp[found], comp[parent[found]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, ids, size, comp, side, bits), lengths in _whole_runs(batches):
            ends, out = np.cumsum(lengths), []
            for lo, hi in zip((ends - lengths).tolist(), ends.tolist()):
                if comp[lo:hi].min() != comp[lo:hi].max():
                    out.append(met(ids[lo:hi], size[lo:hi].astype(np.int64), comp[lo:hi], side[lo:hi].astype(np.int64), bits[lo:hi]))
            if sum(len(o[0]) for o in out):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_MET)

    return run


def _linked(similarity: float, shingle: int):
    """Kernel over (cell, id, size, comp, side, bits, text) sorted by cell: links that join the components of a cell's rows.

    Pairs that the bitmaps allow are confirmed on the texts, nearest first; pairs of
    rows that are joined by then are passed over, so that a cell leaves fewer links
    than it has rows, and its components are those of all its pairs of that Jaccard similarity.
    """

    def links(ids, size, comp, side, bits, texts):
        order = np.argsort(size, kind="stable")
        ids, size, comp, side, bits, texts = (c[order] for c in (ids, size, comp, side, bits, texts))
        _, first, which = np.unique(comp, return_index=True, return_inverse=True)
        parent, words, sets, out = first[which], {}, {}, []

        def of(i):
            if i not in sets:
                sets[i] = frozenset(words.setdefault(s, s) for s in _shingles(texts[i], shingle))
            return sets[i]

        for a, b, apart in _near_tiles(similarity, size, parent, side, bits, lambda x, y: False):
            nearest = np.argsort(apart, kind="stable")
            a, b = a[nearest], b[nearest]
            up, joined = {}, []
            for i, j, r, s in zip(a.tolist(), b.tolist(), parent[a].tolist(), parent[b].tolist()):
                while r in up:
                    r = up[r]
                while s in up:
                    s = up[s]
                if r == s:
                    continue
                common = len(of(i) & of(j))
                if common >= similarity * (len(of(i)) + len(of(j)) - common) - 1e-9:
                    up[max(r, s)] = min(r, s)
                    joined.append((i, j))
            if joined:
                i, j = np.array(joined).T
                parent[:] = _merge(parent, i, j)
                out.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, ids, size, comp, side, bits, texts), lengths in _whole_runs(batches):
            ends, out = np.cumsum(lengths), []
            for lo, hi in zip((ends - lengths).tolist(), ends.tolist()):
                if comp[lo:hi].min() != comp[lo:hi].max():
                    out += links(ids[lo:hi], size[lo:hi].astype(np.int64), comp[lo:hi], side[lo:hi].astype(np.int64), bits[lo:hi], texts[lo:hi])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_PAIR)

    return run


def _allowed(similarity: float):
    """Kernel over (a, b, sizes, bitmaps): pairs whose bitmaps allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for sx, sy, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                m = folded([x, y], min(len(x), len(y)))
                keep.append(int(np.bitwise_count(m[0] ^ m[1]).sum()) <= most_apart(sx + sy, similarity))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=_PAIR)

    return run


def _confirmed(similarity: float, shingle: int):
    """Kernel over (cell, a, b, text) sorted by cell, texts (of a, b null) first: pairs whose shingle sets have that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, {}
        for batch in batches:
            for block in blocks(batch, "text", 4 << 20):
                found = []
                for cell, x, y, raw in zip(*(block.column(i).to_pylist() for i in range(4))):
                    if cell != now:
                        now, sets = cell, {}
                    if y is None:
                        sets[x] = frozenset(_shingles(raw, shingle))
                        continue
                    s, t = sets[x], sets[y]
                    common = len(s & t)
                    if common >= similarity * (len(s) + len(t) - common) - 1e-9:
                        found.append((x, y))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=_PAIR)

    return run


def _common_shingles(texts: DataFrame, shingle: int, least_docs: int = 8192, part: int = 32, most: int = 1 << 18) -> np.ndarray:
    """Sorted hashes of shingles that are common in a sample of texts: they only go last in the order of prefixes."""
    rate = int(min(1.0, max(least_docs / max(texts.count(), 1), 1 / part)) * (1 << 30))

    def kernel(cols):
        found, n = np.unique(np.concatenate([_shingle_hashes(t, shingle) for t in cols["text"]]), return_counts=True)
        return {"token": found.view(np.int64), "n": n}

    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])
    taken = texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < rate)
    counts = map_rows(taken, [F.col("text")], kernel, "token long, n long", schema, text="text").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 2")
    return np.sort(counts.orderBy(F.desc("n"), "token").limit(most).toArrow().column("token").to_numpy().view(np.uint64))


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    least_tile: int = 8,
    leader_rounds: int = 1,
    radius: int = 3,
    tile_rows: int = 4096,
    part_shingles: int = 1 << 17,
) -> DataFrame:
    """(doc_id, h, component_id, stays) of every document: closure of the pairs whose sets of word shingles have a Jaccard similarity of ``similarity`` at least.

    Nothing is missed and nothing estimated.  Fingerprints within ``radius`` bits
    (``links``) are the first candidates.  Beyond them, sets that similar share one
    of their first elements in any common order (``prefix_length``), so the
    documents that meet under such a shingle are candidates.  The order is by hash,
    shingles that a sample found common last, so that they seldom are in a prefix.
    Where more than ``least_tile`` documents meet, they are first compared with one
    of them, ``leader_rounds`` times; then what is left of different components is
    compared in tiles of bitmaps (``_tiled``), ``tile_rows`` rows a task at most,
    which leave the rows that may be similar to others, not the pairs of them.
    Those rows meet once more with their texts, ``part_shingles`` shingles of a
    crowd at a time, and leave the links that join them (``_linked``).
    Candidates whose bitmaps are further apart than the similarity allows
    (``parity_bits``, ``most_apart``) are dropped, the others confirmed on their texts.

    Every distinct set is a node of its own, whatever the ids of its rows.  ``h``
    is the text's xxhash64, so that (doc_id, h) names a row's content; component_id
    is the least id of the component, null if no row of it has one; ``stays`` is
    true for the rows of one (doc_id, h) of each component: the least, null ids
    last.  Null and empty texts are copies of each other.  Rows repeated with id
    and text keep one row each.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(texts, shingle))

    def kernel(cols):
        last, keys, sizes, prefixes, prints, bits = common.value, [], [], [], [], []
        for raw in cols["text"]:
            h = _shingle_hashes(raw, shingle)
            keys.append(blake2b(h.tobytes(), digest_size=16).digest())
            sizes.append(len(h))
            prints.append(majority(h))
            bits.append(parity_bits(h))
            if len(last):
                late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
                h = np.concatenate([h[~late], h[late]])
            prefixes.append(h[: prefix_length(len(h), similarity)].view(np.int64))
        fps = np.array(prints, dtype=np.uint64).view(np.int64)
        return {"doc_id": cols["doc_id"], "h": cols["h"], "key": keys, "size": sizes, "fp": fps, "bits": bits, "prefix": prefixes}

    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("key", pa.binary()), ("size", pa.int32()), ("fp", pa.int64()), ("bits", pa.binary()), ("prefix", pa.list_(pa.int64()))])
    ddl = "doc_id long, h long, key binary, size int, fp long, bits binary, prefix array<long>"
    prints = materialise(map_rows(texts, [F.col("doc_id"), F.xxhash64("text").alias("h"), F.col("text")], kernel, ddl, schema, text="text"), "copies-prints")
    # Equal sets are one node; only its representative meets others.
    of_null = F.col("doc_id").isNull().alias("none")
    distinct = prints.groupBy("key").agg(
        F.min(F.struct(of_null, "doc_id", "h")).alias("rep"), F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in ("size", "fp", "bits", "prefix")]
    )
    distinct = materialise(distinct.withColumn("id", F.monotonically_increasing_id()), "copies-distinct")
    rows = materialise(prints.select("doc_id", "h", "key"), "copies-rows")
    discard(prints)
    tokens = distinct.select(F.explode("prefix").alias("token"), "id", "size")
    counts = materialise(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "copies-tokens")
    total = distinct.agg(F.sum(F.size("prefix")).alias("n")).first()["n"] or 0
    met = materialise(skew_join(tokens, counts, ["token"], "n", total, sieve=True), "copies-met")
    discard(counts)
    sketch = distinct.select("id", "size", "bits")

    def allowed(pairs: DataFrame) -> DataFrame:
        """Pairs whose bitmaps allow the similarity."""
        of = lambda n: sketch.select(F.col("id").alias(n), F.col("size").alias(f"s{n}"), F.col("bits").alias(f"x{n}"))
        return in_arrow(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb", "xa", "xb"), _allowed(similarity), "a long, b long")

    def worded(nodes: DataFrame) -> DataFrame:
        """``nodes``, whose columns d and x name rows of ``texts``, with their texts."""
        # Of rows repeated with id and text one is enough.
        own = texts.withColumn("h", F.xxhash64("text"))
        _, some = split_by_keys(own, [F.col("doc_id"), F.col("h")], nodes.select("d", "x"))
        some = some.groupBy("doc_id", "h").agg(F.any_value("text").alias("text"))
        return some.join(nodes, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("x"))).select(*nodes.columns, "text")

    def confirm(pairs: DataFrame) -> DataFrame:
        """Pairs that are as similar, from their texts.

        Ends are numbered so that those of a crowd lie together, and pairs of 64 by
        64 of them are a cell, in which each text is needed once.
        """
        pairs = materialise(pairs, "copies-pairs")
        ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("g"))
        ends = materialise(ends, "copies-grouped")
        numbered = ends.repartitionByRange("g", "a").sortWithinPartitions("g", "a").select(F.col("a").alias("id"), F.shiftright(F.monotonically_increasing_id(), 6).alias("chunk"))
        numbered = materialise(numbered.join(distinct.select("id", "rep.*"), "id").select("id", "chunk", F.col("doc_id").alias("d"), F.col("h").alias("x")), "copies-ends")
        some = materialise(worded(numbered).select("id", "text"), "copies-texts")
        chunk = lambda n: numbered.select(F.col("id").alias(n), F.col("chunk").alias(f"c{n}"))
        celled = pairs.join(chunk("a"), "a").join(chunk("b"), "b").select(F.xxhash64(F.least("ca", "cb"), F.greatest("ca", "cb")).alias("cell"), "a", "b")
        celled = materialise(celled, "copies-cells")
        members = celled.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct().join(some, "id")
        both = members.select("cell", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "text").unionByName(celled.withColumn("text", F.lit(None).cast("binary")))
        found = in_arrow(both.repartition("cell").sortWithinPartitions("cell", "b"), _confirmed(similarity, shingle), "a long, b long")
        found = materialise(found, "copies-links")
        discard(pairs, ends, numbered, some, celled)
        return found

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels, rows["id"] == labels["node"], "left").select("token", "id", "size", "n", F.coalesce("component", "id").alias("comp"))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def led(rows: DataFrame, seed: int) -> DataFrame:
        """Pairs of every row and the leader of its token, the least by a seeded hash."""
        leader = F.min(F.struct(F.xxhash64("id", F.lit(seed)), F.struct("id", "size", "comp"))).alias("l")
        leaders = materialise(rows.groupBy("token").agg(leader, F.count("*").alias("k")), "copies-leaders")
        both = skew_join(rows, leaders.select("token", "l.col2.*", "k").toDF("token", "b", "of", "bc", "k"), ["token"], "k", rows.count())
        fits = F.least("size", "of") >= similarity * F.greatest("size", "of") - 1e-6
        return ordered(both.filter((F.col("comp") != F.col("bc")) & fits).select(F.col("id").alias("a"), "b"))

    def tiles(rows: DataFrame) -> DataFrame:
        """(id, comp, root): rows that may be similar to one of another component; large tokens are cut into parts that meet pair by pair.

        Of tokens that the very same rows share (those of a common passage) one is
        enough; sets of rows are told apart by their size and 128 bits of hashes.
        """
        same = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
        mixed = rows.groupBy("token").agg(F.min("comp").alias("l"), F.max("comp").alias("m"), F.count("*").alias("k"), *same).filter("l <> m")
        mixed = mixed.groupBy("k", "x1", "x2").agg(F.min("token").alias("token")).select("token", "k")
        left = skew_join(rows, materialise(mixed, "copies-mixed"), ["token"], "k", rows.count(), sieve=True)
        parts = F.ceil(F.col("k") / tile_rows).cast("int")
        left = left.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        side = F.when(F.col("part") == F.col("other"), -1).when(F.col("part") < F.col("other"), 0).otherwise(1)
        cell = F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other"))
        cells = left.select(cell.alias("cell"), "id", "comp", side.alias("side")).join(sketch, "id").select("cell", "id", "size", "comp", "side", "bits")
        return in_arrow(cells.repartition("cell").sortWithinPartitions("cell"), _tiled(similarity), "id long, comp long, root long")

    def linked(cells: DataFrame) -> DataFrame:
        cells = cells.select("cell", "id", "size", "comp", "side", "bits", "text").repartition("cell").sortWithinPartitions("cell")
        return materialise(in_arrow(cells, _linked(similarity, shingle), "a long, b long"), "copies-links")

    def crowds(near: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``found`` with the links among ``near`` (``tiles``), and the labels then.

        Components that a path of allowed pairs joins are one crowd, so that every
        such pair lies in one.  Its rows are dealt to parts.  First each part is
        compared with itself, which joins most rows; then those that are still not
        of the crowd's largest component meet all of its parts.
        """
        groups = components(near, "comp", "root")
        nodes = near.select("id", "comp").distinct().join(groups, F.col("comp") == F.col("node")).select("id", "comp", F.col("component").alias("g"))
        nodes = materialise(nodes.join(distinct.select("id", "size", "bits", F.col("rep.doc_id").alias("d"), F.col("rep.h").alias("x")), "id"), "copies-crowd")
        members = materialise(worded(nodes).drop("d", "x"), "copies-members")
        n = members.count()
        in_parts = lambda shingles: F.ceil(shingles / part_shingles).cast("long")
        part = F.pmod(F.xxhash64("id"), "parts")
        parts = materialise(members.groupBy("g").agg(F.count("*").alias("k"), in_parts(F.sum("size")).alias("parts")), "copies-parts")
        cells = skew_join(members, parts, ["g"], "k", n).withColumn("cell", F.xxhash64("g", part)).withColumn("side", F.lit(-1))
        found = found.unionByName(linked(cells))
        labels = components(found, "a", "b")
        now = members.drop("comp").join(labels, F.col("id") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "id")).drop("node", "component")
        tally = now.groupBy("g", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("s")).groupBy("g")
        tally = tally.agg(F.sum("n").alias("k"), F.sum("s").alias("s"), F.count("*").alias("c"), F.max(F.struct("n", "comp", "s")).alias("most"))
        open_ = tally.filter((F.col("c") > 1) & (F.col("s") > part_shingles))
        open_ = materialise(open_.select("g", "k", in_parts(F.col("s")).alias("parts"), in_parts(F.col("s") - F.col("most.s")).alias("others"), F.col("most.comp").alias("main")), "copies-open")
        if not open_.isEmpty():
            rows = skew_join(now, open_, ["g"], "k", n)
            every = rows.withColumn("p", part).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1))).withColumn("side", F.lit(1))
            other = rows.filter("comp <> main").withColumn("q", F.pmod(F.xxhash64("id", F.lit(1)), "others"))
            other = other.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("side", F.lit(0))
            both = every.unionByName(other).withColumn("cell", F.xxhash64("g", "p", "q"))
            found = found.unionByName(linked(both))
            labels = components(found, "a", "b")
        discard(nodes, members, parts, open_)
        return found, labels

    near = links(distinct.groupBy("fp").agg(F.min("id").alias("rep")).select("fp", "rep"), radius)
    twins = distinct.select("id", F.min("id").over(Window.partitionBy("fp")).alias("first")).filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    plain = met.filter(F.col("n") <= least_tile).select("token", "id", "size", F.col("id").alias("comp"))
    pairs = in_arrow(plain.repartition("token").sortWithinPartitions("token"), _pairs(similarity), "a long, b long")
    found = confirm(allowed(ordered(near.unionByName(twins).unionByName(pairs))))
    labels = components(found, "a", "b")
    crowded = met.filter(F.col("n") > least_tile)
    if not crowded.isEmpty():
        for seed in range(leader_rounds):
            rows_now = materialise(labelled(crowded, labels), "copies-crowded")
            found = found.unionByName(confirm(allowed(led(rows_now, seed))))
            labels = components(found, "a", "b")
            discard(rows_now)
        rows_now = materialise(labelled(crowded, labels), "copies-crowded")
        near = materialise(tiles(rows_now), "copies-near")
        if not near.isEmpty():
            found, labels = crowds(near, found)
        discard(rows_now, near)
    # A node's component, and the least row of each component.
    nodes = distinct.join(labels, distinct["id"] == labels["node"], "left").select("key", "rep", "copies", F.coalesce("component", "id").alias("component"))
    nodes = materialise(nodes, "copies-nodes")
    best = nodes.groupBy("component").agg(F.min("rep").alias("best"), F.sum("copies").alias("n"), F.count("*").alias("k")).filter("n > 1")
    total = nodes.count()
    several = skew_join(nodes.select("key", "component", "copies"), materialise(best, "copies-best"), ["component"], "k", total)
    several = materialise(several.select("key", "best", "copies"), "copies-several")
    discard(distinct, met, nodes)
    n = rows.count()
    grouped = skew_join(rows, several, ["key"], "copies", n, sieve=True).select(
        "doc_id", "h", F.col("best.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h"))).alias("stays")
    )
    alone = rows.join(several.select("key"), "key", "left_anti").select("doc_id", "h", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return grouped.unionByName(alone)
