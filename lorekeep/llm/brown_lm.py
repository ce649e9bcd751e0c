"""Language-model scoring by Brown class-based n-grams.

P(w | previous) = P(class(w) | class(previous)) * P(w | class(w)), in log10.

Classes.  Exchange clustering moves each word of the head (the frequent words, at most
``head_words``) to the class that raises the likelihood of the class bigrams most.
The ``seed_words`` most frequent ones are exchanged first, in turn, on the driver; then
every word of the head, all at once: bigram counts of the whole training part lie in
shards of words, each task exchanges the words of its shards in turn against the class
counts of the round before, and a round that does not raise the likelihood ends it.
The number of classes grows with the root of the head.  All rarer words, known or
not, are one class, whose inner distribution follows leave-one-out counts: a training
token of a word seen c times counts for words seen c - 1 times, so words seen once
stand for unknown ones.

Scale.  The head is of bounded size and is broadcast; only tokens beyond it meet
the full vocabulary, in one join on the word, where by construction no key is
frequent.  Counts cover the whole training part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, in_arrow, materialise, utf8

#: The end token; no word holds a space.
END = b" "
#: Longer words are never of the head, so that its size has a bound in bytes.
HEAD_BYTES = 64
_FLUSH = 200_000
_FLUSH_TOKENS = 1 << 21
_SHARD_WORDS = 64


def tokens(raw: bytes) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space, then one end token."""
    words = raw.lower().split()
    words.append(END)
    return words


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, c long) over all rows, combined in the tasks before the shuffle."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for block in blocks(batch, "text", 2 << 20):
                for raw in block.column(0).to_pylist():
                    held.update(tokens(raw))
                if len(held) > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], schema=schema)
                    held = Counter()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], schema=schema)

    return docs.select(utf8(text_col).alias("text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def xlogx(a: np.ndarray) -> np.ndarray:
    return a * np.log(np.maximum(a, 1))


def likelihood(grid: np.ndarray) -> float:
    """The part of the log likelihood of class bigrams that classes change: sum N(c,d) log N(c,d) - sum N(c.) log N(c.) - sum N(.d) log N(.d)."""
    return float(xlogx(grid).sum() - xlogx(grid.sum(axis=1)).sum() - xlogx(grid.sum(axis=0)).sum())


def best_class(grid: np.ndarray, a: int, right: np.ndarray, left: np.ndarray, loop: float, classes: int) -> tuple[int, np.ndarray]:
    """(class, class counts after the move) of a word of class ``a``.

    right, left: how often it stands before and after words of each class, itself
    apart (``loop``).  Only the first ``classes`` may be chosen; ties keep the word
    where it is, if it may be there.
    """
    rest = grid.copy()  # without the word
    rest[a] -= right
    rest[:, a] -= left
    rest[a, a] -= loop
    # What other words send to it and get from it is in their classes' sums, whatever its class.
    rows, cols = rest.sum(axis=1) + left, rest.sum(axis=0) + right
    # Likelihood change of adding it to class k, for all k at once; only classes it meets change.
    r, f = np.flatnonzero(right), np.flatnonzero(left)
    gain = (xlogx(rest[:, r] + right[r]) - xlogx(rest[:, r])).sum(axis=1) + (xlogx(rest[f] + left[f, None]) - xlogx(rest[f])).sum(axis=0)
    own = rest.diagonal()
    gain += xlogx(own + right + left + loop) - xlogx(own + right) - xlogx(own + left) + xlogx(own)
    out_n, in_n = right.sum() + loop, left.sum() + loop
    gain -= xlogx(rows + out_n) - xlogx(rows) + xlogx(cols + in_n) - xlogx(cols)
    k = int(gain[:classes].argmax())
    if a < classes and gain[k] <= gain[a] + 1e-9:
        k = a
    rest[k] += right
    rest[:, k] += left
    rest[k, k] += loop
    return k, rest


def exchange(pairs: np.ndarray, clusters: int, rounds: int = 4) -> np.ndarray:
    """Class of each word from a square matrix of bigram counts, by exchange in turn; starts from words dealt round."""
    n = len(pairs)
    clusters = max(1, min(clusters, n))
    label = np.arange(n) % clusters
    onehot = np.eye(clusters)
    pairs = pairs.astype(np.float64)
    for _ in range(rounds):
        moved = False
        member = onehot[label]
        grid = member.T @ pairs @ member
        to_class, from_class = pairs @ member, pairs.T @ member
        for w in range(n):
            a, loop = label[w], pairs[w, w]
            right, left = to_class[w].copy(), from_class[w].copy()
            right[a] -= loop
            left[a] -= loop
            k, grid = best_class(grid, a, right, left, loop, clusters)
            if k != a:
                moved = True
                label[w] = k
                to_class[:, a] -= pairs[:, w]
                to_class[:, k] += pairs[:, w]
                from_class[:, a] -= pairs[w]
                from_class[:, k] += pairs[w]
        if not moved:
            break
    return label


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts; differences, byte by byte, compressed."""
    rows = np.concatenate([np.diff(keys, prepend=0), counts]).astype("<i8")
    return zstandard.ZstdCompressor(level=1).compress(rows.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()
    half = len(rows) // 2
    return np.cumsum(rows[:half]), rows[half:]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)


class Bigrams:
    """Counts of successive symbols, in shards of words: (shard, data) rows of keys (word * 2 + direction) * size + other.

    Symbols are the ids of the head and ``size - 1`` for every other word.  A row
    holds all that stands beside its words, to the right (direction 0) and left,
    which the size of the head bounds.
    """

    def __init__(self, docs: DataFrame, text_col: str, head: dict[bytes, int]):
        self.spark, self.size = docs.sparkSession, len(head) + 1
        size, shards = self.size, max(64, -(-(len(head) + 1) // _SHARD_WORDS))
        shipped = self.spark.sparkContext.broadcast(head)
        schema = pa.schema([("shard", pa.int32()), ("data", pa.binary())])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = shipped.value
            start, get, tail = ids[END], ids.get, size - 1
            held: list[np.ndarray] = []
            n = 0

            def out() -> Iterator[pa.RecordBatch]:
                a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                held.clear()
                for w, o, direction in ((a, b, 0), (b, a, 1)):
                    keys, counts = np.unique((w * 2 + direction) * size + o, return_counts=True)
                    shard = keys // (2 * size) % shards
                    order = np.argsort(shard, kind="stable")
                    keys, counts, shard = keys[order], counts[order], shard[order]
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]).tolist()
                    data = [_packed(keys[lo:hi], counts[lo:hi]) for lo, hi in zip(edges, edges[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]], pa.int32()), pa.array(data, pa.binary())], schema=schema)

            for batch in batches:
                for block in blocks(batch, "text", 2 << 20):
                    seq = [start]
                    for raw in block.column(0).to_pylist():
                        seq += [get(w, tail) for w in tokens(raw)]
                    s = np.array(seq, dtype=np.int64)
                    held.append((s[:-1], s[1:]))
                    n += len(s)
                    if n > _FLUSH_TOKENS:
                        yield from out()
                        n = 0
            if held:
                yield from out()

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, keys, counts, n = None, [], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([_packed(*_summed(keys, counts))], pa.binary())], schema=schema)

            for batch in batches:
                for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if shard != last:
                        if keys:
                            yield out()
                        last, keys, counts, n = shard, [], [], 0
                    k, c = _unpacked(data)
                    keys.append(k)
                    counts.append(c)
                    n += len(k)
                    if n > _FLUSH_TOKENS:
                        k, c = _summed(keys, counts)
                        keys, counts, n = [k], [c], 0
            if keys:
                yield out()

        parts = in_arrow(docs.select(utf8(text_col).alias("text")), count, "shard int, data binary")
        self.table = materialise(in_arrow(parts.repartition("shard").sortWithinPartitions("shard"), merge, "shard int, data binary"), "brown-bigrams")

    def grid(self, label: np.ndarray, classes: int, below: int | None = None) -> np.ndarray:
        """(classes, classes) counts of successive labels; only of symbols below ``below``, if given."""
        shipped, size = self.spark.sparkContext.broadcast(label), self.size
        schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = shipped.value.astype(np.int64)
            total = np.zeros(classes * classes, dtype=np.int64)
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    keys, n = _unpacked(data)
                    w, o = np.divmod(keys, size)
                    own = w % 2 == 0
                    w >>= 1
                    if below is not None:
                        own &= (w < below) & (o < below)
                    np.add.at(total, of[w[own]] * classes + of[o[own]], n[own])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=schema)

        found = in_arrow(self.table.select("data"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(classes * classes)
        out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
        return out.reshape(classes, classes)

    def moved(self, label: np.ndarray, grid: np.ndarray) -> np.ndarray:
        """Labels after one exchange of every word but the tail; words labelled as the tail get a class."""
        shipped, size = self.spark.sparkContext.broadcast((label, grid)), self.size
        schema = pa.schema([("word", pa.int32()), ("label", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, start = shipped.value
            of, classes = of.astype(np.int64), len(start)
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    keys, n = _unpacked(data)
                    side, o = np.divmod(keys, size)
                    words, local = np.unique(side >> 1, return_inverse=True)
                    beside = np.zeros((len(words), 2, classes))
                    np.add.at(beside, (local, side & 1, of[o]), n)
                    loops = np.zeros(len(words))
                    itself = (o == side >> 1) & (side & 1 == 0)
                    loops[local[itself]] = n[itself]
                    now, out = start.copy(), []
                    for i, w in enumerate(words.tolist()):
                        if w == size - 1:
                            continue
                        a, loop = int(of[w]), loops[i]
                        right, left = beside[i]
                        right[a] -= loop
                        left[a] -= loop
                        k, now = best_class(now, a, right, left, loop, classes - 1)
                        out.append((w, k))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in zip(*out)], schema=schema)

        found = in_arrow(self.table.select("data"), run, "word int, label int").toArrow()
        after = label.copy()
        after[found.column("word").to_numpy()] = found.column("label").to_numpy()
        return after


def cluster(bigrams: Bigrams, clusters: int, seed_words: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of every symbol, class counts): the tail's class is the last, ``clusters``."""
    m = min(seed_words, bigrams.size - 1)
    dense = bigrams.grid(np.minimum(np.arange(bigrams.size), m - 1), m, below=m)
    label = np.full(bigrams.size, clusters, dtype=np.int32)
    label[:m] = exchange(dense, clusters)
    grid = bigrams.grid(label, clusters + 1)
    if m < bigrams.size - 1:
        label = bigrams.moved(label, grid)
        grid = bigrams.grid(label, clusters + 1)
    for _ in range(rounds):
        then = bigrams.moved(label, grid)
        after = bigrams.grid(then, clusters + 1)
        if likelihood(after) <= likelihood(grid) + 1e-6:
            break
        label, grid = then, after
    return label, grid


@dataclass
class BrownModel:
    """head: word -> id; ids below ``tail`` are symbols of the head, ``tail`` is every other word."""

    head: dict[bytes, int]
    counts: np.ndarray  # of the head words
    symbol: np.ndarray  # head id -> its class, a row of the transition table
    transition: np.ndarray  # (classes + 1, classes + 1) log10; the last is the tail class
    emission: np.ndarray  # head id -> log10 P(word | class)
    train_tokens: int
    vocabulary: int
    tail_cut: int  # words counted fewer times are of the tail, as are those over HEAD_BYTES bytes
    tail_logs: list[float]  # by band, log10 P(word of count c | tail) = tail_logs[band(c)] + log10(max(c, 1))


def band(c: Column) -> Column:
    """Band of a count: itself below 16, then sixteenths of octaves."""
    return F.when(c < 16, c).otherwise(16 + F.floor(16 * F.log2(c / 16))).cast("int")


def _is_head(cut: int) -> Column:
    return (F.col("c") >= cut) & (F.octet_length("word") <= HEAD_BYTES)


def fit(
    train: DataFrame,
    text_col: str = "text",
    clusters: int | None = None,
    seed_words: int = 512,
    rounds: int = 3,
    head_words: int = 1 << 18,
    least_head_count: int = 6,
    prior: float = 20.0,
) -> tuple[BrownModel, DataFrame]:
    """(model, counts) of the training rows; counts is (word, c) over the whole vocabulary.

    ``clusters`` defaults to a quarter of the root of the head's size, 8 at least.
    Only the head (at most ``head_words`` words) and its classes, grids of classes
    or seed words and a histogram of bands reach the driver; all are of bounded size.
    """
    counts = materialise(count_words(train, text_col), "brown-counts")
    sizes = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    v, n = sizes["v"], sizes["n"] or 0
    # The least count, at the edge of a band, that leaves at most head_words words.
    ladder = counts.groupBy(band(F.col("c")).alias("b")).agg(F.count("*").alias("words"), F.min("c").alias("least")).collect()
    cut, total = None, 0
    for r in sorted(ladder, key=lambda r: -r["b"]):
        total += r["words"]
        if total > head_words or r["least"] < least_head_count:
            break
        cut = r["least"]
    end = counts.filter(F.col("word") == F.lit(END)).first()
    cut = max(least_head_count, cut) if cut else (1 << 62)
    in_head = _is_head(cut) & (F.col("word") != F.lit(END))
    top = counts.filter(in_head).toArrow()
    words, c = top.column("word").to_pylist(), top.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    words = [END, *(words[i] for i in order)]
    c = np.concatenate([[end["c"] if end else 0], c[order]]).astype(np.int64)
    head = {w: i for i, w in enumerate(words)}

    classes = min(len(words), clusters or max(8, round(len(words) ** 0.5 / 4)))
    label, joint = cluster(Bigrams(train, text_col, head), classes, seed_words, rounds)
    k = classes + 1
    share = (joint.sum(axis=0) + 0.5) / (joint.sum() + 0.5 * k)
    transition = np.log10((joint + prior * share[None, :]) / (joint.sum(axis=1, keepdims=True) + prior))

    symbol = label[:-1].astype(np.int64)
    weight = np.maximum(c, 1).astype(np.float64)
    emission = np.log10(weight / np.bincount(symbol, weights=weight, minlength=k)[symbol])

    # The tail: mass of each band from leave-one-out counts, shared within by count.
    tail = counts.filter(~_is_head(cut) & (F.col("word") != F.lit(END)))
    own = {r["b"]: r["s"] for r in tail.groupBy(band(F.col("c")).alias("b")).agg(F.sum("c").alias("s")).collect()}
    left = {r["b"]: r["s"] for r in tail.groupBy(band(F.col("c") - 1).alias("b")).agg(F.sum("c").alias("s")).collect()}
    own[0] = 1
    mass = {b: left.get(b, 0) + 1.0 for b in own}
    whole = sum(mass.values())
    logs = [float(np.log10(mass[b] / whole / own[b])) if b in own else -30.0 for b in range(max(own) + 1)]
    return BrownModel(head, c, symbol, transition, emission, int(n), int(v), int(cut), logs), counts


def score(
    docs: DataFrame,
    model: BrownModel,
    counts: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each whole text.

    Null and empty texts are the end token alone.  Repeated rows keep one row
    each.  Without training text every token is unknown and N and V are 0.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    denominator = float(model.train_tokens + 1 * (model.vocabulary + 1))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("h", pa.int64()), ("word", pa.binary()), ("m", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mod = shipped.value
        get, tail_row = mod.head.get, len(mod.transition) - 1
        rows = np.append(mod.symbol, tail_row)
        known = np.append(mod.counts > 0, False)
        base = np.append(np.log10((mod.counts + 1) / denominator), 0.0)
        emit = np.append(mod.emission, 0.0)
        k, steps = tail_row + 1, mod.transition.ravel()
        for batch in batches:
            for block in blocks(batch, "text", 1 << 20):
                out: list[list] = [[] for _ in schema]
                for doc, h, raw in zip(*(block.column(i).to_pylist() for i in range(3))):
                    words = tokens(raw)
                    ids = [get(w, -1) for w in words]
                    s = np.array(ids, dtype=np.int64)
                    r = rows[s]
                    path = np.concatenate([[rows[0]], r[:-1]]) * k + r
                    rest = Counter([w for w, i in zip(words, ids) if i < 0])
                    for col, x in zip(out, (doc, h, None, len(words), int(known[s].sum()), float(base[s].sum()), float(steps[path].sum() + emit[s].sum()))):
                        col.append(x)
                    for w, m in rest.items():
                        for col, x in zip(out, (doc, h, w, m, 0, 0.0, 0.0)):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("h"), "text"
    )
    parts = materialise(
        rows.mapInArrow(run, "doc_id long, h long, word binary, m long, known long, base double, score double"), "brown-parts"
    )
    own = parts.filter("word IS NULL").select("doc_id", "h", F.lit(1).alias("copies"), F.col("m").alias("n_tokens"), "known", "base", "score")
    logs = F.array(*[F.lit(x) for x in model.tail_logs])
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = (
        parts.filter("word IS NOT NULL")
        .select("doc_id", "h", "word", "m")
        .join(counts.filter(~_is_head(model.tail_cut)), "word", "left")
        .select(
            "doc_id",
            "h",
            F.lit(0).alias("copies"),
            F.lit(0).cast("long").alias("n_tokens"),
            F.when(c > 0, F.col("m")).otherwise(0).alias("known"),
            (F.col("m") * F.log10((c + 1) / F.lit(denominator))).alias("base"),
            (F.col("m") * (F.element_at(logs, band(c) + 1) + F.log10(F.greatest(c, F.lit(1))))).alias("score"),
        )
    )
    summed = (
        own.unionByName(rest)
        .groupBy("doc_id", "h")
        .agg(*[F.sum(x).alias(x) for x in ("copies", "n_tokens", "known", "base", "score")])
    )
    return summed.select(
        "doc_id",
        (F.col("n_tokens") / F.col("copies")).cast("long").alias("n_tokens"),
        (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
