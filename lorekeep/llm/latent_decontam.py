"""Benchmark decontamination by latent semantic retrieval.

Each text is split into words once and written as numbers of benchmark words.
Features are the rarer words of the benchmark; document frequencies are counted over
all documents.  TF-IDF rows are the benchmark items and passages of documents; all
words count for their norms.  A
distributed randomised SVD (range finder with power iterations over every passage of
every document, by way of the Gram matrix of the features, and all items) gives a
latent basis.  Every passage of every document is projected; items whose cosine with a passage reaches
``least_cosine`` are candidates.  A candidate counts if the longest common
subsequence of words with the text around the passage covers ``least_lcs`` of the
item, or, for paraphrases, if it covers ``paraphrase_lcs`` and the text also holds
the item's answer, its last words, as they stand.

No cosine decides what is missed: every place that holds an item's answer, and every
place that holds so many of its rarer words that the subsequence may reach
``least_lcs`` (an item's rarest half cannot be missing there), is a candidate too.
These two searches are exact for the rule above at any length of item; the cosine
is reported beside.

The benchmark goes out in blocks of at most ``items_per_block`` items; each block
is a pass over the documents.  What several passes find meets by id and text, so that
the number of blocks changes no result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, claim, discard, in_arrow, materialise, split_by_keys, utf8

_WORDS = re.compile(r"\w+").findall


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


@dataclass
class Items:
    ids: list[int]
    words: list[list[str]]
    vocabulary: dict[str, int]

    def coded(self) -> list[np.ndarray]:
        return [np.array([self.vocabulary[w] for w in ws], dtype=np.int64) for ws in self.words]


def _width(size: int) -> np.dtype:
    """How codes 0..size are stored."""
    return np.dtype("<u2" if size < 1 << 16 else "<i4")


def _coded(rows: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, h, text) -> (doc_id, h, codes binary): each word's number, the vocabulary's size for words outside."""
    shipped = rows.sparkSession.sparkContext.broadcast(vocabulary)
    fields = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = shipped.value.get, len(shipped.value)
        kind = _width(size)
        for batch in batches:
            for block in blocks(batch, "text", 2 << 20):
                codes = []
                for raw in block.column(2).to_pylist():
                    ws = words_of(raw.decode())
                    codes.append(np.fromiter(map(get, ws, repeat(size)), dtype=kind, count=len(ws)).tobytes())
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(codes, pa.binary())], schema=fields)

    return in_arrow(rows, run, "doc_id long, h long, codes binary")


def _flat(codes: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All words of a column of codes, and how many each document has."""
    raws = codes.to_pylist()
    lengths = np.array([len(x) // kind.itemsize for x in raws], dtype=np.int64)
    return np.frombuffer(b"".join(raws), dtype=kind).astype(np.int64), lengths


def _frequencies(coded: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Documents that hold each word, and the number of documents."""
    fields = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch, "codes", 1 << 19):
                flat, lengths = _flat(block.column(0), _width(size))
                held = np.unique(np.repeat(np.arange(len(lengths)), lengths) * (size + 1) + flat) % (size + 1)
                df += np.bincount(held, minlength=size + 1)
                df[size] += len(lengths) - np.count_nonzero(held == size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], schema=fields)

    rows = in_arrow(coded.select("codes"), run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1, dtype=np.int64)
    df[rows.column("word").to_numpy()] = rows.column("n").to_numpy()
    return df[:-1], int(df[-1])


def _document_frequency(docs: DataFrame, text_col: str, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """``_frequencies`` of plain texts."""
    rows = docs.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("h"), utf8(text_col).alias("text"))
    return _frequencies(_coded(rows, vocabulary), len(vocabulary))


def choose_features(items: Items, df: np.ndarray, idf: np.ndarray, most: float, energy: float = 0.8) -> np.ndarray:
    """Word -> feature number or -1: words of at most ``most`` documents, and of every item the rarest that carry ``energy`` of its squared norm."""
    keep = df <= most
    for ids in items.coded():
        own = np.unique(ids)
        own = own[np.argsort(df[own], kind="stable")]
        carried = np.cumsum(idf[own] ** 2)
        keep[own[: int(np.searchsorted(carried, energy * carried[-1])) + 1]] = True
    return np.where(keep, np.cumsum(keep) - 1, -1)


def _rows_times(coded: list[np.ndarray], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows times ``basis``; zero for rows without features."""
    out = np.zeros((len(coded), basis.shape[1]), dtype=np.float64)
    for i, ids in enumerate(coded):
        if len(ids):
            w, c = np.unique(ids, return_counts=True)
            x = c * idf[w]
            out[i] = (x / np.sqrt((x * x).sum())) @ basis[w]
    return out


def _gram_times(coded: list[np.ndarray], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A^T (A basis) of unit TF-IDF rows."""
    y = _rows_times(coded, idf, basis)
    out = np.zeros_like(basis, dtype=np.float64)
    for i, ids in enumerate(coded):
        if len(ids):
            w, c = np.unique(ids, return_counts=True)
            x = c * idf[w]
            out[w] += (x / np.sqrt((x * x).sum()))[:, None] * y[i][None, :]
    return out


#: Entries of the Gram matrix that a reducer holds dense, and those that a task gathers before it hands them on.
GRAM_BLOCK, GRAM_HELD = 1 << 18, 1 << 20


def _pair_sums(passage: np.ndarray, feature: np.ndarray, idf: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(f * features + g, sum of x_f x_g) over unit TF-IDF rows x of passages, given as (passage, feature) of each word; about ``most`` products at a time."""
    size = len(idf)
    key, count = np.unique(passage * size + feature, return_counts=True)
    passage, feature = np.divmod(key, size)
    first = np.flatnonzero(np.diff(passage, prepend=-1))
    x = count * idf[feature]
    n = np.diff(first, append=len(key))
    x /= np.repeat(np.sqrt(np.add.reduceat(x * x, first)), n)
    # Each word of a passage with all words of it.
    n, first = np.repeat(n, n), np.repeat(first, n)
    ends, lo = np.cumsum(n), 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - n[lo] + most, side="right")))
        k = n[lo:hi]
        a = np.repeat(np.arange(lo, hi), k)
        b = np.repeat(first[lo:hi] - np.cumsum(k) + k, k) + np.arange(len(a))
        yield _summed(feature[a] * size + feature[b], x[a] * x[b])
        lo = hi


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, weights=value, minlength=len(key))


def _gram(words: Iterator[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """(part, keys, sums) of the Gram matrix, in parts of so many rows, handed on beyond ``most`` entries; words: (passage, feature) of each word, by blocks of whole passages."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        key, value = held[0]
        part = key // (rows * len(idf))
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        ends = [*cuts[1:].tolist(), len(key)]
        inside = (key - part * (rows * len(idf))).astype(np.int32)
        slices = list(zip(cuts.tolist(), ends))
        return pa.RecordBatch.from_arrays(
            [pa.array(part[cuts], pa.int32()), pa.array([inside[a:b].tobytes() for a, b in slices], pa.binary()), pa.array([value[a:b].tobytes() for a, b in slices], pa.binary())],
            names=["part", "keys", "sums"],
        )

    for passage, feature in words:
        for sums in _pair_sums(passage, feature, idf) if len(passage) else ():
            held.append(sums)
            size += len(sums[0])
            if size > 2 * most:
                held = [_summed(*(np.concatenate(c) for c in zip(*held)))]
                size = len(held[0][0])
                if size > most:
                    yield out()
                    held, size = [], 0
    if held:
        held = [_summed(*(np.concatenate(c) for c in zip(*held)))]
        yield out()


def _dense(parts: DataFrame, features: int) -> DataFrame:
    """(part, keys, sums) -> (part, rows binary): whole rows of the Gram matrix as doubles."""
    rows = max(1, GRAM_BLOCK // features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = -1, np.zeros(rows * features)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "rows"])
        for batch in batches:
            for part, keys, sums in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    if at >= 0:
                        yield out()
                        total[:] = 0
                    at = part
                total[np.frombuffer(keys, dtype=np.int32)] += np.frombuffer(sums)
        if at >= 0:
            yield out()

    return in_arrow(parts.repartition("part").sortWithinPartitions("part"), run, "part int, rows binary")


def _passages_gram(coded: DataFrame, size: int, feature: np.ndarray, segment: int, idf: np.ndarray) -> DataFrame:
    """The Gram matrix of every passage (a segment and the next) of every document."""
    shipped, rows, most = coded.sparkSession.sparkContext.broadcast((np.append(feature, -1), idf)), max(1, GRAM_BLOCK // len(idf)), GRAM_HELD

    def words(batches: Iterator[pa.RecordBatch], of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for block in blocks(batch, "codes", 1 << 19):
                flat, lengths = _flat(block.column(0), _width(size))
                begin = np.cumsum(lengths) - lengths
                segments = -(-lengths // segment)
                inside = (np.arange(len(flat)) - np.repeat(begin, lengths)) // segment
                at = np.repeat(np.cumsum(segments) - segments, lengths) + inside
                f = of[flat]
                own, before = f >= 0, (f >= 0) & (inside > 0)
                yield np.concatenate([at[own], at[before] - 1]), np.concatenate([f[own], f[before]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, weights = shipped.value
        yield from _gram(words(batches, of), weights, rows, most)

    return materialise(_dense(in_arrow(coded.select("codes"), run, "part int, keys binary, sums binary"), len(idf)), "latent-gram")


def randomised_svd(passages: DataFrame, items: list[np.ndarray], idf: np.ndarray, rank: int, **options) -> np.ndarray:
    """(features, rank) right singular vectors of passages, given as (ids array<int>), stacked with the weighted items."""
    shipped, rows, most = passages.sparkSession.sparkContext.broadcast(idf), max(1, GRAM_BLOCK // len(idf)), GRAM_HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def words() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                ids = [np.array(x, dtype=np.int64) for x in batch.column(0).to_pylist()]
                yield np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.concatenate([np.zeros(0, np.int64), *ids])

        yield from _gram(words(), shipped.value, rows, most)

    gram = materialise(_dense(in_arrow(passages, run, "part int, keys binary, sums binary"), len(idf)), "latent-gram")
    return gram_svd(gram, items, idf, rank, **options)


def gram_svd(
    gram: DataFrame, items: list[np.ndarray], idf: np.ndarray, rank: int, oversample: int = 8, power: int = 2, seed: int = 7, item_weight: float = 50.0, corpus_weight: float = math.inf
) -> np.ndarray:
    """Leading eigenvectors of the passages' Gram matrix and the weighted items'; the passages weigh ``corpus_weight`` together at most.

    The products are formed where the matrix' rows are; the driver gets one matrix of
    (features, rank) a step.
    """
    size, rank = len(idf), min(rank, len(idf))
    rows = max(1, GRAM_BLOCK // size)
    basis = np.random.default_rng(seed).standard_normal((size, min(rank + oversample, size)))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.arange(part * rows, min((part + 1) * rows, size))
                yield pa.RecordBatch.from_arrays([pa.array([float(np.frombuffer(raw).reshape(rows, size)[own - part * rows, own].sum())])], names=["t"])

    # Rows are of unit length: the trace is the number of passages that hold a feature.
    found = in_arrow(gram, trace, "t double").agg(F.sum("t")).first()[0] or 0.0
    scale = min(1.0, corpus_weight / found) if found else 1.0
    for _ in range(power + 1):
        basis, _ = np.linalg.qr(basis)
        shipped = gram.sparkSession.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    g = np.frombuffer(raw).reshape(rows, size) @ shipped.value
                    at = np.flatnonzero(g.any(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(at + part * rows, pa.int32()), pa.array([g[i].tobytes() for i in at], pa.binary())], names=["f", "g"])

        g = item_weight * _gram_times(items, idf, basis)
        parts = in_arrow(gram, run, "f int, g binary").toArrow()
        for f, row in zip(parts.column("f").to_pylist(), parts.column("g").to_pylist()):
            g[f] += scale * np.frombuffer(row)
        # g = (A^T A) basis; its leading left singular vectors are those of A on the right.
        basis = g
    u, _, _ = np.linalg.svd(basis, full_matrices=False)
    return u[:, :rank]


def lcs_length(masks: dict, size: int, text: list) -> int:
    """Longest common subsequence of an item (bit masks of its words' places) with ``text``, bit-parallel."""
    every = (1 << size) - 1
    v = every
    for w in text:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & every
    return size - v.bit_count()


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` ids."""
    h = np.zeros(len(ids) - size + 1, dtype=np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - size + 1 + i].astype(np.uint64)
    return h


class Matcher:
    """What a task needs to judge documents against one block of items."""

    def __init__(self, items: Items, idf: np.ndarray, feature: np.ndarray, basis: np.ndarray, segment: int, least_cosine: float, least_lcs: float, paraphrase_lcs: float, answer_words: int):
        self.items, self.segment = items, segment
        self.least_cosine, self.least_lcs, self.paraphrase_lcs = least_cosine, least_lcs, paraphrase_lcs
        self.get, self.none = items.vocabulary.get, len(items.vocabulary)
        # Word -> row of the weighted latent vectors; words that are no feature share the last row, of zeros.
        self.row_of = np.append(feature, -1)
        self.row_of[self.row_of < 0] = feature.max() + 1
        self.rows = np.zeros((feature.max() + 2, basis.shape[1]), dtype=np.float32)
        self.rows[feature[feature >= 0]] = basis * idf[feature >= 0, None]
        # Every word counts for the norm; words outside the benchmark as much as a feature of median rarity.
        self.square = np.append(idf, np.median(idf[feature >= 0])).astype(np.float32) ** 2
        v = np.stack([self.rows[self.row_of[ids]].sum(axis=0) for ids in items.coded()])
        norm = np.sqrt(np.array([self.square[ids].sum() for ids in items.coded()]))
        self.latent = (v / norm[:, None]).astype(np.float32)
        self.masks = []
        for ids in items.coded():
            masks: dict[int, int] = {}
            for i, w in enumerate(ids.tolist()):
                masks[w] = masks.get(w, 0) | 1 << i
            self.masks.append(masks)
        self.answers = [self._spelled(ids[-answer_words:].tolist()) for ids in items.coded()]
        self._index(idf, answer_words)

    @staticmethod
    def _spelled(codes: list[int]) -> str:
        return " " + " ".join(map(str, codes)) + " "

    def _index(self, idf: np.ndarray, answer_words: int) -> None:
        """Rarer words -> items, and how many of them a region must hold; answers by hash."""
        coded, of_word = self.items.coded(), []
        self.least_events = np.zeros(len(coded), dtype=np.int64)
        for item, ids in enumerate(coded):
            size = len(ids)
            spare = size - math.ceil(self.least_lcs * size - 1e-9)
            rarer = ids[np.argsort(-idf[ids], kind="stable")][: min(size, max(spare + 1, (size + 1) // 2))]
            self.least_events[item] = len(rarer) - spare
            of_word.append(np.stack([rarer, np.full(len(rarer), item)]))
        word, item = np.concatenate(of_word, axis=1)
        self.post_item = item[np.argsort(word, kind="stable")]
        self.post_n = np.bincount(word, minlength=self.none + 1)
        self.post_start = np.cumsum(self.post_n) - self.post_n
        self.reach = 2 * self.segment + 2 * np.array([len(ids) for ids in coded])
        self.endings = []
        for n in sorted({min(len(ids), answer_words) for ids in coded}):
            mine = np.array([i for i, ids in enumerate(coded) if min(len(ids), answer_words) == n])
            h = _grams(np.concatenate([coded[i][-n:] for i in mine]), n)[::n]
            order = np.argsort(h, kind="stable")
            self.endings.append((n, h[order], mine[order]))

    def spans(self, flat: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, last word, item) of places that may satisfy the rule: answers, and enough of an item's rarer words within a region."""
        found = []
        n = self.post_n[flat]
        at = np.flatnonzero(n)
        n = n[at]
        word = np.repeat(at, n)
        item = self.post_item[np.repeat(self.post_start[flat[at]] - np.cumsum(n) + n, n) + np.arange(len(word))]
        key = doc[word] * len(self.least_events) + item
        order = np.argsort(key, kind="stable")
        key, word, item = key[order], word[order], item[order]
        last = np.arange(len(key)) + self.least_events[item] - 1
        inside = np.flatnonzero(last < len(key))
        last = last[inside]
        hit = (key[last] == key[inside]) & (word[last] - word[inside] < self.reach[item[inside]])
        found.append((word[inside][hit], word[last][hit], item[inside][hit]))
        for size, hashes, mine in self.endings:
            if len(flat) < size:
                continue
            h = _grams(flat, size)
            lo = np.searchsorted(hashes, h)
            at = np.flatnonzero((hashes[np.minimum(lo, len(hashes) - 1)] == h) & (doc[: len(h)] == doc[size - 1 :]))
            lo = lo[at]
            n = np.searchsorted(hashes, h[at], side="right") - lo
            item = mine[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            at = np.repeat(at, n)
            found.append((at, at + size - 1, item))
        return tuple(np.concatenate(c) for c in zip(*found))

    def candidates(self, docs: list[list[str]]) -> Iterator[tuple[int, int, int, float]]:
        """``coded_candidates`` of lists of words."""
        get, none = self.get, self.none
        return self.coded_candidates([np.fromiter(map(get, ws, repeat(none)), dtype=np.int64, count=len(ws)) for ws in docs])

    def coded_candidates(self, coded: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
        """(document, first segment, item, cosine) of passages of two successive segments: all of the exact search, and those near in cosine."""
        seg = self.segment
        starts, owner, first, at = [], [], [], 0
        for i, c in enumerate(coded):
            n = -(-len(c) // seg)
            starts.append(at + np.arange(n) * seg)
            owner.append(np.full(n, i))
            first.append(np.arange(n))
            at += len(c)
        flat = np.concatenate(coded) if coded else np.zeros(0, np.int64)
        if not len(flat):
            return
        starts, owner, first = np.concatenate(starts), np.concatenate(owner), np.concatenate(first)
        # Passages whose region, an item's length to both sides, holds the whole span.
        lengths = np.array([len(c) for c in coded])
        doc = np.repeat(np.arange(len(coded)), lengths)
        base, segments = np.cumsum(lengths) - lengths, -(-lengths // seg)
        seg_base = np.cumsum(segments) - segments
        exact: set[tuple[int, int]] = set()
        for d, p, q, item in zip(*(x.tolist() for x in self._placed(flat, doc, base))):
            size = len(self.items.words[item])
            lo, hi = max(0, -(-(q + 1 - size) // seg) - 2), min(int(segments[d]) - 1, (p + size) // seg)
            exact.update((int(seg_base[d]) + f, item) for f in range(lo, hi + 1))
        # Only features are gathered; a last row of zeros closes segments without any.
        rows, zero = self.row_of[flat], len(self.rows) - 1
        keep = rows != zero
        place = np.concatenate([[0], np.cumsum(keep)])[starts]
        used = np.append(rows[keep], zero)
        ends = np.append(place[1:], len(used) - 1)
        live = np.flatnonzero(ends > place)
        sums = np.zeros((len(starts), self.rows.shape[1]), dtype=np.float32)
        if not len(live):
            yield from ((int(owner[at]), int(first[at]), item, 0.0) for at, item in exact)
            return
        sums[live] = np.add.reduceat(self.rows[used], place[live], axis=0)
        squares = np.add.reduceat(self.square[flat], starts)
        joined = np.flatnonzero(owner[:-1] == owner[1:])
        passages, norm = sums.copy(), squares.copy()
        passages[joined] += sums[joined + 1]
        norm[joined] += squares[joined + 1]
        some = np.flatnonzero(np.bincount(np.concatenate([live, live[live > 0] - 1]), minlength=len(starts)))
        row = np.full(len(starts), -1)
        row[some] = np.arange(len(some))
        exact_owner, exact_first = owner, first
        passages, norm, owner, first = passages[some], np.sqrt(norm[some]), owner[some], first[some]
        passages /= np.maximum(norm, 1e-9)[:, None]
        for at, item in exact:
            cos = float(passages[row[at]] @ self.latent[item]) if row[at] >= 0 else 0.0
            if cos < self.least_cosine:
                yield int(exact_owner[at]), int(exact_first[at]), item, cos
        for lo in range(0, len(passages), 8192):
            cos = passages[lo : lo + 8192] @ self.latent.T
            a, b = np.nonzero(cos >= self.least_cosine)
            for p, item, c in zip((a + lo).tolist(), b.tolist(), cos[a, b].tolist()):
                yield int(owner[p]), int(first[p]), item, c

    def _placed(self, flat: np.ndarray, doc: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, first word, last word, item) of ``spans``, words counted in their document."""
        p, q, item = self.spans(flat, doc)
        return doc[p], p - base[doc[p]], q - base[doc[p]], item

    def judge(self, docs: list[np.ndarray]) -> list[dict[int, tuple[float, float]]]:
        """Per document: item -> (share of the item in the longest common subsequence, cosine) of contaminating items."""
        found: list[dict[int, tuple[float, float]]] = [{} for _ in docs]
        spots: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for doc, first, item, cos in self.coded_candidates(docs):
            spots.setdefault((doc, item), []).append((first, cos))
        for (doc, item), places in spots.items():
            words, size = docs[doc], len(self.items.words[item])
            masks, done, best = self.masks[item], -1, 0.0
            for first, cos in sorted(places):
                lo = max(0, first * self.segment - size, done)
                hi = min(len(words), (first + 2) * self.segment + size)
                if hi <= done or hi - lo < 1:
                    continue
                lo = max(0, first * self.segment - size)
                region = words[lo:hi].tolist()
                done = hi
                if sum(masks[w].bit_count() for w in masks.keys() & set(region)) < self.paraphrase_lcs * size:
                    continue
                share = lcs_length(masks, size, region) / size
                if share >= self.least_lcs or share >= self.paraphrase_lcs and self.answers[item] in self._spelled(region):
                    best = max(best, share)
                    found[doc][item] = (best, max(c for _, c in places))
        return found


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rank: int = 256,
    max_df: float = 0.05,
    segment: int = 16,
    least_cosine: float = 0.3,
    least_lcs: float = 0.75,
    paraphrase_lcs: float = 0.5,
    answer_words: int = 5,
    corpus_weight: float = 12_000,
    items_per_block: int = 1024,
) -> DataFrame:
    """(doc_id, h, contaminated, item_ids, lcs, cosine) of every document; repeated ids keep one row each.

    h is the text's xxhash64.  The basis is fitted on every passage of every document,
    which together weigh as ``corpus_weight`` passages at most, so that the items' share
    of it does not vanish in a large corpus; every passage is searched.  Null and empty texts are clean, as
    is everything if the benchmark is empty; items without words are ignored.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    listed = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("t"))
    n_items = listed.count()
    passes = max(1, -(-n_items // items_per_block))
    fields = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("contaminated", pa.bool_()), ("item_ids", pa.list_(pa.int64())), ("lcs", pa.float64()), ("cosine", pa.float64())])
    ddl = "doc_id long, h long, contaminated boolean, item_ids array<long>, lcs double, cosine double"
    clean = rows.select("doc_id", "h", F.lit(False).alias("contaminated"), F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("lcs"), F.lit(0.0).alias("cosine"))
    found = []
    for b in range(passes):
        got = listed.filter(F.pmod(F.xxhash64("item_id", "t"), F.lit(passes)) == b).orderBy("item_id", "t").collect()
        pairs = [(r["item_id"], words_of(r["t"])) for r in got]
        pairs = [(i, w) for i, w in pairs if w]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in pairs for w in ws))}
        items = Items([i for i, _ in pairs], [w for _, w in pairs], vocabulary)
        if pairs:
            size = len(vocabulary)
            coded = materialise(_coded(rows, vocabulary), "latent-codes")
            df, n = _frequencies(coded, size)
            idf = np.log((n + 1) / (df + 1)) + 0.05
            feature = choose_features(items, df, idf, max_df * n)
            gram = _passages_gram(coded, size, feature, segment, idf[feature >= 0])
            of_items = [feature[ids][feature[ids] >= 0] for ids in items.coded()]
            basis = gram_svd(gram, of_items, idf[feature >= 0], rank, corpus_weight=corpus_weight)
            discard(gram)
            matcher = Matcher(items, idf, feature, basis, segment, least_cosine, least_lcs, paraphrase_lcs, answer_words)
            del matcher.get  # a bound method does not travel
            shipped = spark.sparkContext.broadcast(matcher)

            def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
                claim("latent")
                m = shipped.value
                kind = _width(m.none)
                for batch in batches:
                    for block in blocks(batch, "codes", 80_000 * kind.itemsize):
                        found = m.judge([np.frombuffer(t, dtype=kind).astype(np.int64) for t in block.column(2).to_pylist()])
                        yield pa.RecordBatch.from_arrays(
                            [
                                block.column(0),
                                block.column(1),
                                pa.array([bool(f) for f in found]),
                                pa.array([sorted(m.items.ids[i] for i in f) for f in found], pa.list_(pa.int64())),
                                pa.array([max((x for x, _ in f.values()), default=0.0) for f in found]),
                                pa.array([max((c for _, c in f.values()), default=0.0) for f in found], pa.float64()),
                            ],
                            schema=fields,
                        )

            found.append(in_arrow(coded, run, ddl))
    if not found:
        return clean
    if passes == 1:
        return found[0]
    hits = found[0]
    for part in found[1:]:
        hits = hits.unionByName(part)
    hits = hits.filter("contaminated").select("doc_id", "h", F.explode("item_ids").alias("item"), "lcs", "cosine")
    hits = hits.groupBy("doc_id", "h").agg(F.collect_set("item").alias("items"), F.max("lcs").alias("l"), F.max("cosine").alias("c"))
    hits = materialise(hits.select(F.col("doc_id").alias("d"), F.col("h").alias("x"), F.array_sort("items").alias("items"), "l", "c"), "latent-hits")
    outside, inside = split_by_keys(clean, [F.col("doc_id"), F.col("h")], hits.select("d", "x"))
    joined = inside.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("x")), "left")
    hit = F.col("x").isNotNull()
    return outside.unionByName(
        joined.select("doc_id", "h", hit.alias("contaminated"), F.when(hit, F.col("items")).otherwise(F.col("item_ids")).alias("item_ids"), *[F.coalesce(b, a).alias(a) for a, b in (("lcs", "l"), ("cosine", "c"))])
    )


def _sample(rows: DataFrame, vocabulary: dict[str, int], width: int, sample_docs: int, sample_passages: int, n: int) -> DataFrame:
    """(ids array<int>) of coded passages of a bounded sample of documents, for trials of the search; ``decontaminate`` fits on all."""
    shipped = rows.sparkSession.sparkContext.broadcast(vocabulary)
    rate = int(min(1.0, sample_docs / max(n, 1)) * (1 << 30))
    fields = pa.schema([("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shipped.value.get
        for batch in batches:
            out = []
            for raw in batch.column(0).to_pylist():
                ws = words_of(raw.decode())
                count = -(-len(ws) // width)
                for p in range(0, count, max(1, count // sample_passages)):
                    ids = [get(w, -1) for w in ws[p * width : (p + 1) * width]]
                    out.append([i for i in ids if i >= 0])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], schema=fields)

    taken = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate).select("text")
    return materialise(in_arrow(taken, run, "ids array<int>"), "latent-sample")
