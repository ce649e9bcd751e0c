"""Exact removal of repeated byte windows by a depth-limited radix sort of suffixes.

A suffix matters only through its first ``window`` bytes; suffixes that are equal to
that depth are exactly the repeated windows.  The sort goes by most significant
digits, and only groups of two or more go on:

1. The first digit of a suffix is its window's anchor: the ``gram`` bytes of least
   hash in the window (the first of equals).  Equal windows have equal anchors at
   equal offsets, and successive windows share one, so a document is a short list
   of runs, each one row.  Anchors that occur once end here.
2. Runs with equal bytes are repeated as a whole; of each different run one
   representative goes on.
3. The windows of the representatives of one anchor are sorted by further digits of
   growing width to the full depth, many anchors at a time, in numpy.  Groups of
   two or more are repeated windows.

Anchors with more than ``hot_runs`` different runs (a passage in very many
contexts) do not meet in one task: their windows are dealt out one by one, by
their 128-bit hash, counted with partial aggregation and joined back.  Wherever
rows meet counts of their key, the few keys that hold a large share of the rows
are broadcast (``skew_join``).

The same sort runs at two depths: over bytes, whose repeated windows are removed,
and over words, each one item by its hash, whose repeated windows are reported.

Documents meet the rows found for them in a join that only documents pass which a
bit table of fixed size does not rule out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, materialise, skew_join, utf8

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SEGMENT = 1 << 19
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_POSITION = np.uint64((1 << 20) - 1)
_BITS = 1 << 26
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Depth:
    """A window of so many items, of which runs of ``gram`` are anchors; items are bytes, or words by hash."""

    unit: int  # 0: bytes, 1: words
    window: int
    gram: int

    @property
    def dtype(self):
        return np.uint64 if self.unit else np.uint8

    def items(self, raw: bytes) -> np.ndarray:
        if not self.unit:
            return np.frombuffer(raw, dtype=np.uint8)
        words = raw.split() if len(raw) <= _SEGMENT else (m.group() for m in _WORD.finditer(raw))
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        known = _POWERS[base] = (out[0], out[1])
    return known


class SliceHash:
    """64-bit hash of any slice of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray, base: int = _BASES[0]):
        p, self.inverse = _powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=self.sums[1:])

    def at(self, start: np.ndarray, width: int) -> np.ndarray:
        return _mix((self.sums[start + width] - self.sums[start]) * self.inverse[start])

    def all(self, width: int) -> np.ndarray:
        return _mix((self.sums[width:] - self.sums[:-width]) * self.inverse[: len(self.sums) - width])


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    pad = -len(x) % w
    rows = np.concatenate([x, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchor_runs(items: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows, anchor's offset from the first window) of each run."""
    parts = []
    for at in range(0, max(len(items) - window + 1, 0), _SEGMENT):
        h = SliceHash(items[at : at + _SEGMENT + window - 1]).all(gram)
        least = _sliding_min((h & ~_POSITION) | np.arange(len(h), dtype=np.uint64), window - gram + 1)
        change = np.flatnonzero(least[1:] != least[:-1]) + 1
        first = np.concatenate([[0], change])
        count = np.diff(np.concatenate([first, [len(least)]]))
        place = (least[first] & _POSITION).astype(np.int64)
        parts.append((h[place], first + at, count, place - first))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


def digits(window: int) -> list[int]:
    """Widths of the digits: 8, 8, 16, 32, ... to the full depth."""
    out, depth = [], 0
    while depth < window:
        out.append(min(max(8, depth), window - depth))
        depth += out[-1]
    return out


def repeated_windows(data: np.ndarray, starts: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """True for each window start whose window occurs at another start of its group."""
    hashed = SliceHash(data)
    live, g, depth = np.arange(len(starts)), group, 0
    for width in digits(window):
        if not len(live):
            break
        digit = hashed.at(starts[live] + depth, width)
        order = np.lexsort((digit, g))
        gs, ds = g[order], digit[order]
        fresh = np.concatenate([[True], (gs[1:] != gs[:-1]) | (ds[1:] != ds[:-1])])
        number = np.cumsum(fresh) - 1
        keep = np.bincount(number)[number] >= 2
        live, g, depth = live[order][keep], number[keep], depth + width
    out = np.zeros(len(starts), dtype=bool)
    out[live] = True
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("h"), "text"
    )


def _runs(docs: DataFrame, depths: list[Depth]) -> DataFrame:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("h", pa.int64()), ("unit", pa.int8()), ("start", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("anchor", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.blake2b
        for batch in batches:
            for block in blocks(batch, "text", 2 << 20):
                out: list[list] = [[] for _ in schema]
                for doc, h, raw in zip(*(block.column(i).to_pylist() for i in range(3))):
                    for d in depths:
                        items = d.items(raw)
                        if len(items) < d.window:
                            continue
                        anchor, first, count, off = anchor_runs(items, d.window, d.gram)
                        if d.unit:
                            anchor = ~anchor  # anchors of the depths are apart
                        data, size = (items.tobytes(), 8) if d.unit else (raw, 1)
                        ids = np.frombuffer(
                            b"".join([digest(data[s * size : (s + n + d.window - 1) * size], digest_size=16).digest() for s, n in zip(first.tolist(), count.tolist())]),
                            dtype=np.int64,
                        )
                        n = len(first)
                        for col, x in zip(out, (pa.array([doc] * n, pa.int64()), np.full(n, h), np.full(n, d.unit, np.int8), first, count, off, anchor.view(np.int64), ids[::2], ids[1::2])):
                            col.append(x)
                if out[0]:
                    cols = [pa.concat_arrays(out[0])]
                    cols += [pa.array(np.concatenate(x), f.type) for x, f in zip(out[1:], list(schema)[1:])]
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ddl = "doc_id long, h long, unit byte, start int, n int, off int, anchor long, r1 long, r2 long"
    return docs.mapInArrow(run, ddl)


def _bit_table(keys: DataFrame) -> np.ndarray:
    """Bit table of fixed size over (doc_id, h)."""
    place = F.pmod(F.xxhash64("doc_id", "h"), F.lit(_BITS))
    words = (
        keys.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id, h), {_BITS}) & 63 as int))").alias("bits"))
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    table = np.zeros(_BITS // 64, dtype=np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table


def _split(docs: DataFrame, table: np.ndarray, inside: bool, schema: str, fields: pa.Schema, kernel) -> DataFrame:
    """``kernel`` over the blocks of the documents that the bit table rules out, or (``inside``) does not."""
    shipped = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        for batch in batches:
            place = batch.column(3).to_numpy()
            hit = (bits[place >> 6] >> (place & 63)) & 1 == 1
            for block in blocks(batch.filter(pa.array(hit == inside)), "text", 2 << 20):
                yield pa.RecordBatch.from_arrays(kernel(block), schema=fields)

    place = F.pmod(F.xxhash64("doc_id", "h"), F.lit(_BITS))
    return docs.select("doc_id", "h", "text", place.alias("place")).mapInArrow(run, schema)


def _members(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, h, text) of the documents that the table does not rule out."""
    fields = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("text", pa.binary())])
    return _split(docs, table, True, "doc_id long, h long, text binary", fields, lambda b: [b.column(i) for i in range(3)])


def _cut_runs(members: DataFrame, wanted: DataFrame, depths: list[Depth]) -> DataFrame:
    """The items of the wanted runs: (unit, anchor, hot, copies, doc_id, h, start, off, data)."""
    lists = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("unit", "anchor", "hot", "copies", "start", "n", "off")).alias("runs"))
    # Rows repeated with id and text are one here; their runs are repeated as a whole.
    single = members.groupBy("doc_id", "h").agg(F.any_value("text").alias("text"))
    once = single.join(lists, (single["doc_id"].eqNullSafe(lists["doc_id"])) & (single["h"] == lists["h"])).select(
        single["doc_id"], single["h"], "text", "runs"
    )
    fields = pa.schema(
        [("unit", pa.int8()), ("anchor", pa.int64()), ("hot", pa.bool_()), ("copies", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("off", pa.int32()), ("data", pa.binary())]
    )
    of = {d.unit: d for d in depths}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", 1 << 20):
                out: list[list] = [[] for _ in fields]
                for doc, h, raw, runs in zip(*(block.column(i).to_pylist() for i in range(4))):
                    data: dict[int, bytes] = {}
                    for r in runs:
                        d, unit = of[r["unit"]], r["unit"]
                        if unit not in data:
                            data[unit] = d.items(raw).tobytes() if unit else raw
                        size = 8 if unit else 1
                        row = (unit, r["anchor"], r["hot"], r["copies"], doc, h, r["start"], r["off"], data[unit][r["start"] * size : (r["start"] + r["n"] + d.window - 1) * size])
                        for col, x in zip(out, row):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, fields)], schema=fields)

    return once.mapInArrow(run, "unit byte, anchor long, hot boolean, copies long, doc_id long, h long, start int, off int, data binary")


_SPANS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("unit", pa.int8()), ("start", pa.int32()), ("end", pa.int32())])
_SPANS_DDL = "doc_id long, h long, unit byte, start int, end int"


def _sort_anchor_groups(cut: DataFrame, depths: list[Depth]) -> DataFrame:
    """Spans of repeated windows in runs of one copy; anchors are whole in a partition."""

    of = {d.unit: d for d in depths}

    def work(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (anchor, copies, doc_id, h, start, off, data, unit), whole anchors of one unit."""
        depth = of[rows[0][7]]
        window = depth.window
        data = np.frombuffer(b"".join(r[6] for r in rows), dtype=depth.dtype)
        sizes = np.array([len(r[6]) for r in rows]) // data.itemsize
        counts = sizes - window + 1
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        row = np.repeat(np.arange(len(rows)), counts)
        inner = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        anchors = np.array([r[0] for r in rows])
        group = np.cumsum(np.concatenate([[0], anchors[1:] != anchors[:-1]]))
        offset = np.array([r[5] for r in rows])[row] - inner  # of the anchor in the window
        twice = repeated_windows(data, at[row] + inner, group[row] * (window + 1) + offset, window)
        twice &= np.array([r[1] for r in rows])[row] == 1
        hit = np.flatnonzero(twice)
        if not len(hit):
            return pa.RecordBatch.from_pylist([], schema=_SPANS)
        new = np.concatenate([[True], (np.diff(hit) > 1) | (row[hit[1:]] != row[hit[:-1]])])
        lo, hi = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
        start = np.array([r[4] for r in rows])[row[lo]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in row[lo]], pa.int64()),
                pa.array([rows[i][3] for i in row[lo]], pa.int64()),
                pa.array([depth.unit] * len(lo), pa.int8()),
                pa.array(start + inner[lo], pa.int32()),
                pa.array(start + inner[hi] + window, pa.int32()),
            ],
            schema=_SPANS,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if held and (r[7] != held[-1][7] or size > 1 << 20 and r[0] != held[-1][0]):
                    yield work(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield work(held)

    dealt = cut.select("anchor", "copies", "doc_id", "h", "start", "off", "data", "unit").repartition("anchor").sortWithinPartitions("unit", "anchor", "off")
    return dealt.mapInArrow(run, _SPANS_DDL)


def _deal_hot_windows(cut: DataFrame, depths: list[Depth]) -> DataFrame:
    """Spans of repeated windows of hot anchors, window by window."""
    fields = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("copies", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("unit", pa.int8()), ("start", pa.int32())])
    of = {d.unit: d for d in depths}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "data", 1 << 17):
                for copies, doc, h, unit, start, raw in zip(*(block.column(i).to_pylist() for i in range(6))):
                    data = np.frombuffer(raw, dtype=of[unit].dtype)
                    n = len(data) - of[unit].window + 1
                    w1, w2 = (SliceHash(data, b).all(of[unit].window).view(np.int64) for b in _BASES)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w1), pa.array(w2), pa.array([copies] * n), pa.array([doc] * n, pa.int64()), pa.array([h] * n, pa.int64()), pa.array([unit] * n, pa.int8()), pa.array(np.arange(start, start + n, dtype=np.int32))],
                        schema=fields,
                    )

    windows = cut.select("copies", "doc_id", "h", "unit", "start", "data").mapInArrow(run, "w1 long, w2 long, copies long, doc_id long, h long, unit byte, start int")
    counts = materialise(windows.groupBy("unit", "w1", "w2").agg(F.count("*").alias("times")).filter("times > 1"), "radix-windows")
    total = counts.agg(F.sum("times").alias("n")).first()["n"] or 0
    size = F.lit(0)
    for d in depths:
        size = F.when(F.col("unit") == d.unit, d.window).otherwise(size)
    return skew_join(windows.filter("copies = 1"), counts, ["unit", "w1", "w2"], "times", total).select(
        "doc_id", "h", "unit", "start", (F.col("start") + size).cast("int").alias("end")
    )


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals; touching ones become one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def repeated_spans(docs: DataFrame, depths: list[Depth], id_col: str = "doc_id", text_col: str = "text", hot_runs: int = 4096) -> DataFrame:
    """(doc_id, h, unit, start, end): spans of items whose union is every item of a repeated window; h is the text's hash."""
    keyed = _keyed(docs, id_col, text_col)
    runs = materialise(_runs(keyed, depths), "radix-runs")
    stats = runs.groupBy("anchor").agg(
        F.count("*").alias("times"), *[f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in ("r1", "r2")]
    )
    stats = stats.filter("times > 1").select("anchor", "times", ((F.col("minr1") == F.col("maxr1")) & (F.col("minr2") == F.col("maxr2"))).alias("alike"))
    stats = materialise(stats, "radix-anchors")
    total = runs.count()
    again = materialise(skew_join(runs, stats, ["anchor"], "times", total, sieve=True).drop("times"), "radix-again")
    discard(runs, stats)
    window = F.lit(0)
    for d in depths:
        window = F.when(F.col("unit") == d.unit, d.window).otherwise(window)
    whole = lambda df: df.select("doc_id", "h", "unit", "start", (F.col("start") + F.col("n") + window - 1).cast("int").alias("end"))
    mixed = again.filter("NOT alike")
    kinds = mixed.groupBy("anchor", "r1", "r2").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "h", "unit", "start", "n", "off")).alias("rep")
    )
    kinds = materialise(kinds, "radix-kinds")
    copied = skew_join(mixed, kinds.filter("copies > 1").select("anchor", "r1", "r2", "copies"), ["anchor", "r1", "r2"], "copies", total)
    hot = kinds.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > hot_runs).select("anchor", "k")
    marked = skew_join(kinds, hot, ["anchor"], "k", total).drop("k").withColumn("hot", F.lit(True))
    marked = marked.unionByName(kinds.join(hot.select("anchor"), "anchor", "left_anti").withColumn("hot", F.lit(False)))
    wanted = materialise(marked.select("anchor", "hot", "copies", "rep.*"), "radix-wanted")
    members = _members(keyed, _bit_table(wanted))
    cut = materialise(_cut_runs(members, wanted, depths), "radix-cut")
    discard(wanted)
    spans = materialise(
        whole(again.filter("alike"))
        .unionByName(whole(copied))
        .unionByName(_sort_anchor_groups(cut.filter("NOT hot"), depths))
        .unionByName(_deal_hot_windows(cut.filter("hot"), depths)),
        "radix-spans",
    )
    discard(again, kinds, cut)
    return spans


def _report(doc: list, raws: list[bytes], spans: list[list[tuple[int, int]]], words: list[int], copies: list[int]) -> list[pa.Array]:
    """Columns of the result, each document ``copies`` times."""
    removed = [sum(e - s for s, e in x) for x in spans]
    kept = []
    for raw, cuts in zip(raws, spans):
        digest, at = hashlib.sha256(), 0
        for s, e in cuts:
            digest.update(raw[at:s])
            at = e
        digest.update(raw[at:])
        kept.append(digest.hexdigest())
    columns = [
        pa.array(doc, pa.int64()),
        pa.array([len(r) for r in raws], pa.int64()),
        pa.array(removed, pa.int64()),
        pa.array([len(x) for x in spans], pa.int64()),
        pa.array(kept),
        pa.array(words, pa.int64()),
    ]
    if max(copies, default=1) == 1:
        return columns
    times = pa.array(np.repeat(np.arange(len(doc)), copies))
    return [c.take(times) for c in columns]


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 400,
    gram: int = 64,
    hot_runs: int = 4096,
    words: int = 50,
    word_gram: int = 8,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_words) of each document.

    Every byte covered by a ``window``-byte string that also starts elsewhere, in
    the same document or another, is removed; windows never cross documents.
    n_repeated_words counts the words covered by ``words`` successive words that
    also start elsewhere, whatever white space is between them; nothing is removed
    for them.  Null texts are empty.  Texts under a window lose nothing.  Rows
    repeated with the same id and text count as documents of their own and repeat
    each other.  Other columns are ignored.
    """
    depths = [Depth(0, window, gram), Depth(1, words, word_gram)]
    spans = repeated_spans(docs, depths, id_col, text_col, hot_runs)
    keyed = _keyed(docs, id_col, text_col)
    table = _bit_table(spans)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long"
    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_repeated_words", pa.int64())])

    def untouched(block: pa.RecordBatch) -> list[pa.Array]:
        raws = block.column(2).to_pylist()
        return _report(block.column(0).to_pylist(), raws, [[]] * len(raws), [0] * len(raws), [])

    clean = _split(keyed, table, False, ddl, fields, untouched)
    # Rows repeated with id and text bring the same spans; they are judged once and reported as often as they are.
    lists = spans.groupBy("doc_id", "h").agg(F.collect_set(F.struct("unit", "start", "end")).alias("spans"))
    members = _members(keyed, table).groupBy("doc_id", "h").agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
    touched = members.join(lists, (members["doc_id"].eqNullSafe(lists["doc_id"])) & (members["h"] == lists["h"]), "left").select(
        members["doc_id"], "text", "spans", "copies"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", 2 << 20):
                doc, raws, found, copies = (block.column(i).to_pylist() for i in range(4))
                spans = [[merge([(s["start"], s["end"]) for s in x or [] if s["unit"] == u]) for x in found] for u in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    _report(doc, raws, spans[0], [sum(e - s for s, e in x) for x in spans[1]], copies), schema=fields
                )

    return clean.unionByName(touched.mapInArrow(run, ddl))
