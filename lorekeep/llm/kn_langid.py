"""Language identification by interpolated Kneser-Ney character models.

Texts are reduced to lower-case letters and single spaces; a 4-gram of 16-bit code
units is one 64-bit key.  Per language the counts of 4-grams give an interpolated
Kneser-Ney model (continuation counts below the top order).  All languages share
one sorted array of hashed keys per order, with a directory over the top bits, and
a row of log probabilities for each key, so one probe scores every language.  The
prediction is the language of the lowest cross-entropy per character; a
temperature and a rejection limit for each language come from a held-back part of
the training sample.

The model is fitted on a bounded sample: at most about ``docs_per_lang`` whole
texts and ``chars_per_lang`` characters of each language; every 4-gram of it counts.
Prediction reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, claim, in_arrow, utf8

ORDER = 4
_SPACE = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LUT: list[np.ndarray] = []
_CHUNK = 1 << 18
_RANDOM = float(np.log(27))


def letter_table() -> np.ndarray:
    """Code point -> 16-bit unit of its lower case if it is a letter, else a space."""
    if not _LUT:
        lut = np.full(0x110000, _SPACE, dtype=np.uint16)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ord(ch.lower()[0])
                # Letters beyond 16 bits share the private units, which no other letter has.
                lut[c] = low if low < 0x10000 else 0xE000 + low % 0x1900
        _LUT.append(lut)
    return _LUT[0]


def units(raw: bytes) -> np.ndarray:
    """Letters and single spaces of a UTF-8 text, a space before and after; empty if it has no letter."""
    x = letter_table()[np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32)]
    letters = x != _SPACE
    if not letters.any():
        return x[:0]
    keep = letters.copy()
    keep[:-1] |= letters[1:]  # of a run of spaces only the last, before a letter
    x = x[keep]
    return np.concatenate([[_SPACE], x[int(x[0] == _SPACE) :], [_SPACE]]).astype(np.uint16)


def keys_of(x: np.ndarray) -> np.ndarray:
    """64-bit 4-gram ending at every unit but the first."""
    padded = np.concatenate([np.zeros(ORDER - 2, dtype=np.uint64), x.astype(np.uint64)])
    k = padded[:-3] << np.uint64(48)
    k |= padded[1:-2] << np.uint64(32)
    k |= padded[2:-1] << np.uint64(16)
    return k | padded[3:]


def _low(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & np.uint64((1 << 16 * n) - 1)


class HashArray:
    """Sorted array of hashed keys with a directory over their top bits."""

    def __init__(self, keys: np.ndarray):
        h = keys * _MIX
        self.size, self.order = len(keys), np.argsort(h)
        self.hashes = np.append(h[self.order], np.uint64(0xFFFFFFFFFFFFFFFF))
        bits = max(8, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.directory = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where absent."""
        h = keys * _MIX
        pos = self.directory[h >> self.shift]
        at = self.hashes[pos]
        behind = np.flatnonzero(at < h)
        while len(behind):
            pos[behind] += 1
            at[behind] = now = self.hashes[pos[behind]]
            behind = behind[now < h[behind]]
        pos[(at != h) | (pos == self.size)] = -1
        return pos


@dataclass
class Model:
    langs: list[str]
    arrays: list[HashArray]  # by order 1..4
    logp: list[np.ndarray]  # by order: (keys, langs)
    contexts: list[HashArray]  # contexts of order 1..3
    backoff: list[np.ndarray]
    floor: np.ndarray  # by language, of a unit it never saw
    temperature: float = 10.0
    limits: list[float] | None = None  # rejection limit of each language's cross-entropy

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """(len(keys), langs) natural log probabilities of the last unit given the three before."""
        pos = self.arrays[-1].find(keys)
        out = self.logp[-1][pos]
        miss = np.flatnonzero(pos < 0)
        if len(miss):
            out[miss] = self._lower(keys[miss], ORDER - 1)
        return out

    def _lower(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Back off from the missing order n+1 to n."""
        ctx = self.contexts[n - 1].find(_low(keys >> np.uint64(16), n))
        out = np.where(ctx[:, None] >= 0, self.backoff[n - 1][ctx], np.float32(0))
        g = _low(keys, n)
        pos = self.arrays[n - 1].find(g)
        hit = pos >= 0
        out[hit] += self.logp[n - 1][pos[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            out[miss] += self._lower(keys[miss], n - 1) if n > 1 else self.floor
        return out

    def entropies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per unit (texts, langs) and the number of units, 0 without letters."""
        total = np.zeros((len(texts), len(self.langs)))
        n = np.zeros(len(texts), dtype=np.int64)
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                lp = self.log_probs(np.concatenate([k for _, k in held]))
                starts = np.cumsum([0, *(len(k) for _, k in held[:-1])])
                sums = np.stack([np.add.reduceat(lp[:, j], starts, dtype=np.float64) for j in range(lp.shape[1])], axis=1)
                np.subtract.at(total, [i for i, _ in held], sums)
                held.clear()
                size = 0

        for i, raw in enumerate(texts):
            x = units(raw)
            if not len(x):
                continue
            k = keys_of(x)
            n[i] = len(k)
            for s in range(0, len(k), _CHUNK):
                held.append((i, k[s : s + _CHUNK]))
                size += len(held[-1][1])
                if size >= _CHUNK:
                    flush()
        flush()
        return total / np.maximum(n, 1)[:, None], n

    def decide(self, h: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each row of entropies."""
        if not self.langs:
            return ["und"] * len(n), np.zeros(len(n)), np.ones(len(n), dtype=bool)
        best = h.argmin(axis=1)
        top = h[np.arange(len(n)), best]
        score = 1 / np.exp(-self.temperature * np.minimum(h - top[:, None], 60)).sum(axis=1)
        none = n == 0
        limits = np.array(self.limits if self.limits else [np.inf] * len(self.langs))
        rejected = none | (top > limits[best]) & (n >= 20)
        return ["und" if z else self.langs[b] for b, z in zip(best, none)], np.where(none, 0.0, score), rejected


def _discount(counts: np.ndarray) -> float:
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def _kneser_ney(grams: np.ndarray, counts: np.ndarray, floor: float) -> tuple[list, list]:
    """Per order: (keys, log p) and per context order: (contexts, log back-off weight) of one language."""
    tables = [(grams, counts.astype(np.float64))]
    for n in range(ORDER - 1, 0, -1):
        low, cont = np.unique(_low(tables[0][0], n), return_counts=True)  # distinct left extensions
        tables.insert(0, (low, cont.astype(np.float64)))
    probs: list[tuple[np.ndarray, np.ndarray]] = []
    weights: list[tuple[np.ndarray, np.ndarray]] = []
    for n, (keys, c) in enumerate(tables, 1):
        d = _discount(c)
        ctx, inverse = np.unique(keys >> np.uint64(16) if n > 1 else np.zeros(len(keys), np.uint64), return_inverse=True)
        totals = np.bincount(inverse, weights=c)
        lam = d * np.bincount(inverse) / totals
        if n == 1:
            lower = np.full(len(keys), np.exp(floor))
            base = float(lam[0])
        else:
            below, p = probs[-1]
            lower = p[np.searchsorted(below, _low(keys, n - 1))]
            weights.append((ctx, np.log(lam)))
        probs.append((keys, (c - d) / totals[inverse] + lam[inverse] * lower))
    return [(k, np.log(p)) for k, p in probs], [*weights, base]


def build(per_lang: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Merge the languages' models into shared arrays; every key gets every language's probability."""
    langs, floor = sorted(per_lang), -16 * float(np.log(2))
    parts = [_kneser_ney(*per_lang[x], floor) for x in langs]
    unseen = np.array([np.log(p[1][-1]) + floor for p in parts], dtype=np.float32)
    contexts, backoff, arrays, logp = [], [], [], []
    for n in range(1, ORDER):
        every = np.unique(np.concatenate([p[1][n - 1][0] for p in parts]))
        table = np.zeros((len(every), len(langs)), dtype=np.float32)
        for j, p in enumerate(parts):
            ctx, w = p[1][n - 1]
            table[np.searchsorted(every, ctx), j] = w
        array = HashArray(every)
        contexts.append(array)
        backoff.append(table[array.order])
    for n in range(1, ORDER + 1):
        every = np.unique(np.concatenate([p[0][n - 1][0] for p in parts]))
        table = np.full((len(every), len(langs)), np.nan, dtype=np.float32)
        for j, p in enumerate(parts):
            keys, lp = p[0][n - 1]
            table[np.searchsorted(every, keys), j] = lp
        model = Model(langs, arrays, logp, contexts, backoff, unseen)
        rows, cols = np.nonzero(np.isnan(table))
        if len(rows):
            if n == 1:
                table[rows, cols] = unseen[cols]
            else:
                lower = model._lower(every, n - 1)
                table[rows, cols] = lower[rows, cols]
        array = HashArray(every)
        arrays.append(array)
        logp.append(table[array.order])
    for array in (*arrays, *contexts):
        array.order = None  # the tables are in its order; a model is broadcast without it
    return Model(langs, arrays, logp, contexts, backoff, unseen)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a partition, combined in the task."""
    claim("langid")
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out(lang: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys)), "gram": pa.array(keys.view(np.int64)), "n": pa.array(n)})

    for batch in batches:
        for block in blocks(batch, "text", 4 << 20):
            by: dict[str, list[np.ndarray]] = {}
            for lang, raw in zip(block.column(0).to_pylist(), block.column(1).to_pylist()):
                x = units(raw)
                if len(x):
                    by.setdefault(lang, []).append(keys_of(x))
            for lang, parts in by.items():
                k, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in sums:
                    k0, n0 = sums[lang]
                    k, inverse = np.unique(np.concatenate([k0, k]), return_inverse=True)
                    n = np.bincount(inverse, weights=np.concatenate([n0, n])).astype(np.int64)
                sums[lang] = (k, n)
                if len(k) > 1 << 20:
                    yield out(lang, *sums.pop(lang))
    for lang, (k, n) in sums.items():
        yield out(lang, k, n)


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_lang: int = 1500,
    chars_per_lang: int = 20_000_000,
) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs``; a fifth of it calibrates.

    A row is taken by a hash of its id, at a rate that gives ``docs_per_lang`` rows
    and ``chars_per_lang`` characters of each language (all, if there are fewer).
    Rows with null text or language take no part.  Without such rows the model knows
    no language.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).alias("h"),
        utf8(text_col).alias("text"),
    )
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("chars")).collect()
    nothing = Model([], [], [], [], [], np.zeros(0, np.float32))
    if not sizes:
        return nothing
    rates = F.lit(0)
    for r in sizes:
        rate = min(1.0, docs_per_lang / r["n"], chars_per_lang / max(r["chars"], 1))
        rates = F.when(F.col("lang") == r["lang"], F.lit(int(rate * (1 << 30)))).otherwise(rates)
    sample = rows.filter(F.col("h") < rates)
    held_back = F.col("h") % 5 == 0
    grams = (
        sample.filter(~held_back)
        .select("lang", "text")
        .mapInArrow(_count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    found = grams.toArrow()
    names = found.column("lang").to_numpy()
    keys, n = found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()
    per_lang = {}
    for lang in set(names.tolist()):
        mine = names == lang
        order = np.argsort(keys[mine])
        per_lang[lang] = (keys[mine][order], n[mine][order])
    if not per_lang:
        return nothing
    model = build(per_lang)
    _calibrate(model, sample.filter(held_back))
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Temperature by log loss, and for each language a rejection limit above every entropy of its held-back rows.

    The limit is as far above the largest entropy as that is above the median;
    languages of fewer than 20 such rows take that of all rows together.  Text
    likelier than random letters (``_RANDOM``) is never rejected, for held-back rows
    that are all alike would leave no room.
    """
    shipped, langs = rows.sparkSession.sparkContext.broadcast(model), model.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = shipped.value.entropies(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict({"lang": batch.column(0), "n": pa.array(n), "h": pa.array(h.tolist(), pa.list_(pa.float64()))})

    seen = rows.select("lang", "text").mapInArrow(run, "lang string, n long, h array<double>").filter("n >= 20").toArrow().to_pylist()
    seen = [r for r in seen if r["lang"] in langs]
    if not seen:
        return
    h = np.array([r["h"] for r in seen])
    y = np.array([langs.index(r["lang"]) for r in seen])
    gap = h - h.min(axis=1, keepdims=True)
    losses = {t: (t * gap[np.arange(len(y)), y] + np.log(np.exp(-t * gap).sum(axis=1))).mean() for t in (1, 2, 5, 10, 20, 50, 100)}
    model.temperature = float(min(losses, key=losses.get))
    own = h[np.arange(len(y)), y]
    above = lambda e: max(_RANDOM, float(2 * e.max() - np.median(e)))
    model.limits = [above(own[y == j]) if (y == j).sum() >= 20 else above(own) for j in range(len(langs))]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) of every whole text.

    ``und`` with score 0 where the text is null or has no letter; ties go to the
    first language in order.  Repeated ids keep one row each; other columns are
    ignored.  The model is of bounded size and is broadcast.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for block in blocks(batch, "text", 4 << 20):
                texts = block.column(1).to_pylist()
                if m.langs:
                    h, n = m.entropies(texts)
                else:
                    h, n = np.zeros((len(texts), 1)), np.zeros(len(texts), dtype=np.int64)
                lang, score, rejected = m.decide(h, n)
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(lang), pa.array(score), pa.array(h.min(axis=1)), pa.array(rejected)], schema=schema
                )

    return in_arrow(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")),
        run,
        "doc_id long, lang_pred string, score double, entropy double, rejected boolean",
    )


def held_out(id_col: str, modulus: int, remainder: int):
    """True for rows whose crc32 of the id as text leaves the remainder; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text the model does not reject."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        m = shipped.value
        for batch in batches:
            at = batch.schema.names.index("__langid_text")
            for block in blocks(batch, "__langid_text", 4 << 20):
                texts = block.column(at).to_pylist()
                if m.langs:
                    _, _, rejected = m.decide(*m.entropies(texts))
                    keep = ~rejected
                else:
                    keep = np.array([len(units(t)) > 0 for t in texts], dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [c for i, c in enumerate(block.columns) if i != at], names=[n for n in block.schema.names if n != "__langid_text"]
                ).filter(pa.array(keep))

    return in_arrow(docs.withColumn("__langid_text", utf8(text_col)), run, docs.schema)
