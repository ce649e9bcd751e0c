"""SimHash, decontamination, top-k, WARC and token scan against brute force; the pipeline end to end."""

from __future__ import annotations

import base64
import hashlib
import io
import math
import random
import re

import numpy as np
import pytest
import xxhash

DOCS = "doc_id long, text string, fp long, rep long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], DOCS)


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    parts = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def closure(ids, near):
    label = np.array(ids)
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return label
        label = new


def test_simhash_matches_brute_force(spark):
    from lorekeep.llm.simhash_tiles import near_duplicates

    random.seed(6)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(40):
        text = [random.choice(words) for _ in range(300)]
        rows.append((10 * i, " ".join(text)))
        for k in range(3):
            text[random.randrange(300)] = "changed"
            rows.append((10 * i + 1 + k, " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "One"), (1005, "é x"), (5, rows[0][1]), (5, rows[0][1])]
    fps = np.array([fingerprint(t) for _, t in rows], dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = closure([i for i, _ in rows], near)
    want = sorted((i, int(f.astype(np.int64)), int(c)) for (i, _), f, c in zip(rows, fps, label))
    assert len(set(label)) < len(set(fps))
    for options in ({}, {"tile_rows": 2}, {"blocks": 6, "tile_rows": 3}):
        got = sorted(tuple(r) for r in near_duplicates(docs_of(spark, rows), **options).collect())
        assert got == want
    assert near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_simhash_links_without_id(spark):
    from lorekeep.llm.simhash_tiles import near_duplicates

    got = {(r.doc_id, r.component_id) for r in near_duplicates(docs_of(spark, [(None, "a b c"), (7, "a b c"), (None, "x y z q")])).collect()}
    assert got == {(None, 7), (7, 7), (None, None)}


def test_components_of_paths_stars_and_loops(spark):
    from lorekeep.llm.components import components

    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 230)] + [(9, 9), (229, 230), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[k] == 7 for k in range(200, 231)) and got[7] == 7 and 9 not in got


def test_near_copies_find_what_jaccard_finds(spark):
    from lorekeep.llm.simhash_tiles import near_copies

    random.seed(12)
    words = [f"w{i}" for i in range(800)]
    rows, copy_of = [], {}
    for i in range(60):
        text = [random.choice(words) for _ in range(random.randint(60, 400))]
        rows.append((100 * i, " ".join(text)))
        for k in range(2):
            bent = list(text)
            for _ in range(max(1, len(text) // 100)):
                bent[random.randrange(len(bent))] = "changed"
            rows.append((100 * i + 1 + k, " ".join(bent)))
            copy_of[100 * i + 1 + k] = 100 * i
    rows += [(9001, None), (9002, ""), (9003, "tiny text"), (9004, "tiny text")]
    got = {r.doc_id: r.component_id for r in near_copies(docs_of(spark, rows), least_tile=8).collect()}
    assert len(got) == len(rows)
    assert got[9002] == 9001 and got[9004] == 9003
    assert all(got[c] == o for c, o in copy_of.items())
    assert all(got[i] // 100 == i // 100 for i, _ in rows if i < 9000)


def test_near_copies_are_exactly_the_pairs_of_that_jaccard(spark):
    from lorekeep.llm.simhash_tiles import near_copies

    def jaccard(x, y):
        s, t = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x, y))
        return len(s & t) / len(s | t)

    rng = random.Random(31)
    words = [f"w{i}" for i in range(5000)]
    line = "this line is in very many of the documents of the corpus".split()
    texts = []
    for n, edits in ((50, (1, 1, 2)), (100, (1, 2, 3)), (1000, (10, 22, 26, 30))):
        for _ in range(30):
            base = line + [rng.choice(words) for _ in range(n)]
            texts.append(base)
            for k in edits:
                bent = list(base)
                for at in rng.sample(range(len(line), len(bent)), k):
                    bent[at] = "changed"
                texts.append(bent)
    # A crowd of near copies around one text, some of them too far from most others.
    base = [rng.choice(words) for _ in range(120)]
    for k in range(70):
        bent = list(base)
        for at in rng.sample(range(120), 1 + k % 3):
            bent[at] = f"own{k}"
        texts.append(bent)
    near = np.array([[jaccard(x, y) >= 0.8 if abs(len(x) - len(y)) < 30 else False for y in texts] for x in texts])
    want = closure(list(range(len(texts))), near)
    for options in ({}, {"least_tile": 2}):
        got = {r.doc_id: r.component_id for r in near_copies(docs_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), **options).collect()}
        assert [got[i] for i in range(len(texts))] == want.tolist()


def test_crowds_of_near_copies_leave_no_pairs(spark, monkeypatch):
    from lorekeep.llm import simhash_tiles

    def jaccard(x, y):
        s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x, y))
        return len(s & t) / len(s | t)

    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    # Crowds around a text each: of two and of three edits, pairs of three are too far apart; two outliers link to nothing.
    texts, crowd = [], 200
    for _ in range(2):
        base = [rng.choice(words) for _ in range(240)]
        for k in range(crowd):
            bent = list(base)
            for at in rng.sample(range(0, 240, 6), (2, 3, 3)[k % 3] if k < crowd - 2 else 5):
                bent[at] = f"own{k}"
            texts.append(bent)
    near = np.array([[i // crowd == j // crowd and jaccard(x, y) >= 0.8 for j, y in enumerate(texts)] for i, x in enumerate(texts)])
    want = closure(list(range(len(texts))), near)
    assert near.sum() > 10_000 and len(set(want)) > 2
    made, plain = [], simhash_tiles.in_arrow

    def counted(df, run, ddl):
        out = plain(df, run, ddl).cache()
        made.append((out.count(), df.count(), ddl))
        return out

    monkeypatch.setattr(simhash_tiles, "in_arrow", counted)
    docs = docs_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    # No fingerprints or leaders join them before; in one part each, or many.
    for options in ({}, {"part_shingles": 4000, "tile_rows": 64}):
        made.clear()
        got = {r.doc_id: r.component_id for r in simhash_tiles.near_copies(docs, radius=0, leader_rounds=0, **options).collect()}
        assert [got[i] for i in range(len(texts))] == want.tolist()
        # At most eight documents meet outside the tiles, in 28 pairs of a shingle.
        assert made and all(rows <= 4 * given for rows, given, _ in made), made


def test_decontamination(spark):
    from lorekeep.llm.latent_decontam import decontaminate, lcs_length

    random.seed(5)
    words = [f"word{i}" for i in range(900)]
    say = lambda n: " ".join(random.choice(words) for _ in range(n))
    items = [(k, say(random.randint(15, 60))) for k in range(30)]
    rows = [(i, say(random.randint(5, 400))) for i in range(150)]
    leaks = {}
    for k in range(20):
        rows.append((1000 + k, say(100) + " " + items[k][1].upper() + " " + say(80)))
        leaks[1000 + k] = k
    for k in range(20, 28):
        w = items[k][1].split()
        for j in range(2, len(w) - 6, 6):
            w[j] = "other"
        rows.append((1000 + k, say(50) + ". " + ", ".join(w) + "! " + say(60)))
        leaks[1000 + k] = k
    rows += [(2000, None), (2001, ""), (2002, "word1"), (1000, rows[150][1])]
    bench = spark.createDataFrame([(k, t, "x") for k, t in [*items, (99, None), (98, "")]], "item_id long, text string, doc_id string")
    got = decontaminate(docs_of(spark, rows), bench).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.item_ids == ([leaks[r.doc_id]] if r.doc_id in leaks else []), r
    # Rows that share an id are judged apart, with any number of blocks of items.
    rows += [(1001, "clean text"), (None, rows[152][1]), (None, "clean too"), (1001, "clean text")]
    whole, parted = (sorted(((r.doc_id, r.h, r.contaminated, r.item_ids) for r in decontaminate(docs_of(spark, rows), bench, items_per_block=n).collect()), key=repr) for n in (1024, 2))
    assert whole == parted and len(whole) == len(rows)
    assert sum(x[2] for x in whole) == len(leaks) + 2 and sum(x[2] for x in whole if x[0] == 1001) == 1
    assert decontaminate(docs_of(spark, rows), bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate(docs_of(spark, rows).limit(0), bench).count() == 0
    a, b = "abcbdab", "bdcaba"
    masks = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    assert lcs_length(masks, len(a), list(b)) == 4


def test_svd_is_that_of_the_stacked_matrix(spark):
    from lorekeep.llm.latent_decontam import randomised_svd

    rng = np.random.default_rng(2)
    idf = rng.uniform(1, 5, 40)
    draw = lambda: rng.choice(40, rng.integers(1, 9), p=np.arange(40, 0, -1) / 820).tolist()
    passages, items = [draw() for _ in range(300)], [np.array(draw()) for _ in range(12)]
    dense = []
    for ids, weight in [*((p, 1.0) for p in passages), *((i, 50.0**0.5) for i in items)]:
        x = np.bincount(ids, minlength=40) * idf
        dense.append(weight * x / np.linalg.norm(x))
    _, _, want = np.linalg.svd(np.array(dense), full_matrices=False)
    got = randomised_svd(spark.createDataFrame([(p,) for p in passages], "ids array<int>").repartition(3), items, idf, 6, power=6)
    assert np.allclose(np.abs(np.sum(got * want[:6].T, axis=0)), 1, atol=0.02)


def test_decontamination_fits_on_every_passage(spark, monkeypatch):
    """The Gram matrix that the basis comes from is that of all passages of all documents; no sample is taken."""
    from lorekeep.llm import latent_decontam as L

    rng = random.Random(23)
    words = [f"v{i}" for i in range(300)]
    items = [rng.sample(words, 20) for _ in range(8)]
    docs = [rng.choices(words, k=rng.randint(0, 90)) for _ in range(1700)] + [rng.choices(words, k=2000)]
    seen = {}

    def keep(gram, of_items, idf, rank, **options):
        rows = max(1, L.GRAM_BLOCK // len(idf))
        whole = np.zeros((-(-len(idf) // rows) * rows, len(idf)))
        for part, raw in gram.collect():
            whole[part * rows : (part + 1) * rows] += np.frombuffer(raw).reshape(rows, len(idf))
        seen.update(gram=whole[: len(idf)], idf=idf)
        return fit(gram, of_items, idf, rank, **options)

    fit = L.gram_svd
    monkeypatch.setattr(L, "gram_svd", keep)
    monkeypatch.setattr(L, "_sample", None)
    monkeypatch.setattr(L, "GRAM_HELD", 500)
    monkeypatch.setattr(L, "GRAM_BLOCK", 2000)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    L.decontaminate(docs_of(spark, [(i, " ".join(d)) for i, d in enumerate(docs)]), bench)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in items for w in ws))}
    df = np.array([sum(w in d for d in map(set, docs)) for w in vocabulary])
    idf = np.log((len(docs) + 1) / (df + 1)) + 0.05
    feature = L.choose_features(L.Items(list(range(8)), items, vocabulary), df, idf, 0.05 * len(docs))
    weights = idf[feature >= 0]
    want = np.zeros((len(weights), len(weights)))
    for d in docs:
        for s in range(0, len(d), 16):
            own = [feature[vocabulary[w]] for w in d[s : s + 32] if w in vocabulary and feature[vocabulary[w]] >= 0]
            if own:
                x = np.bincount(own, minlength=len(weights)) * weights
                x /= np.linalg.norm(x)
                want += np.outer(x, x)
    assert np.allclose(seen["idf"], weights) and np.allclose(seen["gram"], want)


def test_executors_are_asked_to_shrink(spark):
    from lorekeep.llm.common import relax_executors

    relax_executors(spark)


def test_latent_search_recalls_what_tf_idf_cosine_finds(spark):
    """At least 0.9 of the (document, item) pairs with a passage of cosine 0.3 over all words, for more items than dimensions."""
    from lorekeep.llm import latent_decontam as L

    rng = random.Random(19)
    words = [f"v{i}" for i in range(4000)]
    weights = [1 / (i + 10) for i in range(4000)]
    say = lambda n: rng.choices(words, weights, k=n)
    items = [say(rng.randint(15, 60)) for _ in range(400)]
    docs = []
    for i in range(300):
        body = say(rng.randint(60, 200))
        if i % 2:
            part = [w for w in rng.choice(items) if rng.random() < rng.choice((0.5, 0.8, 1.0))]
            at = rng.randint(0, len(body))
            body = body[:at] + part + body[at:]
        docs.append(body)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in items for w in ws))}
    listed = L.Items(list(range(len(items))), items, vocabulary)
    frame = docs_of(spark, [(i, " ".join(d)) for i, d in enumerate(docs)])
    df, n = L._document_frequency(frame, "text", vocabulary)
    idf = np.log((n + 1) / (df + 1)) + 0.05
    feature = L.choose_features(listed, df, idf, 0.05 * n)
    chosen = {w: int(feature[i]) for w, i in vocabulary.items() if feature[i] >= 0}
    rows = frame.selectExpr("doc_id", "cast(text as binary) text")
    coded = L._sample(rows, chosen, 32, 1500, 8, n)
    basis = L.randomised_svd(coded, [feature[ids][feature[ids] >= 0] for ids in listed.coded()], idf[feature >= 0], 256)
    m = L.Matcher(listed, idf, feature, basis, 16, 0.3, 0.75, 0.5, 5)
    m.spans = lambda flat, doc: (np.zeros(0, int),) * 3  # the cosine search alone
    got = {(d, item) for d, _, item, _ in m.candidates(docs)}
    weight = np.append(idf, np.median(idf[feature >= 0]))

    def vector(ws):
        x = np.zeros(len(vocabulary) + 1)
        for w in ws:
            x[vocabulary.get(w, len(vocabulary))] += 1
        x *= weight
        return x

    of_items = np.array([vector(ws)[:-1] for ws in items])
    of_items /= np.linalg.norm(of_items, axis=1)[:, None]
    want = set()
    for d, ws in enumerate(docs):
        for s in range(0, len(ws), 16):
            x = vector(ws[s : s + 32])
            want |= {(d, int(i)) for i in np.flatnonzero(of_items @ x[:-1] / np.linalg.norm(x) >= 0.3)}
    recall = len(got & want) / len(want)
    print("recall", recall, len(want), len(got), len(chosen))
    assert recall >= 0.9


def test_latent_search_recalls_as_much_with_the_fit_on_every_passage(spark, monkeypatch):
    """The test above with the fit that ``decontaminate`` uses."""
    from lorekeep.llm import latent_decontam as L

    def fit(given, items, idf, rank):
        rows, chosen = given
        coded = L._coded(rows.selectExpr("doc_id", "0L h", "text"), chosen)
        return L.gram_svd(L._passages_gram(coded, len(chosen), np.arange(len(chosen)), 16, idf), items, idf, rank, corpus_weight=12_000)

    monkeypatch.setattr(L, "_sample", lambda rows, chosen, *_: (rows, chosen))
    monkeypatch.setattr(L, "randomised_svd", fit)
    test_latent_search_recalls_what_tf_idf_cosine_finds(spark)


def brute_top_k(rows, k, modulus):
    good = [(i, [x * 256 for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good = [(i, [math.floor(x) for x in v]) for i, v in good if all(np.isfinite(x) for x in v)]
    out = {}
    for q, x in good:
        if q % modulus == 0:
            out[q] = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q)[:k]
    return {q: [(i, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, i in v] for q, v in out.items()}


def test_decontamination_misses_no_length_or_paraphrase(spark):
    from lorekeep.llm.latent_decontam import decontaminate, lcs_length

    def rule(words, item):
        """The rule of the operator over the region of every passage."""
        m, masks = len(item), {}
        for i, w in enumerate(item):
            masks[w] = masks.get(w, 0) | 1 << i
        for first in range(-(-len(words) // 16)):
            region = words[max(0, 16 * first - m) : 16 * (first + 2) + m]
            if sum(masks[w].bit_count() for w in masks.keys() & set(region)) < 0.5 * m:
                continue
            share = lcs_length(masks, m, region) / m
            if share >= 0.75 or share >= 0.5 and " " + " ".join(item[-5:]) + " " in " " + " ".join(region) + " ":
                return True
        return False

    rng = random.Random(77)
    rare = [f"word{i}" for i in range(3000)]
    common = [f"of{i}" for i in range(40)]
    say = lambda n: [rng.choice(common if rng.random() < 0.6 else rare) for _ in range(n)]
    items = [(k, say(n)) for k, n in enumerate([5] * 12 + [8] * 12 + [20] * 12 + [50] * 12 + [600] * 6)]
    rows, leaks = [(i, " ".join(say(rng.randint(50, 900)))) for i in range(30)], {}
    for k, w in items:
        rows.append((1000 + k, " ".join(say(400) + w + say(300))))  # as it stands
        leaks[1000 + k] = k
        if 20 <= len(w) <= 50:
            half = set(rng.sample(range(len(w) - 5), len(w) // 2 - 5)) | set(range(len(w) - 5, len(w)))
            bent = [x if i in half else "other" for i, x in enumerate(w)]
            rows.append((2000 + k, " ".join(say(300) + bent + say(300))))  # half the words and the answer
            gone = set(range(len(w) - 1, -1, -4)[: len(w) // 4])
            bent = [x for i, x in enumerate(w) for x in (["other", "thing"] if i in gone else [x])]
            rows.append((3000 + k, " ".join(say(300) + bent + say(300))))  # three quarters in order, no answer
            leaks |= {2000 + k: k, 3000 + k: k}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate(docs_of(spark, rows), bench).collect()}
    assert [d for d, k in leaks.items() if k not in got[d]] == []
    assert got == {i: [k for k, w in items if rule(t.split(), w)] for i, t in rows}


def found_by(df, **options):
    from lorekeep.llm.pivot_topk import top_k

    got = {}
    for r in top_k(df, **options).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert all([z[0] for z in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()}


@pytest.mark.parametrize("pack", [4096, 3])
def test_top_k_matches_brute_force(spark, pack):
    from lorekeep.llm.pivot_topk import top_k

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(120)]  # one vector many times
    rows += [(2000, None), (2001, [float("nan")] * 8), (2050, [1.0, None, *[0.0] * 6]), (2100, [float("inf")] + [0.0] * 7)]
    rows += [(2150, [1.0, 2.0, -1.0]), (2151, []), (2200, [0.5] * 11)]  # other lengths
    df = spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<float>, pivot int, dist int")
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert found_by(df, pack_rows=pack) == brute_top_k(rows32, 5, 50)
    assert top_k(df.limit(0)).count() == 0
    few = top_k(df.filter("vec_id IN (0, 1, 50)")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2), (50, 1), (50, 2)]


@pytest.mark.parametrize("size", [1e4, 1e10, 1e150, 1e300, 1.7e308])
def test_top_k_of_very_large_components(spark, size):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, (rng.normal(size=4) * size / 8).tolist()) for i in range(60)] + [(200, [size, 0.0, 0.0, 1.0]), (250, [-size, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found_by(df, query_modulus=10, pack_rows=16) == brute_top_k(rows, 5, 10)


def test_bounds_leave_most_chunks_unread(spark):
    """Clusters far apart: a block meets the chunks of its own cluster, and the annuli of a pivot are in order."""
    from lorekeep.llm.pivot_topk import PivotIndex

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 12))
    centres = 20_000 * centres / np.linalg.norm(centres, axis=1)[:, None]
    v = [(i, np.round(centres[i % 16] + rng.normal(size=12) * 50).tolist()) for i in range(1600)]
    rows = spark.createDataFrame(v, "vec_id long, v array<double>").cache()
    index = PivotIndex(rows, 16, 256, pack_rows=50)
    met = []
    own = index._meet
    index._meet = lambda blocks, chunks, wanted, k: (met.append(blocks.join(chunks, wanted).count()), own(blocks, chunks, wanted, k))[1]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in index.search(rows.filter("vec_id % 10 = 0"), 5).collect()}
    x = np.array([z for _, z in v])
    for q in range(0, 1600, 10):
        best = sorted(((-int(x[i] @ x[q]), i) for i in range(1600) if i != q))[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, -s) for s, i in best]
    chunks = index.table.count()
    blocks = rows.filter("vec_id % 10 = 0").count()
    assert sum(met) < 0.5 * chunks * max(16, blocks // 50)


def test_warc_round_trip(spark):
    from lorekeep.llm.warc_zst import archive_pages, read_archives

    rows = [(i, f"http://h/{i} ü", f"<p>{'x' * (i % 50)}</p>") for i in range(200)] + [(500, None, None), (501, "u", ""), (502, "a\r\nb: c", "é" * 100_000), (503, "u", "<p></p>"), (None, "u", "<p></p>")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    got = {r.page_id: r for r in read_archives(archive_pages(df), with_payload=True).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h in rows:
        b, r = (h or "").encode(), got[i]
        revisit = first[h or ""] != i
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("revisit", first[h or ""]) if revisit else ("response", None))
        assert r.payload == (b"" if revisit else b)
    assert read_archives(archive_pages(df.limit(0))).count() == 0
    assert read_archives(archive_pages(df, least_bytes=10)).filter("record_type = 'revisit' AND payload_bytes < 10").count() == 0


def test_warc_damage_is_found():
    from lorekeep.llm.warc_zst import base32_sha1, parse, read_records, record

    good = record(1, "http://h", b"body", base32_sha1(b"body"), None, False)
    assert parse(good)["payload"] == b"body"
    for bad in (good[:-1], good.replace(b"body", b"bodx"), good.replace(b"WARC/1.1", b"WARX/1.1"), good.replace(b"Content-Length: 4\r\n", b"Content-Length: 5\r\n", 1)):
        with pytest.raises(ValueError):
            parse(bad)
    for raw in (b"", b"\x5d\x2a\x4d\x18\x10\x00\x00\x00abc", b"\x00" * 20):
        with pytest.raises(ValueError):
            list(read_records(io.BytesIO(raw)))


@pytest.mark.parametrize("block", [3, 64, 1 << 20])
def test_token_scan_stitches_blocks(spark, block):
    import public_tokenizers as P
    import tiktoken
    from lorekeep.llm.bpe_transducer import parse_ranks
    from lorekeep.llm.token_scan import token_counts

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=parse_ranks(f.read()), special_tokens={})
    random.seed(block)
    rows = [(i, "word " * random.randint(0, 40)) for i in range(50)] + [(60, None), (61, ""), (62, "<|endoftext|>"), (3, "again")]
    got = sorted((r.doc_id, r.n_tokens) for r in token_counts(docs_of(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, block_tokens=block).collect())
    assert got == sorted((i, len(lib.encode_ordinary(t or ""))) for i, t in rows)
    assert token_counts(docs_of(spark, rows).limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    random.seed(1)
    words = [f"{a}{b}{d}" for a in "bcdfg" for b in "aeiou" for d in ("n", "r", "st", "l")]
    say = lambda n: " ".join(random.choice(words) for _ in range(n))
    item = say(40)
    rows = [(i, say(120), "en", "s", 1) for i in range(60)]
    bent = rows[0][1].split()
    bent[50] = "changed"
    rows += [(100, rows[3][1], "en", "s", 1), (101, " ".join(bent), "en", "s", 1), (102, "", "en", "s", 0), (103, None, None, None, None), (104, say(50) + " " + item, "en", "s", 1)]
    rows += [(105, "mail me at someone@example.com now, " + say(80), "en", "s", 1), (7, rows[7][1], "en", "s", 1)]
    # Extra columns whose names operators use inside.
    rows = [(*r, "e", "t", 5, "c") for r in rows]
    columns = "doc_id long, text string, lang string, source string, n_chars long, extra string, _t string, component_id int, contaminated string"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in c.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != c.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    base = [*range(60)]
    assert kept["language_id"] == sorted([*base, 7, 100, 101, 104, 105])
    assert kept["simhash_near_dedup"] == [*base, 104, 105]
    assert kept["benchmark_decontamination"] == [*base, 105]
    red = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/pii_redaction").collect()}
    assert red[105].text.startswith("mail me at <EMAIL> now") and red[105].n_chars == len(red[105].text)
    assert docs.filter("doc_id = 105").first().decoded_sha256 == hashlib.sha256(red[105].text.encode()).hexdigest()


def test_stages_judge_rows_by_id_and_text(spark, tmp_path):
    """Repeated ids with other texts, null ids, repeated rows and an empty table."""
    import corpus_pipeline as c

    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["bana", "toka", "miru", "sele", "pofu", "gadi"]) + rng.choice("xyzw") * rng.randint(0, 3) for _ in range(n))
    t, u, item = say(60), say(60), say(30)
    rows = [(1, t, "en", "s", 1), (5, t, "en", "s", 1), (5, u, "en", "s", 1), (None, t, "en", "s", 1), (None, say(50), "en", "s", 1), (9, item + " " + say(40), "en", "s", 1), (9, say(45), "en", "s", 1), (12, u, "en", "s", 1), (12, u, "en", "s", 1), (13, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    once = c.near_dedup(spark, docs, str(tmp_path)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    want = [rows[0], rows[2], rows[4], rows[5], rows[6], rows[9]]
    assert sorted(((r.doc_id, r.text) for r in once), key=repr) == sorted(((i, x) for i, x, *_ in want), key=repr)
    clean = c.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(map(key, clean)) == sorted(key(r) for r in docs.collect() if r.text != rows[5][1])
    for _, stage in c.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
