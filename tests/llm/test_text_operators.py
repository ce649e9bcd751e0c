"""Language ID, PII, BPE, suffix radix and language model against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from lorekeep.llm.bpe_transducer import Encoder, Transducer, Utf8Stream, decode_stream, encode_documents, parse_ranks
from lorekeep.llm.kn_langid import HashArray, accepted, fit, held_out, keys_of, predict, units
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, h string, word string"


def docs_of(spark, texts, langs=None):
    """Documents with clashing extra columns."""
    rows = [(i, t, langs[k] if langs else "en", "x", "y") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return parse_ranks(f.read())


ODD = [None, "", " ", "a", "\n\n", "é", "日本語 text", "😀😀", "x" * 5000, "don't  stop\t\n 123 4567", "\x1c\x85\xa0", "ab" * 900 + " 12" * 50]


def test_bpe_matches_the_library(spark, ranks):
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(2)
    pieces = ["a", "e", " the", "ing", "1", " ", "\n", "é", "日", "😀", "'s", "!", "…", "\t"]
    texts = ODD + ["".join(random.choice(pieces) for _ in range(random.randint(0, 80))) for _ in range(200)]
    rows = list(enumerate(texts)) + [(3, "a")]
    got = encode_documents(docs_of(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        ids = lib.encode_ordinary(t or "")
        want[i] = (len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    for r in got:
        assert (r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) == want[r.doc_id]


def test_bpe_table_limits_change_nothing(ranks):
    text = "The quick brown foxes jumped over lazily sleeping dogs; encyclopaedias notwithstanding. " * 5 + "z" * 400
    small, large = Encoder(ranks, P.PATTERN, max_states=20, max_words=5, max_pairs=7), Encoder(ranks, P.PATTERN)
    assert small.encode(text) == large.encode(text)


def test_streaming_decode_cut_anywhere(ranks):
    text = "naïve café 日本語 😀 end"
    fst = Transducer(ranks)
    ids = fst.run(text.encode())
    assert "".join(decode_stream(ids, fst.bytes_of, block=1)) == text
    for cut in range(len(text.encode())):
        s = Utf8Stream()
        assert s.feed(text.encode()[:cut]) + s.feed(text.encode()[cut:]) == text
    with pytest.raises(UnicodeDecodeError):
        s = Utf8Stream()
        s.feed("é".encode()[:1])
        s.close()


def test_language_id_learns_and_rejects(spark):
    random.seed(4)
    make = lambda syllables: " ".join("".join(random.choice(syllables) for _ in range(random.randint(1, 3))) for _ in range(60))
    kinds = {"xx": ["ka", "to", "mi"], "yy": ["schl", "ung", "er"], "zz": ["ção", "ão", "lhe"]}
    rows = [(i, make(kinds[k]), k) for i, k in enumerate(list(kinds) * 40)]
    rows += [(900, None, "xx"), (901, "", "yy"), (902, "123 !!", "zz"), (903, make(kinds["xx"]), None), (0, rows[0][1], "xx")]
    docs = docs_of(spark, [(i, t) for i, t, _ in rows], [k for _, _, k in rows])
    model = fit(docs.filter(~held_out("doc_id", 3, 1)))
    got = predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, k in rows:
        assert 0 <= by[i].score <= 1
        if t and any(c.isalpha() for c in t):
            assert k is None or by[i].lang_pred == k
        else:
            assert by[i].lang_pred == "und" and by[i].rejected
    kept = {r.doc_id for r in accepted(docs, model).collect()}
    assert kept == {i for i, t, _ in rows if t and any(c.isalpha() for c in t)}
    assert accepted(docs, model).columns == docs.columns
    strange = docs_of(spark, [(1, "".join(chr(random.randint(0x5000, 0x8000)) for _ in range(200)))])
    assert predict(strange, model).first().rejected
    empty = docs.limit(0)
    assert predict(empty, fit(empty)).count() == 0
    assert predict(docs, fit(empty)).filter("lang_pred <> 'und'").count() == 0


def plain_kneser_ney(texts):
    """Interpolated Kneser-Ney of order 4 over characters, straight from its definition."""
    counts = [None] * 5
    counts[4] = Counter()
    for t in texts:
        s = "\0\0 " + " ".join(t.lower().split()) + " "
        counts[4].update(s[i - 3 : i + 1] for i in range(3, len(s)))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def discount(n):
        n1, n2 = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(context, c, n):
        if n == 0:
            return 2.0**-16
        context = context[len(context) - n + 1 :]
        followers = {g[-1]: k for g, k in counts[n].items() if g[:-1] == context}
        if not followers:
            return p(context, c, n - 1)
        total, d = sum(followers.values()), discount(n)
        return max(followers.get(c, 0) - d, 0) / total + d * len(followers) / total * p(context, c, n - 1)

    return lambda context, c: p(context, c, 4)


def test_kneser_ney_is_that_of_the_definition(spark):
    import numpy as np

    random.seed(21)
    texts = {k: [" ".join("".join(random.choices(letters, k=random.randint(1, 5))) for _ in range(12)) for _ in range(25)] for k, letters in (("en", "abcd"), ("xx", "bcé日"))}
    docs = docs_of(spark, [(i, t) for i, t in enumerate([*texts["en"], *texts["xx"]])], ["en"] * 25 + ["xx"] * 25)
    model = fit(docs)
    kept = {r.doc_id for r in docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) % 5 != 0).collect()}
    for j, lang in enumerate(model.langs):
        p = plain_kneser_ney([t for i, t in enumerate(texts[lang], 0 if lang == "en" else 25) if i in kept])
        unit = lambda c: 0 if c == "\0" else ord(c)
        for context in ("abc", "\0\0 ", "\0 b", " cb", "zzz", "日bc", "bzé", "d a"):
            key = lambda c: sum(unit(x) << 16 * (3 - i) for i, x in enumerate(context + c))
            alphabet = " abcdé日zß"
            got = np.exp(model.log_probs(np.array([key(c) for c in alphabet], dtype=np.uint64))[:, j].astype(float))
            want = [p(context, c) for c in alphabet]
            assert np.allclose(got, want, rtol=1e-4), (lang, context)
            # All other units share what is left, equally.
            assert math.isclose(got.sum() + (2**16 - len(alphabet)) * got[-1], 1, rel_tol=1e-4)


def test_language_id_of_very_long_texts_and_astral_letters(spark):
    random.seed(13)
    rows = [(i, ("aba bab " if i % 2 else "xyx yxy ") * 30) for i in range(400)]
    rows += [(400 + i, "".join(random.choices("abcdefghijklmnopqrstuvwxyzäöü", k=60))) for i in range(200)]
    docs = docs_of(spark, rows, ["yy" if i % 2 else "xx" for i in range(400)] + ["zz"] * 200)
    model = fit(docs)
    assert model.limits[0] == model.limits[1] < model.limits[2]  # each by its own rows
    got = {r.doc_id: r for r in predict(docs_of(spark, [(1, "aba bab " * 300_000), (2, "\U00010400\U00010428" * 400), (3, "aba " + "\U0001d400" * 3)]), model).collect()}
    assert got[1].lang_pred == "yy" and not got[1].rejected and got[2].rejected and got[3].lang_pred == "yy"


def test_hash_array_finds_all():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    keys = np.unique(keys)
    a = HashArray(keys[::2])
    pos = a.find(keys)
    assert (pos[::2] >= 0).all() and (pos[1::2] < 0).all()
    assert (keys[::2][a.order[pos[::2]]] == keys[::2]).all()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            g, n = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in g.split(".")), "card": lambda: 12 <= len(n) <= 19 and luhn(n), "phone": lambda: 9 <= len(n) <= 15}[kind]()
            if ok:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_pii_base_spans(spark):
    from lorekeep.llm.pii_bootstrap import find, redact

    random.seed(9)
    bits = ["a", "b.", "_", "@", "x-y", ".com", "1", "22", ".", "+", "+1 ", "(", ")", "-", " ", "4111 1111 1111 1111", "10.0.0.1", "é", "\n", "256.1.1.1", "a@b.co", "0000010.2.3.4", "😀", "password=", "12345678"]
    rows = [(i, "".join(random.choice(bits) for _ in range(random.randint(0, 40)))) for i in range(400)]
    rows += [(1000, "1" * 20000), (1001, "a" * 20000), (1002, None), (1003, ""), (1004, "x@y" + ".z" * 9000), (1005, "a@b.c " * 300), (1, rows[1][1])]
    docs = docs_of(spark, rows).repartition(4)
    got = find(docs).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = base_spans(texts[r.doc_id] or "")
        assert [(s.start, s.rank, s.end) for s in r.base] == want
        assert set(want) <= {(s.start, s.rank, s.end) for s in r.spans}
    masked = {r.doc_id: r for r in redact(docs).collect()}
    assert masked[1002].text is None and masked[1003].text == "" and masked[1005].text == "<EMAIL> " * 300
    assert redact(docs).columns == docs.columns
    assert find(docs.limit(0)).count() == 0


def test_pii_discovers_unseen_identifiers(spark):
    from lorekeep.llm.pii_bootstrap import find

    rows = [(i, f"please write to user{i}.name@host{i % 7}.example.com today") for i in range(40)]
    rows += [(100 + i, f"please write to member-{i}4471{i}82 today") for i in range(5)] + [(200, "we counted 123456789 cells in it")]
    got = {r.doc_id: r for r in find(docs_of(spark, rows)).collect()}
    for i in range(5):
        extra = [s for s in got[100 + i].spans if s.rank == 4]
        assert len(extra) == 1 and rows[40 + i][1][extra[0].start : extra[0].end].startswith("member-")
    assert not [s for s in got[200].spans if s.rank == 4]


def test_pii_takes_time_in_proportion(spark):
    """A text of 50 000 matches in seconds, twice as many in about twice that."""
    import time

    from lorekeep.llm.pii_bootstrap import find, redact

    took = []
    for n in (1000, 50_000, 100_000):
        text = " ".join(f"é user{i}@host.example" for i in range(n))
        docs = docs_of(spark, [(1, text)])
        began = time.time()
        row = find(docs).first()
        took.append(time.time() - began)
        assert len(row.base) == n and text[row.base[-1].start : row.base[-1].end] == f"user{n - 1}@host.example"
        if n == 50_000:
            assert redact(docs).first().text == " ".join(["é <EMAIL>"] * n)
    assert took[1] < 30 and took[2] < 3 * took[1] + 2


def test_pii_discovery_has_precision_and_recall(spark):
    """Unseen identifiers behind the contexts of seeds of all kinds, among numbers that are none."""
    from lorekeep.llm.pii_bootstrap import find

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    seed = [lambda: f"user{rng.randint(0, 9**6)}@{word()}.example", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: "4111 1111 1111 1111", lambda: f"+1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)}"]
    contexts = ["please write to", "logged in from", "charged the card", "call me at"]
    rows, planted = [], {}
    for i in range(600):
        k = i % 4
        rows.append((i, f"{word()} {word()} {contexts[k]} {seed[k]()} {word()}"))
    for i in range(200):  # identifiers no base pattern matches
        token = f"{word()}-{rng.randint(10**5, 10**7)}"
        rows.append((1000 + i, f"{word()} {contexts[i % 2]} {token} {word()}"))
        planted[1000 + i] = token
    rows += [(2000 + i, f"{word()} we counted {rng.randint(10**5, 10**8)} {word()}") for i in range(300)]
    texts, found = dict(rows), {}
    for r in find(docs_of(spark, rows)).collect():
        for s in r.spans:
            if s.rank == 4:
                found.setdefault(r.doc_id, []).append(texts[r.doc_id][s.start : s.end])
    right = sum(found.get(i) == [t] for i, t in planted.items())
    print("discovery: precision", right / max(1, sum(map(len, found.values()))), "recall", right / len(planted))
    assert right >= 0.95 * len(planted) and sum(map(len, found.values())) <= 1.05 * right


def brute_radix(rows, window):
    counts = Counter()
    for _, t in rows:
        b = (t or "").encode()
        counts.update(b[s : s + window] for s in range(len(b) - window + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if counts[b[s : s + window]] > 1:
                cover[s : s + window] = b"\x01" * window
        spans = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        out.append((i, len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, y in zip(b, cover) if not y)).hexdigest()))
    return sorted(out, key=repr)


def brute_words(rows, size):
    """(id, words covered by repeated windows of ``size`` words)."""
    counts, out = Counter(), []
    for _, t in rows:
        w = (t or "").encode().split()
        counts.update(tuple(w[s : s + size]) for s in range(len(w) - size + 1))
    for i, t in rows:
        w = (t or "").encode().split()
        out.append((i, len({k for s in range(len(w) - size + 1) if counts[tuple(w[s : s + size])] > 1 for k in range(s, s + size)})))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,gram,hot", [(12, 4, 4096), (20, 8, 1), (9, 8, 3)])
def test_suffix_radix_matches_brute_force(spark, window, gram, hot):
    from lorekeep.llm.suffix_radix import remove_repeats

    random.seed(window)
    bits = ["ab", "abc", "xyz", "q", "a", "é", "the cat", "aaaa", "bb "]
    rows = [(i, "".join(random.choice(bits) for _ in range(random.randint(0, 60)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "ab" * 24), (None, "zzz the cat ab" * 3), (53, "hello world this is " * 5), rows[3], rows[3], (7, "a" * 40)]
    rows += [(60 + i, " ".join(random.choices(["red", "green", "blue", "one\ttwo"], k=30))) for i in range(12)]
    got = remove_repeats(docs_of(spark, rows), window=window, gram=gram, hot_runs=hot, words=6, word_gram=2).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_radix(rows, window)
    assert sorted(((r.doc_id, r.n_repeated_words) for r in got), key=repr) == brute_words(rows, 6)
    assert remove_repeats(docs_of(spark, rows).limit(0), window=window, gram=gram).count() == 0


def test_long_texts_are_cut_into_segments_without_loss(monkeypatch):
    import numpy as np
    from lorekeep.llm import suffix_radix

    raw = bytes(random.Random(1).choices(b"abcdef", k=5000))
    monkeypatch.setattr(suffix_radix, "_SEGMENT", 700)
    items = np.frombuffer(raw, dtype=np.uint8)
    anchor, first, count, off = suffix_radix.anchor_runs(items, 50, 8)
    assert count.sum() == 5000 - 50 + 1 and (np.diff(first) == count[:-1]).all()


def test_brown_scores(spark):
    from lorekeep.llm.brown_lm import fit as fit_lm
    from lorekeep.llm.brown_lm import score

    random.seed(3)
    words = [f"W{i}" for i in range(60)]
    rows = [(i, " ".join(random.choices(words, weights=[60 - k for k in range(60)], k=50)) + (f" rare{i}" if i % 3 else "")) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "Unseen UNSEEN w1 w1"), (5, rows[5][1]), (503, "a\x1cb \x85c"), (504, ("L" * 200 + " ") * 30)]
    docs = docs_of(spark, rows)
    train = docs.filter(~held_out("doc_id", 7, 2))
    model, counts = fit_lm(train, least_head_count=4)
    got = score(docs, model, counts).collect()
    assert len(got) == len(rows)
    toks = lambda t: (t or "").encode().lower().split() + [b" "]
    c = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(toks(t))
    n, v = sum(c.values()), len(c)
    texts = dict(rows)
    for r in got:
        w = toks(texts[r.doc_id])
        assert r.n_tokens == len(w) and r.n_known == sum(c[x] > 0 for x in w) and r.train_tokens == n
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0
    nothing, none = fit_lm(train.limit(0))
    assert score(docs, nothing, none).count() == len(rows)


def test_brown_model_is_a_distribution(spark):
    """Probabilities of every known word and the unknown one sum to one after any class."""
    import numpy as np
    from lorekeep.llm.brown_lm import fit as fit_lm

    random.seed(8)
    rows = [(i, " ".join(random.choices([f"w{k}" for k in range(300)], weights=[300 / (k + 1) for k in range(300)], k=40))) for i in range(60)]
    model, counts = fit_lm(docs_of(spark, rows), least_head_count=6, seed_words=20, clusters=5)
    tail = [r["c"] for r in counts.filter(F.col("c") < model.tail_cut).collect()]
    bands = [x if x < 16 else 16 + math.floor(16 * math.log2(x / 16)) for x in [0, *tail]]
    inner = sum(10 ** (model.tail_logs[b] + math.log10(max(x, 1))) for b, x in zip(bands, [0, *tail]))
    assert math.isclose(inner, 1, rel_tol=1e-6)
    heads = np.bincount(model.symbol, weights=10**model.emission, minlength=len(model.transition))
    heads[-1] = inner
    heads[np.setdiff1d(np.arange(len(heads) - 1), model.symbol)] = 1  # a class left empty gives to no word
    assert np.allclose((10**model.transition) @ heads, (10**model.transition).sum(axis=1), rtol=1e-6)
    assert np.allclose((10**model.transition).sum(axis=1), 1, rtol=1e-6)


def test_brown_score_is_that_of_the_classes(spark):
    """Class bigrams and emissions counted plainly from the classes give the score; the classes are those of the planted roles."""
    import numpy as np
    from lorekeep.llm.brown_lm import fit as fit_lm
    from lorekeep.llm.brown_lm import score, tokens

    rng = random.Random(12)
    roles = [[f"{r}{i}" for i in range(60)] for r in "abc"]
    rows = [(i, " ".join(rng.choice(roles[j % 3]) for j in range(30)) + (f" odd{i}" if i % 2 else "")) for i in range(500)]
    docs = docs_of(spark, rows)
    model, counts = fit_lm(docs, clusters=4, seed_words=20, least_head_count=4)
    label = lambda w: int(model.symbol[model.head[w]]) if w in model.head else 4
    found = [[label(w.encode()) for w in words] for words in roles]
    assert all(Counter(f).most_common(1)[0][1] >= 0.9 * len(f) for f in found) and len({Counter(f).most_common(1)[0][0] for f in found}) == 3
    joint, words = np.zeros((5, 5)), Counter()
    for _, t in rows:
        w = tokens(t.encode())
        words.update(w)
        for x, y in zip([b" ", *w], w):
            joint[label(x), label(y)] += 1
    share = (joint.sum(axis=0) + 0.5) / (joint.sum() + 2.5)
    step = np.log10((joint + 20 * share) / (joint.sum(axis=1, keepdims=True) + 20))
    size = Counter()
    for w, c in words.items():
        size[label(w)] += c
    singles = [w for w in words if w not in model.head]
    assert all(words[w] == 1 for w in singles)
    # Leave-one-out: every tail token is of a word seen once, so the mass of words seen never before is theirs.
    mass = {0: len(singles) + 1, 1: 1}
    for r in score(docs, model, counts).collect():
        w = tokens(dict(rows)[r.doc_id].encode())
        want = sum(step[label(x), label(y)] for x, y in zip([b" ", *w], w))
        want += sum(math.log10(words[x] / size[label(x)]) if x in model.head else math.log10(mass[1] / sum(mass.values()) / len(singles)) for x in w)
        assert math.isclose(r.score, want, rel_tol=1e-9)


def test_every_head_word_is_exchanged(spark):
    """In shards, the exchange raises the likelihood of the whole and leaves no word of the head out."""
    import numpy as np
    from lorekeep.llm import brown_lm

    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.8)) % 400}" for _ in range(60))) for i in range(150)]
    head = {w: i for i, w in enumerate([b" ", *sorted({x for _, t in rows for x in t.encode().split()})])}
    bigrams = brown_lm.Bigrams(docs_of(spark, rows), "text", head)
    dense = np.zeros((len(head) + 1,) * 2)
    for _, t in rows:
        ids = [0, *(head[w] for w in brown_lm.tokens(t.encode()))]
        np.add.at(dense, (ids[:-1], ids[1:]), 1)
    assert (bigrams.grid(np.arange(len(head) + 1), len(head) + 1) == dense).all()
    label, grid = brown_lm.cluster(bigrams, 6, 30, 3)
    assert (label[:-1] < 6).all() and label[-1] == 6
    member = np.eye(7)[label]
    assert np.allclose(member.T @ dense @ member, grid)
    start = np.append(np.arange(len(head)) % 6, 6)
    assert brown_lm.likelihood(grid) > brown_lm.likelihood(np.eye(7)[start].T @ dense @ np.eye(7)[start])


def test_exchange_ends_where_no_move_helps():
    import numpy as np
    from lorekeep.llm.brown_lm import exchange

    def likelihood(grid, label, k):
        m = np.eye(k)[label]
        g = m.T @ grid @ m
        x = lambda a: (a * np.log(np.maximum(a, 1))).sum()
        return x(g) - x(g.sum(axis=1)) - x(g.sum(axis=0))

    rng = np.random.default_rng(0)
    for _ in range(4):
        grid = rng.integers(0, 50, (14, 14)).astype(float)
        label = exchange(grid, 3, rounds=50)
        moves = [likelihood(grid, np.where(np.arange(14) == w, c, label), 3) for w in range(14) for c in range(3)]
        assert likelihood(grid, label, 3) >= max(moves) - 1e-6
    grid = rng.integers(0, 3, (8, 8)).astype(float)
    grid[:4, 4:] += 10
    grid[4:, :4] += 10
    label = exchange(grid, 2, rounds=50)
    assert len(set(label[:4])) == 1 and len(set(label[4:])) == 1 and label[0] != label[4]
