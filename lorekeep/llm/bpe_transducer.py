"""Byte-level BPE by a lazily determinised finite-state transducer.

Merging by rank gives every byte string one token sequence, and a sequence is that
one exactly if each adjacent pair of its tokens merges back to itself.  So the
encodings of all prefixes are paths of a nondeterministic transducer: a
configuration is (last whole token, trie node of the token begun).  Determinised
states are sets of live configurations, each with the tokens it still owes; what
all owe in common is emitted at once, after no more lookahead than the longest
token needs.  States and transitions are made when a text first needs them; the
table is emptied when it reaches ``max_states``, which changes no result.  Spellings of
short pre-tokens are kept in two generations: what was not met while the younger one
filled up is dropped, so frequent words stay whatever the number of rare ones.

Decoding runs an incremental UTF-8 state machine over the token bytes, so that a
stream may be cut at any token.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, utf8


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Encoder of single pre-tokens for one rank table."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000, max_words: int = 400_000, max_pairs: int = 800_000):
        self.ranks, self.max_states, self.max_words, self.max_pairs = ranks, max_states, max_words, max_pairs
        self.bytes_of = {r: t for t, r in ranks.items()}
        # Trie: node 0 is the root; children by (node << 8 | byte).
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.child[key]
            self.token_at[node] = rank
        self.inner = bytearray(len(self.token_at))
        for key in self.child:
            self.inner[key >> 8] = 1
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, tuple[list, list]] = {}
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self._forget()

    def _forget(self) -> None:
        self.number: dict[tuple, int] = {}
        self.configs: list[tuple] = []
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.start = self._state(((-1, 0, ()),))

    def _state(self, configs: tuple) -> int:
        if configs not in self.number:
            self.number[configs] = len(self.configs)
            self.configs.append(configs)
        return self.number[configs]

    def _spines(self, token: int) -> tuple[list, list]:
        """Lives of the parts at both ends of a token while it is merged: (bytes, made at, merged away at), as ranks."""
        known = self.spines.get(token)
        if known is None:
            data, ranks, never = self.bytes_of[token], self.ranks, 1 << 60
            parts = [data[i : i + 1] for i in range(len(data))]
            left, right = [[parts[0], -1, never]], [[parts[-1], -1, never]]
            while len(parts) > 1:
                rank, at = min((ranks.get(parts[i] + parts[i + 1], never), i) for i in range(len(parts) - 1))
                if rank == never:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                for spine, end in ((left, 0), (right, len(parts) - 1)):
                    if at == end:
                        spine[-1][2] = rank
                        spine.append([parts[at], rank, never])
            known = self.spines[token] = ([tuple(x) for x in left], [tuple(x) for x in right])
        return known

    def may_follow(self, a: int, b: int) -> bool:
        """Whether b may stand after a: no part at a's right end ever merges with one at b's left end.

        Two parts can merge if they live at the same time and their rank comes
        before either is merged away; of equal ranks the left one comes first.
        """
        known = self.pairs.get(a << 20 | b)
        if known is None:
            known, get = True, self.ranks.get
            for x, x_made, x_gone in self._spines(a)[1]:
                for y, y_made, y_gone in self._spines(b)[0]:
                    if x_made < y_gone and y_made < x_gone:
                        rank = get(x + y)
                        if rank is not None and rank < x_gone and rank <= y_gone:
                            known = False
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            self.pairs[a << 20 | b] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one transition: (next state, tokens now certain)."""
        nxt = []
        child, token_at, inner = self.child, self.token_at, self.inner
        for last, node, owed in self.configs[state]:
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            token = token_at[to]
            if token >= 0 and (last < 0 or self.may_follow(last, token)):
                nxt.append((token, 0, (*owed, token)))
            if inner[to]:  # else no later byte can complete the token begun
                nxt.append((last, to, owed))
        first = nxt[0][2]
        common = len(first)
        for c in nxt:
            owed = c[2]
            if len(owed) < common:
                common = len(owed)
            while first[:common] != owed[:common]:
                common -= 1
        if common:
            nxt = [(last, node, owed[common:]) for last, node, owed in nxt]
        return self._state(tuple(nxt)), first[:common]

    def run(self, data: bytes) -> list[int]:
        """Tokens of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.configs) > self.max_states:
            self._forget()
        out: list[int] = []
        state, steps = self.start, self.steps
        for byte in data:
            key = state << 8 | byte
            step = steps.get(key)
            if step is None:
                if len(self.configs) > 2 * self.max_states:  # a very long pre-token: keep only the live state
                    live = self.configs[state]
                    self._forget()
                    state, steps = self._state(live), self.steps
                    key = state << 8 | byte
                step = steps[key] = self._step(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        for _, node, owed in self.configs[state]:
            if node == 0:
                return out + list(owed)
        raise ValueError("no segmentation: the rank table lacks single bytes")

    def spelled(self, piece: str) -> str:
        """Ids of one pre-token as decimals joined by one space."""
        known = self.words.get(piece)
        if known is None:
            known = self.older.get(piece)
            if known is None:
                known = " ".join(map(str, self.run(piece.encode())))
            if len(piece) < 64:
                if 2 * len(self.words) >= self.max_words:
                    self.older = dict(self.words)
                    self.words.clear()  # the same dictionary: callers hold it over a text
                self.words[piece] = known
        return known


class Encoder:
    """Whole texts: pre-tokens by ``pattern``, each through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, **limits: int):
        self.fst = Transducer(ranks, **limits)
        self.split = regex.compile(pattern).finditer
        self.findall = regex.compile(pattern).findall

    def spelled_parts(self, text: str, block: int = 1 << 16) -> Iterator[str]:
        """Decimal ids, in blocks of at most ``block`` pre-tokens; joined by one space they are the encoding."""
        words, spelled = self.fst.words, self.fst.spelled
        if len(text) <= block:
            pieces = self.findall(text)
            if pieces:
                yield " ".join([words.get(p) or spelled(p) for p in pieces])
            return
        part: list[str] = []
        for m in self.split(text):
            part.append(spelled(m.group()))
            if len(part) == block:
                yield " ".join(part)
                part = []
        if part:
            yield " ".join(part)

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.spelled_parts(text) for i in part.split(" ")]


# Classes and transitions of the UTF-8 automaton: state 0 is between characters.
_CONT, _BAD = range(0x80, 0xC0), 99


def _utf8_table() -> list[list[int]]:
    """state -> byte -> state; 1..3 await that many continuation bytes, 4..7 are the lead bytes with a narrower second byte."""
    t = [[_BAD] * 256 for _ in range(8)]
    for b in range(0x80):
        t[0][b] = 0
    for b in range(0xC2, 0xE0):
        t[0][b] = 1
    for b in range(0xE1, 0xF0):
        t[0][b] = 2
    for b in range(0xF1, 0xF4):
        t[0][b] = 3
    t[0][0xE0], t[0][0xED], t[0][0xF0], t[0][0xF4] = 4, 5, 6, 7
    for b in _CONT:
        t[1][b], t[2][b], t[3][b] = 0, 1, 2
        t[4][b] = 1 if b >= 0xA0 else _BAD
        t[5][b] = 1 if b < 0xA0 else _BAD
        t[6][b] = 2 if b >= 0x90 else _BAD
        t[7][b] = 2 if b < 0x90 else _BAD
    return t


class Utf8Stream:
    """Incremental UTF-8: ``feed`` bytes cut anywhere, get the text of the whole characters so far."""

    _table = _utf8_table()

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        # Only the last three bytes can be an unfinished character: run the automaton from its lead byte.
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] < 0x80:
                break
            if data[-back] >= 0xC0:
                state = 0
                for b in data[-back:]:
                    state = self._table[state][b]
                    if state == _BAD:
                        break
                if state != 0:
                    cut = len(data) - back
                break
        self.pending = data[cut:]
        return data[:cut].decode()

    def close(self) -> None:
        if self.pending:
            raise UnicodeDecodeError("utf-8", self.pending, 0, len(self.pending), "unexpected end of tokens")


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes], block: int = 1 << 14) -> Iterator[str]:
    """Text pieces of a token stream; characters that span tokens come out once they are whole."""
    stream, held = Utf8Stream(), []
    for i in ids:
        held.append(bytes_of[i])
        if len(held) == block:
            yield stream.feed(b"".join(held))
            held = []
    yield stream.feed(b"".join(held))
    stream.close()


_ENCODERS: dict[tuple, Encoder] = {}


def worker_encoder(key: tuple, ranks: bytes, pattern: str, **limits: int) -> Encoder:
    """One encoder a Python worker; its tables last over tasks, until another operator runs in the worker."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(parse_ranks(ranks), pattern, **limits)
    return _ENCODERS[key]


def drop_encoders() -> None:
    _ENCODERS.clear()


def encode_documents(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    max_states: int = 200_000,
    max_words: int = 400_000,
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) of each whole text.

    The rank file (of a fixed size, under 1 MB) is read on the driver and
    broadcast.  Null and empty texts have no tokens and the digests of no bytes.
    Repeated ids keep one row each; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    with open(rank_file, "rb") as f:
        data = f.read()
    ranks, key = spark.sparkContext.broadcast(data), (hashlib.sha256(data).hexdigest(), pattern, max_states, max_words)

    def kernel(cols):
        enc = worker_encoder(key, ranks.value, pattern, max_states=max_states, max_words=max_words)
        tokens = {str(r): t for r, t in enc.fst.bytes_of.items()} if not hasattr(enc, "by_name") else enc.by_name
        enc.by_name = tokens
        n, coded, plain, all_ids = [], [], [], []
        for raw in cols["text"]:
            a, b, count, stream, first, kept = hashlib.sha256(), hashlib.sha256(), 0, Utf8Stream(), True, array("i")
            for part in enc.spelled_parts(raw.decode()):
                names = part.split(" ")
                count += len(names)
                a.update(part.encode() if first else b" " + part.encode())
                first = False
                b.update(stream.feed(b"".join([tokens[i] for i in names])).encode())
                if with_ids:
                    kept.extend(map(int, names))
            stream.close()
            n.append(count)
            coded.append(a.hexdigest())
            plain.append(b.hexdigest())
            all_ids.append(np.frombuffer(kept, dtype=np.int32) if kept else np.zeros(0, np.int32))
        out = {"doc_id": cols["doc_id"], "n_tokens": n, "ids_sha256": coded, "decoded_sha256": plain}
        return out | ({"ids": all_ids} if with_ids else {})

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    return map_rows(
        docs, [F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")], kernel, ddl, pa.schema(fields), 2 << 20, "text", ("bpe", drop_encoders)
    )
