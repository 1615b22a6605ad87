"""Byte-pair encoding of a whole corpus with a public vocabulary.

Backtracking encoder: for every end position of a piece, an Aho-Corasick automaton over the vocabulary gives the longest
token that ends there; the token is taken if it is compatible with the last token of the text before it (the pair would
survive the merges), otherwise the next shorter one is tried.  The last tokens are then followed back from the end.  This
gives exactly the ids of the merge procedure in time linear in the text.

Within a task the distinct pieces of an Arrow batch are encoded side by side: one numpy step advances all of them by a
byte.  Spark partitions the documents; nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the vocabulary's pattern means it (the Unicode property); the standard module's own class also has U+001C
#: to U+001F, so it is never used.
SPACE = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The split pattern of the vocabulary and its form for ASCII texts, where the standard module is faster.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ASCII_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{SPACE}A-Za-z0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Longest piece that is encoded side by side with others; longer ones go one at a time.
LANE_BYTES = 96
#: Distinct pieces remembered by a worker before it starts anew (memory bound; never changes a result).
CACHE_PIECES = 400_000
PAIR_CACHE_BITS = 20
#: Characters handed to the encoder at once (memory bound; a longer text is encoded in parts cut before white space).
CHUNK_CHARS = 500_000


@dataclass(frozen=True)
class Vocabulary:
    """Tables of a byte-level BPE vocabulary; a few MB whatever the corpus, so they may be broadcast."""

    tokens: list[bytes]  # by id
    left: np.ndarray  # id of the left half a token was merged from; itself for a byte
    right: np.ndarray


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id, of a file with a base64 token and its rank per line."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def load_vocabulary(path: str) -> Vocabulary:
    """Read the vocabulary and find the two halves each token is merged from: the parts that are left when only merges
    of lower rank are applied to its bytes."""
    tokens = read_ranks(path)
    ids = {t: i for i, t in enumerate(tokens)}
    left, right = np.arange(len(tokens), dtype=np.int32), np.arange(len(tokens), dtype=np.int32)
    for i, t in enumerate(tokens):
        if len(t) > 1:
            parts = [t[k : k + 1] for k in range(len(t))]
            while len(parts) > 2:
                rank, k = min((ids.get(parts[k] + parts[k + 1], i), k) for k in range(len(parts) - 1))
                if rank >= i:
                    raise ValueError(f"token {i} cannot be merged")
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            left[i], right[i] = ids[parts[0]], ids[parts[1]]
    return Vocabulary(tokens, left, right)


class Encoder:
    """The automaton and pair tables of a vocabulary, built once per worker."""

    def __init__(self, v: Vocabulary):
        self.tokens, self.left, self.right = v.tokens, v.left, v.right
        self.length = np.array([len(t) for t in v.tokens], dtype=np.int32)
        self._automaton()
        self._pairs()
        size = 1 << PAIR_CACHE_BITS
        self.seen, self.seen_ok = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=bool)
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.pool: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def _automaton(self) -> None:
        """Goto and failure transitions in one dense table, level by level; for each state the longest token that ends
        there, and for each token the next shorter one that ends with it."""
        children: list[dict[int, int]] = [{}]
        own = [-1]
        for i, t in enumerate(self.tokens):
            s = 0
            for b in t:
                nxt = children[s].get(b)
                if nxt is None:
                    nxt = children[s][b] = len(children)
                    children.append({})
                    own.append(-1)
                s = nxt
            own[s] = i
        n = len(children)
        step = np.zeros((n, 256), dtype=np.int32)
        own_a, fail = np.array(own, dtype=np.int32), np.zeros(n, dtype=np.int32)
        longest = own_a.copy()
        self.shorter = np.full(len(self.tokens), -1, dtype=np.int32)
        level = [0]
        while level:
            rows = [(p, b, c) for p in level for b, c in children[p].items()]
            level = [c for _, _, c in rows]
            if not rows:
                break
            p, b, c = np.array(rows, dtype=np.int64).T
            fail[c] = np.where(p == 0, 0, step[fail[p], b])
            step[p, b] = c
            step[c] = step[fail[c]]
            under = longest[fail[c]]
            is_token = own_a[c] >= 0
            self.shorter[own_a[c][is_token]] = under[is_token]
            longest[c] = np.where(is_token, own_a[c], under)
        self.step, self.longest = step.reshape(-1), longest

    def _pairs(self) -> None:
        """Open-addressing table of the merges: (left, right) to the merged id."""
        ids = np.flatnonzero(self.length > 1)
        keys = self.left[ids].astype(np.int64) << 20 | self.right[ids]
        self.bits = max(12, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.slot_key, self.slot_id = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        at, todo = self._slot(keys, self.bits), np.arange(len(keys))
        while len(todo):
            free = self.slot_key[at[todo]] < 0
            cand = todo[free]
            _, once = np.unique(at[cand], return_index=True)
            put = cand[once]
            self.slot_key[at[put]], self.slot_id[at[put]] = keys[put], ids[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = np.where(self.slot_key[at[todo]] >= 0, (at[todo] + 1) & ((1 << self.bits) - 1), at[todo])

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the token that a and b merge into, a huge number where there is none."""
        keys = a.astype(np.int64) << 20 | b
        at, out = self._slot(keys, self.bits), np.full(len(keys), 1 << 30, dtype=np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            found = self.slot_key[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.slot_id[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def _survives(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave a border between the tokens a and b: undo the merges of both from the latest back and
        see whether one across the border would have come first."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit, ok = np.full(len(a), 1 << 29, dtype=np.int64), np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self._merged(x, y) < limit[live]
            ok[live[across]] = False
            byte_x, byte_y = self.length[x] == 1, self.length[y] == 1
            go = ~across & ~(byte_x & byte_y)
            undo_x = go & ~byte_x & (byte_y | (x > y))
            undo_y = go & ~undo_x
            i, j = live[undo_x], live[undo_y]
            limit[i], limit[j] = x[undo_x], y[undo_y] + 1
            a[i], b[j] = self.right[x[undo_x]], self.left[y[undo_y]]
            live = live[go]
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pair-compatibility table, filled as pairs are met."""
        keys = a.astype(np.int64) << 20 | b
        at = self._slot(keys, PAIR_CACHE_BITS)
        ok, known = self.seen_ok[at], self.seen[at] == keys
        if not known.all():
            new = np.flatnonzero(~known)
            fresh, back = np.unique(keys[new], return_inverse=True)
            got = self._survives(fresh >> 20, fresh & ((1 << 20) - 1))
            ok[new] = got[back]
            self.seen[at[new]], self.seen_ok[at[new]] = keys[new], ok[new]
        return ok

    def encode_lanes(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of ids of each)."""
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        text = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        start = (np.cumsum(size) - size)[order]
        size = size[order]
        width = int(size[0]) if len(size) else 0
        last = np.full((width, len(pieces)), -1, dtype=np.int32)  # by end position: the last token of the text up to it
        state = np.zeros(len(pieces), dtype=np.int64)
        lanes = np.searchsorted(-size, -np.arange(1, width + 1), side="right")
        for e in range(width):
            n = lanes[e]
            state = self.step[state[:n] * 256 + text[start[:n] + e]].astype(np.int64)
            token = self.longest[state].copy()
            todo = np.arange(n)
            while len(todo):
                t = token[todo]
                before = e - self.length[t]
                joined = before >= 0
                bad = np.zeros(len(todo), dtype=bool)
                if joined.any():
                    prev = last[before[joined], todo[joined]]
                    bad[joined] = ~self.compatible(prev, t[joined])
                todo = todo[bad]
                token[todo] = self.shorter[token[todo]]
            last[e, :n] = token
        # back from the end, all pieces together
        at, lane = size - 1, np.arange(len(pieces))
        got_lane, got_token = [], []
        while len(lane):
            t = last[at, lane]
            got_lane.append(lane)
            got_token.append(t)
            at = at - self.length[t]
            go = at >= 0
            at, lane = at[go], lane[go]
        if not got_lane:
            return np.empty(0, dtype=np.int32), np.zeros(len(pieces), dtype=np.int64)
        all_lane, depth = np.concatenate(got_lane), np.concatenate([np.full(len(x), i) for i, x in enumerate(got_lane)])
        by = np.lexsort((-depth, order[all_lane]))
        return np.concatenate(got_token)[by], np.bincount(order[all_lane], minlength=len(pieces))

    def encode_long(self, piece: bytes) -> np.ndarray:
        """The same for one long piece, byte by byte."""
        step, longest, shorter, length = self.step, self.longest, self.shorter, self.length
        last: list[int] = []
        state, memo = 0, {}
        for e, b in enumerate(piece):
            state = int(step[state * 256 + b])
            t = int(longest[state])
            while (k := e - int(length[t])) >= 0:
                pair = (last[k], t)
                ok = memo.get(pair)
                if ok is None:
                    ok = memo[pair] = bool(self._survives(np.array([pair[0]]), np.array([pair[1]]))[0])
                if ok:
                    break
                t = int(shorter[t])
            last.append(t)
        out, at = [], len(piece) - 1
        while at >= 0:
            out.append(last[at])
            at -= int(length[last[at]])
        return np.array(out[::-1], dtype=np.int32)

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode("utf-8") for p in pieces]
        short = [i for i, r in enumerate(raw) if len(r) <= LANE_BYTES]
        ids, sizes = self.encode_lanes([raw[i] for i in short])
        base = len(self.codes)
        for k, i in enumerate(short):
            self.codes[pieces[i]] = base + k
        self.pool.append(ids)
        self.sizes.append(sizes)
        for i, r in enumerate(raw):
            if len(r) > LANE_BYTES:
                got = self.encode_long(r)
                self.codes[pieces[i]] = len(self.codes)
                self.pool.append(got)
                self.sizes.append(np.array([len(got)]))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); null and empty texts have none."""
        parts = [parts_of(t) for t in texts]
        flat = [p for doc in parts for p in doc]
        ids, n, first = [], [], 0
        while first < len(flat):
            last, chars = first, 0
            while last < len(flat) and (last == first or chars + len(flat[last]) <= CHUNK_CHARS):
                chars += len(flat[last])
                last += 1
            got, m = self._encode_chunk(flat[first:last])
            ids.append(got)
            n.append(m)
            first = last
        per_part = np.concatenate([[0], np.cumsum(np.concatenate(n))]) if n else np.zeros(1, dtype=np.int64)
        bounds = per_part[np.concatenate([[0], np.cumsum([len(d) for d in parts])]).astype(np.int64)]
        return np.concatenate(ids) if ids else np.empty(0, dtype=np.int32), np.diff(bounds)

    def _encode_chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > CACHE_PIECES:
            self._forget()
        pieces = [_ASCII.findall(t) if t.isascii() else _ANY.findall(t) for t in texts]
        flat = [p for doc in pieces for p in doc]
        new = [p for p in dict.fromkeys(flat) if p not in self.codes]
        if new:
            self._learn(new)
            self.pool, self.sizes = [np.concatenate(self.pool)], [np.concatenate(self.sizes)]
        if not flat:
            return np.empty(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        pool, sizes = self.pool[0], self.sizes[0]
        first = np.cumsum(sizes) - sizes
        code = np.fromiter(map(self.codes.__getitem__, flat), dtype=np.int64, count=len(flat))
        n = sizes[code]
        ends = np.cumsum(n)
        take = np.arange(int(ends[-1])) + np.repeat(first[code] - (ends - n), n)
        per_doc = np.array([len(d) for d in pieces])
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_doc)])]
        return pool[take].astype(np.int32), np.diff(bounds)


def parts_of(text: str | None) -> list[str]:
    """A text in parts of about CHUNK_CHARS.  A cut before white space that follows something else never parts a piece
    and changes no piece beside it."""
    if not text:
        return []
    out, at = [], 0
    while len(text) - at > CHUNK_CHARS and (cut := _CUT.search(text, at + CHUNK_CHARS)):
        out.append(text[at : cut.end()])
        at = cut.end()
    return [*out, text[at:]]


_CUT = re.compile(rf"[^{SPACE}](?=[{SPACE}])")
_ANY, _ASCII = regex.compile(PIECES), re.compile(ASCII_PIECES)
_ENCODERS: dict[tuple, Encoder] = {}


def encoder_of(v: Vocabulary) -> Encoder:
    """The worker's encoder of a vocabulary."""
    key = (len(v.tokens), v.tokens[-1], v.tokens[len(v.tokens) // 2])
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(v)
    return _ENCODERS[key]


def _over_texts(df: DataFrame, vocabulary_path: str, doc_id: str, text: str, keep: list[str], field: T.StructField, column) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    names = [*dict.fromkeys([doc_id, *keep])]
    schema = T.StructType([*[df.schema[c] for c in names], field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared.value)
        for batch in batches:
            ids, n = enc.encode(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], column(ids, n)], names=[f.name for f in schema])

    return df.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)


def encode_corpus(df: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, *keep, ids): the ids of each whole text, without special tokens (their strings are ordinary text).

    Every row of ``df`` gives one row.  A null or empty text has the empty list.
    """
    lists = lambda ids, n: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), type=pa.int32()), pa.array(ids, type=pa.int32()))
    return _over_texts(df, vocabulary_path, doc_id, text, keep or [], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), lists)


def count_tokens(df: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, *keep, n_tokens) by the same encoder, without handing the ids on."""
    return _over_texts(df, vocabulary_path, doc_id, text, keep or [], T.StructField("n_tokens", T.LongType(), False), lambda ids, n: pa.array(n, type=pa.int64()))


def decode_corpus(df: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", ids: str = "ids", keep: list[str] | None = None, out: str = "text") -> DataFrame:
    """(doc_id, *keep, out): the text of each list of ids, by an offset table over the joined token bytes.  Ids outside the
    vocabulary raise an error; bytes that are no UTF-8 become replacement characters; a null list gives null."""
    tokens = read_ranks(vocabulary_path)
    shared = df.sparkSession.sparkContext.broadcast(tokens)
    names = [*dict.fromkeys([doc_id, *(keep or [])])]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toks = shared.value
        data = np.frombuffer(b"".join(toks), dtype=np.uint8)
        size = np.array([len(t) for t in toks], dtype=np.int64)
        offset = np.cumsum(size) - size
        for batch in batches:
            col = batch.column(ids)
            flat = col.flatten().to_numpy(zero_copy_only=False)
            n = size[flat]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            raw = data[np.arange(total) + np.repeat(offset[flat] - (ends - n), n)].tobytes()
            per_doc = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_doc)])]
            texts = [None if null else raw[a:b].decode("utf-8", "replace") for a, b, null in zip(bounds[:-1], bounds[1:], col.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, type=pa.string())], names=[*names, out])

    return df.select(*dict.fromkeys([*names, ids])).mapInArrow(run, schema)


def round_trip(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """(source, n_docs, n_equal, n_other, n_lost, n_twice): the documents of each source by what comes back when they are
    encoded and decoded again: the same text, another one, nothing, or more than one row.  A null text comes back empty.
    The text travels with its row, so that only ids are joined."""
    back = decode_corpus(encode_corpus(documents, vocabulary_path, keep=["text"]), vocabulary_path, keep=["text"], out="_back")
    same = back.groupBy("doc_id").agg(F.count("*").alias("_rows"), F.count_if(F.col("_back") == F.coalesce("text", F.lit(""))).alias("_same"))
    given = documents.groupBy("doc_id", "source").agg(F.count("*").alias("_given"))
    rows = given.join(same, "doc_id", "full")
    at = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.groupBy("source").agg(
        F.sum(at("_given")).alias("n_docs"), F.sum(at("_same")).alias("n_equal"), F.sum(at("_rows") - at("_same")).alias("n_other"),
        F.sum(F.greatest(at("_given") - at("_rows"), F.lit(0))).alias("n_lost"), F.sum(F.greatest(at("_rows") - at("_given"), F.lit(0))).alias("n_twice"),
    )
