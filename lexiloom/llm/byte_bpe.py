"""Byte-level BPE: ranked merges folded over the distinct words of a block.

One pass, without a shuffle.  A block of documents is split where the
vocabulary's pattern splits, the merges are folded over its distinct words, and
the documents are put together from their words' ids and binary pieces.  Two
ways to fold give the same ids:

``encode``, which the query uses, folds all words of a block at once in Arrow
batches: each step takes every word's smallest rank (the first of equals),
replaces the pair and looks up the two new pairs.

``encode_folded`` folds in Spark higher-order functions, between two Arrow
steps: the state of a word is the list of its tokens with the rank of each
neighbouring pair; the ranks are one literal, an array of small maps dealt out
by a hash of the pair, so that a lookup reads one of them.  It costs about five
times as much CPU (see the README).

A word of more than ``FOLDED_BYTES`` bytes would take a fold of quadratic cost;
the same merges are then made with a heap.

Null and empty texts have no ids.  Repeated rows are encoded each; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.textblocks import blocks, buffer_of, encoded, gather, pretoken_chunks, slices
from lexiloom.sources.corpus import ship

FOLDED_BYTES = 48
BLOCK = 16 << 20
SLICE_WORDS = 2048
BUCKETS = 1 << 15
NONE = (1 << 31) - 1
_SIMPLE = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Rank of the token that two neighbouring tokens make."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


def _bucket(a: int, b: int) -> int:
    return (a * 40503 + b * 25457) % BUCKETS


def merge_column(word: Column, ranks: dict[bytes, int]) -> Column:
    """Token ids of ``word``, an array of byte values, as an expression of built-in functions."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for (a, b), rank in pair_ranks(ranks).items():
        maps[_bucket(a, b)][str(a * 65536 + b)] = rank
    table = F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>").cast("array<map<bigint,int>>")
    first = F.from_json(F.lit(json.dumps([ranks.get(bytes([i]), NONE) for i in range(256)])), "array<int>")

    def rank_of(a: Column, b: Column) -> Column:
        a, b = a.cast("bigint"), b.cast("bigint")
        found = F.element_at(F.get(table, ((a * 40503 + b * 25457) % BUCKETS).cast("int")), a * 65536 + b)
        return F.coalesce(found, F.lit(NONE))

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def step(state: Column, _: Column) -> Column:
        def merge(best: Column) -> Column:
            def at(j: Column) -> Column:  # the pair's place, from 1
                t, r, n = state.t, state.r, F.size(state.t)
                left = F.when(j > 1, F.array(rank_of(F.get(t, j - 2), best))).otherwise(F.array().cast("array<int>"))
                right = F.when(j + 1 < n, F.array(rank_of(best, F.get(t, j + 1)))).otherwise(F.array().cast("array<int>"))
                tokens = F.concat(F.slice(t, F.lit(1), j - 1), F.array(best), F.slice(t, j + 2, n))
                pairs = F.concat(F.slice(r, F.lit(1), F.greatest(j - 2, F.lit(0))), left, right, F.slice(r, j + 2, n))
                return F.struct(tokens.alias("t"), pairs.alias("r"))

            return F.when(best == NONE, state).otherwise(let(F.array_position(state.r, best).cast("int"), at))

        return F.when(F.size(state.r) == 0, state).otherwise(let(F.array_min(state.r), merge))

    tokens = F.transform(word, lambda b: F.get(first, b))

    def folded(t: Column) -> Column:
        pairs = F.transform(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda b, i: rank_of(F.get(t, i), b))
        start = F.struct(t.alias("t"), pairs.alias("r"))
        return F.aggregate(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), start, step, lambda s: s.t)

    return let(tokens, folded)


def piece_column(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that ``ids`` stand for: their binary pieces, concatenated."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    table = F.from_json(F.lit(json.dumps([base64.b64encode(p).decode() for p in pieces])), "array<binary>")
    return F.aggregate(ids, F.lit(b""), lambda done, i: F.concat(done, F.get(table, i)))


def heap_merge(word: bytes, pairs: dict[tuple[int, int], int], first: list[int]) -> list[int]:
    """The merges of one long word: linked neighbours and a heap of (rank, place)."""
    token = [first[b] for b in word]
    n = len(token)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := pairs.get((token[i], token[i + 1]))) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or pairs.get((token[i], token[j])) != rank:
            continue
        token[i], gone[j], after[i] = rank, 1, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := pairs.get((token[a], token[b]))) is not None:
                heapq.heappush(heap, (r, a))
    return [t for t, g in zip(token, gone) if not g]


class Words:
    """A block's documents as numbers of its distinct words (matches of the pattern)."""

    def __init__(self, texts: pa.Array, pattern: str):
        import regex

        data, off = buffer_of(texts)
        starts, ends, first = pretoken_chunks(data, off)
        codes, chunks = encoded(slices(data, np.append(starts, len(data))) if len(starts) else slices(data, np.zeros(1, np.int64)))
        simple = np.asarray(pc.match_substring_regex(chunks, _SIMPLE).to_numpy(zero_copy_only=False), bool)
        split = regex.compile(pattern).findall
        words: dict[str, int] = {}
        flat: list[int] = []
        counts = np.ones(len(chunks), np.int64)
        for i, (chunk, whole) in enumerate(zip(chunks.to_pylist(), simple.tolist())):
            if whole:
                flat.append(words.setdefault(chunk, len(words)))
            else:
                parts = split(chunk)
                counts[i] = len(parts)
                flat += [words.setdefault(p, len(words)) for p in parts]
        at = np.cumsum(counts) - counts
        self.words = [w.encode() for w in words]
        self.codes = gather(np.array(flat, np.int32), at[codes], counts[codes]) if len(codes) else np.zeros(0, np.int32)
        self.offsets = np.concatenate([[0], np.cumsum(counts[codes])])[first]


SENT = "words array<array<int>>, long array<binary>, doc_id long, codes binary"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_folded(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens and hashes of the ids and of the decoded bytes, the merges folded by Spark."""
    ship(docs.sparkSession)
    long_words = F.col("long")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("words", pa.list_(pa.list_(pa.int32()))), ("long", pa.list_(pa.binary())), ("doc_id", pa.int64()), ("codes", pa.binary())])
        for b in blocks(batches, "text", BLOCK):
            w = Words(b.column("text"), pattern)
            for i in range(0, max(1, len(w.words)), SLICE_WORDS):
                part = w.words[i : i + SLICE_WORDS]
                folded = [list(x) if len(x) <= FOLDED_BYTES else None for x in part]
                yield pa.record_batch([pa.array([folded], schema.field(0).type), pa.array([[x for x in part if len(x) > FOLDED_BYTES]], schema.field(1).type), pa.array([None], pa.int64()), pa.array([b"first" if i == 0 else b""], pa.binary())], schema=schema)
            raw, off = w.codes.astype("<i4").tobytes(), (w.offsets * 4).tolist()
            for i in range(0, b.num_rows, 500):
                rows = range(i, min(i + 500, b.num_rows))
                yield pa.record_batch([pa.nulls(len(rows), schema.field(0).type), pa.nulls(len(rows), schema.field(1).type), b.column("doc_id").slice(i, len(rows)), pa.array([raw[off[r] : off[r + 1]] for r in rows], pa.binary())], schema=schema)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, pieces = pair_ranks(ranks), {r: t for t, r in ranks.items()}
        first = [ranks.get(bytes([i]), NONE) for i in range(256)]
        texts: list[str] = []
        decoded: list[bytes] = []
        counts: list[int] = []
        for b in batches:
            ids, bytes_, long, docs_, codes = (b.column(c) for c in ("ids", "pieces", "long", "doc_id", "codes"))
            found = []
            for r in range(b.num_rows):
                if ids[r].is_valid:
                    if codes[r].as_py() == b"first":
                        texts, decoded, counts = [], [], []
                    rest = iter(long[r].as_py())
                    for i, p in zip(ids[r].as_py(), bytes_[r].as_py()):
                        if i is None:
                            i = heap_merge(next(rest), pairs, first)
                            p = b"".join(pieces[x] for x in i)
                        texts.append(" ".join(map(str, i)))
                        decoded.append(p)
                        counts.append(len(i))
                else:
                    found.append(digest(docs_[r].as_py(), np.frombuffer(codes[r].as_py(), "<i4").tolist(), texts, decoded, counts))
            yield _result(found)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sent = rows.mapInArrow(send, SENT)
    ids = F.transform("words", lambda w: F.when(w.isNotNull(), merge_column(w, ranks)))
    sent = sent.select(ids.alias("ids"), long_words, "doc_id", "codes")
    sent = sent.select("ids", F.transform("ids", lambda i: piece_column(i, ranks)).alias("pieces"), "long", "doc_id", "codes")
    return sent.mapInArrow(receive, RESULT)


def digest(doc_id: int | None, codes: list[int], texts: list[str], decoded: list[bytes], counts: list[int]) -> tuple:
    ids = " ".join([texts[c] for c in codes])
    raw = b"".join([decoded[c] for c in codes])
    return doc_id, sum([counts[c] for c in codes]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = list(zip(*rows)) or [()] * 4
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


class PairTable:
    """Ranks of token pairs in an open-addressing table, read for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pairs = pair_ranks(ranks)
        self.first = np.array([ranks.get(bytes([i]), NONE) for i in range(256)], np.int64)
        size = 1 << max(4, (8 * len(self.pairs)).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.keys = np.full(size + 64, -1, np.int64)
        self.values = np.full(size + 64, NONE, np.int64)
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        for key, at, rank in zip(keys.tolist(), self._at(keys).tolist(), self.pairs.values()):
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.values[at] = key, rank

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 32) | b
        at = self._at(keys)
        out = np.full(len(keys), NONE, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            todo, at = todo[on], at[on] + 1
        return out


def merge_words(words: list[bytes], table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts): the ranked merges folded over the byte arrays of all words together.

    A step finds every unfinished word's smallest pair rank, the first of
    equals, replaces that pair and looks up the two pairs beside it; words
    without a pair to merge leave.  Long words go through a heap of their own.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    counts = np.zeros(len(words), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []  # word of each token, token
    long = np.flatnonzero(sizes > FOLDED_BYTES)
    for i in long.tolist():
        ids = np.array(heap_merge(words[i], table.pairs, table.first.tolist()), np.int64)
        done.append((np.full(len(ids), i), ids))
    short = np.flatnonzero((sizes <= FOLDED_BYTES) & (sizes > 0))
    token = table.first[np.frombuffer(b"".join([words[i] for i in short.tolist()]), np.uint8)]
    word = np.repeat(short, sizes[short])

    def right(token: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), NONE, np.int64)
        ok = at + 1 < len(token)
        ok[ok] = word[at[ok] + 1] == word[at[ok]]
        out[ok] = table.ranks(token[at[ok]], token[at[ok] + 1])
        return out

    rank = right(token, word, np.arange(len(token)))
    while len(token):
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        least = np.minimum.reduceat(rank, start)
        size = np.diff(np.append(start, len(token)))
        over = least == NONE
        if over.any():
            leaves = np.repeat(over, size)
            done.append((word[leaves], token[leaves]))
            token, word, rank = token[~leaves], word[~leaves], rank[~leaves]
            size, least = size[~over], least[~over]
            if not len(token):
                break
        owner = np.repeat(np.arange(len(size)), size)
        best = np.flatnonzero(rank == least[owner])
        best = best[np.concatenate([[True], owner[best[1:]] != owner[best[:-1]]])]
        token[best] = least
        keep = np.ones(len(token), bool)
        keep[best + 1] = False
        at = best - np.arange(len(best))
        token, word, rank = token[keep], word[keep], rank[keep]
        rank[at] = right(token, word, at)
        left = at[at > 0] - 1
        left = left[word[left] == word[left + 1]]
        rank[left] = right(token, word, left)
    if not done:
        return np.zeros(0, np.int64), counts
    owner, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    order = np.argsort(owner, kind="stable")
    return ids[order], np.bincount(owner, minlength=len(words))


_tables: dict[int, PairTable] = {}


def pair_table(ranks: dict[bytes, int]) -> PairTable:
    """One table for each worker process and vocabulary."""
    key = hash(frozenset(ranks.items()))
    if key not in _tables:
        _tables[key] = PairTable(ranks)
    return _tables[key]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """As ``encode_folded``, with the merges of a block's distinct words folded over Arrow batches."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pair_table(ranks)
        pieces = pa.array([b""] * (max(ranks.values(), default=-1) + 1), pa.binary()).to_pylist()
        for t, r in ranks.items():
            pieces[r] = t
        names = np.array([str(i) for i in range(len(pieces))], object)
        for b in blocks(batches, "text", BLOCK):
            w = Words(b.column("text"), pattern)
            ids, counts = merge_words(w.words, table)
            off = np.concatenate([[0], np.cumsum(counts)]).tolist()
            shown, listed = names[ids].tolist(), ids.tolist()
            texts = [" ".join(shown[i:j]) for i, j in zip(off, off[1:])]
            decoded = [b"".join([pieces[x] for x in listed[i:j]]) for i, j in zip(off, off[1:])]
            total = np.concatenate([[0], np.cumsum(counts[w.codes])])[w.offsets]
            codes, at = w.codes.tolist(), w.offsets.tolist()
            found = []
            for doc, n, i, j in zip(b.column("doc_id").to_pylist(), np.diff(total).tolist(), at, at[1:]):
                own = codes[i:j]
                found.append((doc, n, hashlib.sha256(" ".join([texts[c] for c in own]).encode()).hexdigest(), hashlib.sha256(b"".join([decoded[c] for c in own])).hexdigest()))
            yield _result(found)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)
