"""Removal of repeated word passages with a compressed FM-index per shard.

A word is a run of characters other than blanks; each word covered by a window
of ``width`` words whose sequence also starts anywhere else is removed.  The
corpus is dealt out by anchors (see ``passages``), so a window and all its
repetitions meet in one shard.  A shard's blocks are one sequence of word
numbers; its Burrows-Wheeler transform is kept as a wavelet matrix of
bit-packed levels with counted words, about log2(vocabulary) bits a word.  The
blocks are then streamed.  Backward search of a whole block that may have a copy
tells whether it has; for the others, backward search from each position gives
its matching statistics up to ``width``, and the intervals where they reach
``width`` with a second occurrence are reported.

Null texts and texts without words are returned with nothing removed.  Columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiloom.llm import passages
from lexiloom.llm.suffix_dedup import merged
from lexiloom.llm.textblocks import buffer_of, gather

WIDTH = 35
GRAM = 6


class Bits:
    """A bit vector with constant-time rank, for many positions at once."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    """Occurrences of a symbol before a position, a level for each bit of a symbol."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(bits - 1, -1, -1):
            bit = (values >> shift) & 1
            self.levels.append((shift, Bits(bit), int(len(values) - bit.sum())))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(before low, before high) for each symbol, less its first place; differences are what counts."""
        first = np.zeros(len(symbol), np.int64)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            moved = []
            for i in (first, low, high):
                r = bits.ones(i)
                moved.append(np.where(one, zeros + r, i - r))
            first, low, high = moved
        return low - first, high - first


def suffix_array(values: np.ndarray, depth: int) -> np.ndarray:
    """By prefix doubling, ordered by the first ``depth`` symbols at least; ``values`` are non-negative."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:] if step < n else second[: n - step]
        order = np.argsort(rank * (n + 1) + second + 1, kind="stable")
        a, b = rank[order], second[order]
        new = np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        step *= 2
        if rank[order[-1]] == n - 1 or step >= min(n, depth):
            return order


class FMIndex:
    """Backward search over a sequence of symbols 1.., with 0 as separator, for patterns of up to ``depth`` symbols."""

    def __init__(self, values: np.ndarray, depth: int):
        order = suffix_array(values, depth)
        self.symbols = int(values.max(initial=0)) + 1
        self.wavelet = WaveletMatrix(values[order - 1], max(1, int(self.symbols - 1).bit_length()))
        counts = np.bincount(values, minlength=self.symbols)
        self.smaller = np.cumsum(counts) - counts
        self.counts = counts

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that begin with ``symbol`` followed by those of [low, high)."""
        a, b = self.wavelet.ranks(symbol, low, high)
        return self.smaller[symbol] + a, self.smaller[symbol] + b

    def repeated(self, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """Which slices of ``values`` (symbols of the index) occur at least twice; searches end as soon as one occurrence is left."""
        lengths = np.broadcast_to(lengths, starts.shape)
        out = np.zeros(len(starts), bool)
        alive = np.arange(len(starts))
        s = values[starts + lengths - 1]
        low, high = self.smaller[s], self.smaller[s] + self.counts[s]
        matched = 1
        while len(alive):
            more = high - low > 1
            out[alive[more & (lengths[alive] == matched)]] = True
            more &= lengths[alive] > matched
            alive, low, high = alive[more], low[more], high[more]
            low, high = self.extend(values[starts[alive] + lengths[alive] - 1 - matched], low, high)
            matched += 1
        return out


def resolve(contents: list[bytes], anchor: np.ndarray, block: np.ndarray, left: np.ndarray, right: np.ndarray, width: int, gram: int) -> list[list[tuple[int, int]]]:
    """For each first copy of a block the ranges, relative to its anchor, of windows that another content holds too; none for second copies."""
    out: list[list[tuple[int, int]]] = [[] for _ in contents]
    if not contents:
        return out
    sizes = np.array([len(c) // 8 for c in contents], np.int64)
    words = np.frombuffer(b"".join(contents), np.uint64)
    number = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    first = np.cumsum(sizes + 1) - (sizes + 1)
    values = np.zeros(len(words) + len(sizes), np.int64)
    values[gather(np.arange(len(values)), first, sizes)] = number
    index = FMIndex(values, int(sizes.max()))
    head = passages.first_copies(anchor, block)
    copied = np.flatnonzero(head & ~np.append(head[1:], True))
    full = np.zeros(len(contents), bool)
    full[copied] = index.repeated(values, first[copied], sizes[copied])
    for i in np.flatnonzero(full).tolist():
        out[i] = [(-int(left[i]), int(right[i]) + width)]
    open_ = np.flatnonzero(head & ~full)
    windows = sizes[open_] - width + 1
    owner = np.repeat(open_, windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = index.repeated(values, first[owner] + at, width)
    owner, at = owner[hit], at[hit]
    if not len(owner):
        return out
    begins = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)]))
    ends = np.append(begins[1:], len(owner)) - 1
    for a, b in zip(begins, ends):
        i = owner[a]
        out[i].append((int(at[a] - left[i]), int(at[b] - left[i]) + width))
    return [merged(s) if len(s) > 1 else s for s in out]


def report(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, crowd: int = passages.CROWD) -> DataFrame:
    """doc_id, n_words, n_removed and the hash of the kept words, for every row."""
    rows, spans = passages.covered(docs, "word", width, gram, resolve, crowd)

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        bounds, off, mask = passages.removed(b.column("text"), b.column("spans"), "word")
        data, _ = buffer_of(b.column("text"))
        s, e = bounds[:, ~mask]
        gone = np.concatenate([[0], np.cumsum(mask)])
        # every kept word with the byte behind it, which becomes a space
        raw = np.append(data, 32).astype(np.uint8)
        flat = gather(raw, s, e - s + 1)
        size = np.concatenate([[0], np.cumsum(e - s + 1)])
        flat[size[1:] - 1] = 32
        text = flat.tobytes()
        at = size[off - gone[off]].tolist()
        hashes = [hashlib.sha256(text[i : max(i, j - 1)]).hexdigest() for i, j in zip(at, at[1:])]
        return pa.record_batch({"doc_id": b.column("doc_id"), "n_words": np.diff(off), "n_removed": np.diff(gone[off]), "kept_sha256": hashes})

    return passages.finish(rows, spans, make, "doc_id long, n_words long, n_removed long, kept_sha256 string")
