"""Removal of repeated byte passages by deep-shallow suffix sorting.

Each byte covered by a ``width``-byte string that also starts anywhere else, in
any document or the same one, is removed; strings are judged on the input.  The
corpus is dealt out by anchors (see ``passages``).  In each shard the suffixes
that begin at the anchors are sorted: a multikey quicksort orders them by their
first ``SHALLOW`` bytes, and each group that still agrees goes into a blind
trie, which compares every suffix in full only once, with one leaf.  The common
prefix lengths of neighbours tell how far two blocks agree to the right of the
anchor; comparing backwards from the anchor tells how far to the left.  That
decides all repetitions, those of whole equal blocks too.

Null and empty texts are returned with nothing removed.  Columns besides doc_id
and text are ignored by the report and kept by ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import passages
from lexiloom.llm.bitmaps import bitmap, only_maybe
from lexiloom.llm.rolling import mixed
from lexiloom.llm.scratch import materialize

WIDTH = 400
GRAM = 64
#: Width and anchor of the passages that ``report`` only counts.
PASSAGE = 200
PASSAGE_GRAM = 48
SHALLOW = 48
#: Groups of more blocks compare windows place by place instead of block by block.
PAIRWISE = 24


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    a, b = x[:n], y[:n]
    if a == b:
        return n
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return (8 * n - differ.bit_length()) >> 3


class BlindTrie:
    """Strings in order, inserted with one full comparison each.

    Inner nodes are [depth, {byte: child}]; the byte -1 stands for the end of a
    string.  Leaves are lists of equal strings' indices.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None

    @staticmethod
    def _at(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def insert(self, index: int) -> None:
        s = self.strings[index]
        if self.root is None:
            self.root = [None, [index]]
            return
        node = self.root
        while node[0] is not None:  # blindly: by the branching bytes alone
            children = node[1]
            node = children.get(self._at(s, node[0])) or next(iter(children.values()))
        leaf = self.strings[node[1][0]]
        depth = common_prefix(s, leaf)
        if depth == len(s) == len(leaf):
            node[1].append(index)
            return
        parent, node = None, self.root
        while node[0] is not None and node[0] < depth:
            parent, node = node, node[1][self._at(s, node[0])]
        if node[0] == depth:
            node[1][self._at(s, depth)] = [None, [index]]
            return
        other = node[1][0] if node[0] is None else self._leaf(node)
        split = [depth, {self._at(self.strings[other], depth): node, self._at(s, depth): [None, [index]]}]
        if parent is None:
            self.root = split
        else:
            parent[1][self._at(s, parent[0])] = split

    @staticmethod
    def _leaf(node: list) -> int:
        while node[0] is not None:
            node = next(iter(node[1].values()))
        return node[1][0]

    def ordered(self) -> list[tuple[int, int]]:
        """(index, common prefix with the one before; -1 for the first)."""
        out: list[tuple[int, int]] = []
        todo = [(self.root, -1)] if self.root else []
        while todo:
            node, before = todo.pop()
            if node[0] is None:
                for k, i in enumerate(node[1]):
                    out.append((i, len(self.strings[i]) if k else before))
            else:
                keys = sorted(node[1])
                for k in reversed(keys):
                    todo.append((node[1][k], before if k == keys[0] else node[0]))
        return out


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(order, common prefix of each with the one before it; 0 for the first)."""
    order: list[int] = []
    common: list[int] = []
    todo = [(list(range(len(strings))), 0, 0)] if strings else []
    while todo:
        group, depth, before = todo.pop()
        if len(group) == 1:
            order += group
            common.append(before)
        elif depth >= shallow:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i)
            for i, c in trie.ordered():
                order.append(i)
                common.append(before if c < 0 else c)
        else:
            pivot = strings[group[len(group) // 2]][depth : depth + 8]
            low, same, high = [], [], []
            for i in group:
                piece = strings[i][depth : depth + 8]
                (same if piece == pivot else low if piece < pivot else high).append(i)

            # the first of a later part shares with its neighbour what the two pieces share
            def meets(a: list[int], b: list[int]) -> int:
                x = max(strings[i][depth : depth + 8] for i in a)
                y = min(strings[i][depth : depth + 8] for i in b)
                return depth + common_prefix(x, y)

            if high:
                todo.append((high, depth, meets(same, high)))
            todo.append((same, depth + 8 if len(pivot) == 8 else shallow, meets(low, same) if low else before))
            if low:
                todo.append((low, depth, before))
    return order, common


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_windows(group: list[int], contents: list[bytes], left: np.ndarray, right: np.ndarray, width: int) -> dict[int, list[tuple[int, int]]]:
    """Window ranges that another block of the group holds too, place by place: exact whatever the group's size."""
    out: dict[int, list[tuple[int, int]]] = {i: [] for i in group}
    for o in range(-int(max(right[i] for i in group)), int(max(left[i] for i in group)) + 1):
        seen: dict[bytes, int] = {}
        for i in group:
            if -right[i] <= o <= left[i]:
                start = int(left[i]) - o
                window = contents[i][start : start + width]
                other = seen.setdefault(window, i)
                if other != i:
                    out[i].append((-o, -o + width))
                    if not out[other] or out[other][-1][0] != -o:
                        out[other].append((-o, -o + width))
    return out


def resolve(contents: list[bytes], anchor: np.ndarray, block: np.ndarray, left: np.ndarray, right: np.ndarray, width: int, gram: int) -> list[list[tuple[int, int]]]:
    """For each content the ranges, relative to its anchor, of windows that another content holds too.

    ``left`` and ``right`` are how far the first window starts before the anchor
    and the last one after it (a window holds its anchor, so right <= 0).
    ``block`` only says which comparisons come first: those with the likely copy.
    """
    suffixes = [c[l:] for c, l in zip(contents, left.tolist())]
    heads = [c[:l][::-1] for c, l in zip(contents, left.tolist())]
    out: list[list[tuple[int, int]]] = [[] for _ in contents]
    full = [False] * len(contents)
    names, least_left, most_right = block.tolist(), left.tolist(), right.tolist()
    order, common = deep_shallow_sort(suffixes)
    start = 0
    for stop in range(1, len(order) + 1):
        if stop < len(order) and common[stop] >= gram:
            continue
        run, start_, start = order[start:stop], start, stop
        if len(run) < 2:
            continue
        place: dict[int, int] = {}
        for y, j in enumerate(run):
            x = place.setdefault(names[j], y)
            if x < y:
                i = run[x]
                if min(common[start_ + x + 1 : start_ + y + 1]) >= max(len(suffixes[i]), len(suffixes[j])) and heads[i] == heads[j]:
                    full[i] = full[j] = True
                    out[i], out[j] = [(-least_left[i], most_right[i] + width)], [(-least_left[j], most_right[j] + width)]
        if all(full[i] for i in run):
            continue
        if len(run) > PAIRWISE:
            for i, spans in repeated_windows(run, contents, left, right, width).items():
                if not full[i]:
                    out[i] = merged(spans)
            continue
        for x in range(len(run)):
            agree = 1 << 30
            for y in range(x + 1, len(run)):
                agree = min(agree, common[start_ + y])
                i, j = run[x], run[y]
                if full[i] and full[j]:
                    continue
                back = common_prefix(heads[i], heads[j])
                if back + agree < width:
                    continue
                for k in (i, j):
                    if not full[k]:
                        most, least = min(back, least_left[k]), max(width - agree, -most_right[k])
                        if most >= least:
                            out[k].append((-most, -least + width))
    return [merged(s) if len(s) > 1 else s for s in out]


def _spans(docs: DataFrame, width: int, gram: int, crowd: int = passages.CROWD) -> tuple[DataFrame, DataFrame]:
    return passages.covered(docs, "byte", width, gram, resolve, crowd)


def _within(rows: DataFrame, spans: DataFrame, width: int, gram: int, crowd: int) -> DataFrame:
    """The spans of repeated strings of ``width`` bytes, looked for only where ``spans`` of shorter ones cover as many bytes on end.

    A string that starts anywhere else has no piece that doesn't, so nothing is
    missed, and both of its places are looked at.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in passages.blocks(batches, "text", passages.BLOCK):
            data, off, mask = passages.removed(b.column("text"), b.column("spans"), "byte")
            begins, ends = mask.copy(), mask.copy()
            inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(mask))]
            begins[1:] &= ~mask[:-1]
            ends[:-1] &= ~mask[1:]
            begins[inner], ends[inner - 1] = mask[inner], mask[inner - 1]
            first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            first, last = first[last - first >= width], last[last - first >= width]
            owner = np.searchsorted(off, first, side="right") - 1
            start = first - off[owner]
            row = b.column("row").to_numpy()[owner]
            piece = mixed(row.view(np.uint64) ^ mixed(start.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
            yield pa.record_batch({"piece": piece.view(np.int64), "row": row, "start": start.astype(np.int32), "text": pa.array([data[i:j].tobytes() for i, j in zip(first, last)], pa.binary())})

    bits = bitmap(spans.select(F.col("row").alias("key")))
    some = only_maybe(rows.select("row", "text"), "row", bits).join(spans, "row")
    pieces = materialize(some.mapInArrow(cut, "piece long, row long, start int, text binary"), "pieces")
    found = passages.repeated_spans(pieces.select(F.col("piece").alias("row"), "text"), "byte", width, gram, resolve, crowd)
    places = pieces.select("piece", F.col("row").alias("of"), "start").distinct()
    moved = F.transform("spans", lambda x: F.struct((F.col("start") + x.f).alias("f"), (F.col("start") + x.t).alias("t")))
    back = places.join(found.withColumnRenamed("row", "piece"), "piece").select(F.col("of").alias("row"), moved.alias("spans"))
    return back.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def report(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, crowd: int = passages.CROWD, passage: int = PASSAGE, passage_gram: int = PASSAGE_GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of what is left, for every row.

    ``n_passage_bytes`` counts the bytes that a string of only ``passage`` bytes
    covers which starts anywhere else; nothing is removed by it.  A passage of
    50 words is often shorter than ``width``.
    """
    if passage > width:
        raise ValueError("passage is at most width")
    rows, more = _spans(docs, passage, passage_gram, crowd)
    spans = more.withColumnRenamed("spans", "more").join(_within(rows, more, width, gram, crowd), "row", "left")

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        data, off, mask = passages.removed(b.column("text"), b.column("spans"), "byte")
        _, _, covered = passages.removed(b.column("text"), b.column("more"), "byte")
        edge = np.concatenate([[0], mask.view(np.int8)])
        begins = np.diff(edge) > 0
        begins[off[:-1][off[:-1] < len(mask)]] = mask[off[:-1][off[:-1] < len(mask)]]
        gone, starts, again = (np.concatenate([[0], np.cumsum(x)]) for x in (mask, begins, covered))
        kept, kept_off = data[~mask].tobytes(), off - gone[off]
        hashes = [hashlib.sha256(kept[i:j]).hexdigest() for i, j in zip(kept_off.tolist(), kept_off[1:].tolist())]
        return pa.record_batch({"doc_id": b.column("doc_id"), "n_bytes": np.diff(off), "n_removed": np.diff(gone[off]), "n_spans": np.diff(starts[off]), "kept_sha256": hashes, "n_passage_bytes": np.diff(again[off])})

    return passages.finish(rows, spans, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long")


def dedup(docs: DataFrame, width: int = PASSAGE, gram: int = PASSAGE_GRAM) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text`` (bytes that no longer form a character go too); all columns kept."""
    _, spans = _spans(docs, width, gram)
    names, schema = docs.columns, docs.schema
    where = names.index("text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    rows = docs.select(*columns, F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in passages.blocks(batches, f"c{where}", passages.BLOCK):
            old = b.column(where)
            data, off, mask = passages.removed(old, b.column("spans"), "byte")
            raw = data[~mask].tobytes()
            at = (off - np.concatenate([[0], np.cumsum(mask)])[off]).tolist()
            new = [raw[i:j].decode("utf-8", "ignore") for i, j in zip(at, at[1:])]
            new = pa.array(new, pa.string(), mask=old.is_null().to_numpy(zero_copy_only=False))
            yield pa.record_batch([new if i == where else b.column(i) for i in range(len(names))], names=names)

    bits = bitmap(spans.select(F.col("row").alias("key")))
    kept = [f"c{i}" for i in range(len(names))]
    cut = only_maybe(rows, "row", bits).join(spans, "row", "left").select(*kept, "spans").mapInArrow(run, schema)
    return only_maybe(rows, "row", bits, inside=False).select(*kept).toDF(*names).unionByName(cut)
