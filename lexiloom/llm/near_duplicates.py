"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds the hashes of its word shingles.  Equal sets are one
class from the start, represented by one row, which a hash of its doc_id and
text names.  ``COORDINATES`` minwise hashes describe each class.  In each of ``TREES`` independent trees a
node picks one or two coordinates (1 / threshold on average), and every class in
the node goes on to the child of each picked coordinate and of its own minwise
token there, so that a pair as similar as the threshold meets in one child on
average.  After ``DEPTH`` levels the nodes are compared exhaustively on
256-bit sketches and set sizes; a node of more than ``NODE_ROWS`` classes first
compares the classes that resemble its first ones with all others and sends the
rest one level down, where nodes pick more coordinates, so that pairs which go down in
every tree aren't lost.  With 16 trees a pair just at a similarity of 0.8 is
missed with a probability of about one in a million if its coordinates are
independent and it meets at ``DEPTH``, and where it goes down in every tree with
1e-5 at depth 6, 3e-5 at 8 and 7e-5 at ``LAST_DEPTH``.

Two documents are linked by their full sets.  The join first confirms, in each
node, the pair of each class with its first look-alike; components of those
links need no more comparisons inside, so that a group of thousands of copies
costs a link for each copy and node, not one for each pair.  Then it compares
every remaining look-alike pair between different components, in the smallest
node that both are in and on sets of 32-bit hashes, and confirms those that pass.

Null texts and texts without words have an empty set, are linked with nothing
and stand for themselves.  Repeated rows are returned each; rows with a null
doc_id get a null component and are kept.  Rows that share a doc_id but not a
text are documents of their own, each with its own set and links.  Columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.components import components
from lexiloom.llm.bitmaps import bitmap, only_maybe
from lexiloom.llm.rolling import Slices, mixed
from lexiloom.llm.scratch import materialize, small_batches
from lexiloom.llm.textblocks import ascii_lower, blocks, buffer_of, gather, give_back, words

COORDINATES = 128
SKETCH_BITS = 256
SKETCH = ("s1", "s2", "s3", "s4")
TREES = 16
DEPTH = 4
LAST_DEPTH = 12
NODE_ROWS = 2048
FIRST_ROWS = 16
#: Rows of one node that are compared at once; larger nodes are compared in pieces first and in a grid of parts at last.
CELL_ROWS = 8192
BLOCK = 1 << 20
_GOLD = 0x9E3779B97F4A7C15
_random = np.random.Generator(np.random.PCG64(11))
_FACTORS = _random.integers(0, 1 << 31, SKETCH_BITS, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, SKETCH_BITS, np.uint32)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingle hashes of each text."""
    data, off = buffer_of(texts)
    data = ascii_lower(data)
    s, e, first = words(data, off)
    word = Slices(data).hash(s, e)
    count = np.diff(first)
    grams = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), grams)
    start = np.repeat(first[:-1] - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())
    h = Slices(word).hash(start, np.minimum(start + width, first[1:][doc]))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(count) + 1))


def minwise(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Minwise hashes of non-empty sets: (sets, SKETCH_BITS) of 32 bits."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(off) - 1, SKETCH_BITS), np.uint32)
    for c in range(SKETCH_BITS):
        v = x * _FACTORS[c]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v += _SHIFTS[c]
        v ^= v >> np.uint32(13)
        out[:, c] = np.minimum.reduceat(v, off[:-1]) if len(off) > 1 else 0
    return out


def sketches(signature: np.ndarray) -> np.ndarray:
    """One bit of each minwise hash: (rows, 4) of 64 bits."""
    bits = (signature * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(bits.astype(np.uint8), axis=1).view("<u8")


def children(node: np.ndarray, signature: np.ndarray, row: np.ndarray, often: float) -> tuple[np.ndarray, np.ndarray]:
    """(child nodes, rows): each node goes on by its first coordinate, and ``often`` (a share of the nodes) by a second one."""
    pick = mixed(node ^ np.uint64(0xD1B54A32D192ED03))
    first = (pick % np.uint64(COORDINATES)).astype(np.int64)
    second = (first + 1 + ((pick >> np.uint64(8)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    two = (pick >> np.uint64(32)).astype(np.float64) / 2**32 < often
    out = [mixed(node * np.uint64(_GOLD) + first.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D) + signature[row, first])]
    n2, s2, r2 = node[two], second[two], row[two]
    out.append(mixed(n2 * np.uint64(_GOLD) + s2.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D) + signature[r2, s2]))
    return np.concatenate(out), np.concatenate([row, r2])


def most_bits(threshold: float) -> int:
    """Sketch bits that a pair at ``threshold`` differs in at most, four standard deviations up."""
    p = (1 - threshold) / 2
    return int(SKETCH_BITS * p + 4 * (SKETCH_BITS * p * (1 - p)) ** 0.5) + 1


class Look:
    """What a node knows of its rows: sketches and set sizes."""

    def __init__(self, sketch: np.ndarray, size: np.ndarray, threshold: float):
        self.sketch, self.size, self.threshold, self.bits = sketch, size.astype(np.int64), threshold, most_bits(threshold)

    def alike(self, i: np.ndarray | slice, j: np.ndarray | slice) -> np.ndarray:
        """Whether rows may be as similar as the threshold; ``i`` and ``j`` broadcast against each other.

        Sets can't be if the smaller one is below that share of the larger.
        """
        x, y = self.size[i], self.size[j]
        percent = round(self.threshold * 100)
        return (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (self._distance(i, j) <= self.bits)

    def _distance(self, i: np.ndarray | slice, j: np.ndarray | slice) -> np.ndarray:
        a, b = self.sketch[i], self.sketch[j]
        out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
        for c in range(1, SKETCH_BITS // 64):
            out += np.bitwise_count(a[..., c] ^ b[..., c])
        return out


def first_alike(key: np.ndarray, look: Look, oversize: bool) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key: an earlier row of the node that looks alike (the row itself where only later ones do, -1 where none does), and whether the row must go a level down."""
    n = len(key)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(start, n))
    found, down = np.full(n, -1, np.int64), np.zeros(n, bool)
    owner = np.repeat(np.arange(len(start)), size)
    small = size[owner] <= 64
    for lag in range(min(63, int(size[size <= 64].max(initial=0)) - 1), 0, -1):
        i = np.flatnonzero(small[: n - lag] & (owner[: n - lag] == owner[lag:]))
        i = i[look.alike(i, i + lag)]
        found[i] = np.where(found[i] < 0, i, found[i])
        found[i + lag] = i  # lags go down, so the nearest earlier row stays
    for g in np.flatnonzero(size > 64):
        a, b = start[g], start[g] + size[g]
        own = np.arange(a, b)
        big = oversize and b - a > NODE_ROWS
        near = np.zeros(b - a, bool)
        if big:
            for f in range(FIRST_ROWS):
                near |= look.alike(own[f : f + 1], own)
            rows = np.flatnonzero(near)
            down[a:b] = ~near
        else:
            rows = np.arange(b - a)
        for k in range(0, len(rows), 256):
            part = rows[k : k + 256]
            alike = look.alike(own[part][:, None], own[None, :])
            alike[np.arange(len(part)), part] = False
            some = alike.any(1)
            other = alike.argmax(1)
            mine = found[a:b]
            mine[part[some]] = np.minimum(other[some], part[some]) + a
            if big:
                # look-alikes of a compared row take part even if they go down
                seen = np.flatnonzero(alike.any(0) & (mine < 0))
                mine[seen] = seen + a
    return found, down


def cross_pairs(key: np.ndarray, look: Look, part_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Look-alike pairs of rows in one node whose ``part_of`` differs, in bounded pieces; rows are sorted by key."""
    n = len(key)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(start, n))
    owner = np.repeat(np.arange(len(start)), size)
    small = size[owner] <= 64
    for lag in range(1, int(size[size <= 64].max(initial=0))):
        i = np.flatnonzero(small[: n - lag] & (owner[: n - lag] == owner[lag:]) & (part_of[: n - lag] != part_of[lag:]))
        yield i[k := look.alike(i, i + lag)], (i + lag)[k]
    for g in np.flatnonzero(size > 64):
        a, b = start[g], start[g] + size[g]
        for k in range(a, b, 256):
            top = min(k + 256, b)
            alike = look.alike(np.arange(k, top)[:, None], np.arange(k, b)[None, :]) & (part_of[k:top][:, None] != part_of[None, k:b])
            i, j = np.nonzero(alike)
            yield k + i[i < j], k + j[i < j]


def whole_nodes(batches: Iterator[pa.RecordBatch], limit: int = 1 << 18, whole: bool = True) -> Iterator[pa.Table]:
    """Tables of at least ``limit`` rows that split no node, or, unless ``whole``, only nodes of more than ``limit`` rows; input is sorted by key."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= limit:
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1])) or (0 if whole else len(key))
            if cut:
                yield t.slice(0, cut)
            t = t.slice(cut)
            held, rows = t.to_batches(), t.num_rows if cut else 0
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        held = []
        if t.num_rows:
            yield t
        del t
    give_back()


def _look(t: pa.Table, threshold: float) -> Look:
    return Look(np.stack([t.column(c).to_numpy().view(np.uint64) for c in SKETCH], 1), t.column("size").to_numpy(), threshold)


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """row (a hash of doc_id and text), doc_id, n_shingles, two hashes of the whole set (null if empty) and the minwise signature of every row."""
    schema = "row long, doc_id long, n_shingles long, h1 long, h2 long, signature binary, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            h, off = shingle_sets(b.column("text"), width)
            n = np.diff(off)
            some = n > 0
            inner = np.append(off[:-1][some], len(h))
            h1, h2, signature, sketch = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.full(len(n), None, object), np.full(len(n), None, object)
            if some.any():
                h1[some] = np.add.reduceat(mixed(h.copy()), inner[:-1]).view(np.int64)
                h2[some] = np.add.reduceat(mixed(h ^ np.uint64(_GOLD)), inner[:-1]).view(np.int64)
                low = minwise(h, inner)
                signature[some] = [row.tobytes() for row in low[:, :COORDINATES]]
                sketch[some] = [row.tobytes() for row in sketches(low)]
            yield pa.record_batch({"row": b.column("row"), "doc_id": b.column("doc_id"), "n_shingles": n, "h1": pa.array(h1, mask=~some), "h2": pa.array(h2, mask=~some), "signature": pa.array(signature, pa.binary()), "sketch": pa.array(sketch, pa.binary())})

    return with_row(docs).mapInArrow(run, schema)


def with_row(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): ``row`` is a hash of the other two."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def _expand(classes: DataFrame, often: float, levels: int) -> DataFrame:
    """Nodes of each class ``levels`` further down; rows with a node go on from it, the others start in every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                signature = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.int64).reshape(len(signature), -1)
                rep, size = b.column("rep").to_numpy(), b.column("size").to_numpy()
                if "key" in b.schema.names:
                    node, row = b.column("key").to_numpy().view(np.uint64), np.arange(len(rep))
                else:
                    node = mixed(np.arange(1, TREES + 1).astype(np.uint64) * np.uint64(_GOLD))
                    node, row = np.tile(node, len(rep)), np.repeat(np.arange(len(rep)), TREES)
                for _ in range(levels):
                    node, row = children(node, signature, row, often)
                yield pa.record_batch({"key": node.view(np.int64), "rep": rep[row], "size": size[row]} | {c: sketch[row, k] for k, c in enumerate(SKETCH)})

    return classes.mapInArrow(run, "key long, rep long, size int, s1 long, s2 long, s3 long, s4 long")


def _in_nodes(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "rep")


def pieces_of(key: np.ndarray, most: int, before: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's piece, whether its node is in pieces): nodes of more than ``most`` rows, and one that began ``before`` this table, are cut into pieces of ``most`` rows."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    split = size > most
    if len(start) and before is not None:
        split[0] |= key[0] == before
    owner = np.repeat(np.arange(len(start)), size)
    part = np.where(split[owner], (np.arange(len(key)) - start[owner]) // most, 0)
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])]) if len(key) else np.zeros(0, bool)
    return np.cumsum(new), split[owner]


def look_alikes(classes: DataFrame, threshold: float, piece_rows: int = CELL_ROWS) -> DataFrame:
    """Rows (key, rep, first, size and sketch): classes with a look-alike in their node, and an earlier one.

    A node of more than ``piece_rows`` rows is compared piece by piece, in
    bounded memory and linear time; all its rows go down a level too, and at
    ``LAST_DEPTH`` all stay, for the grid of the last comparison.
    """

    def compare(oversize: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = None
            for t in whole_nodes(batches, whole=False):
                key, rep = t.column("key").to_numpy(), t.column("rep").to_numpy()
                piece, split = pieces_of(key, piece_rows, before)
                before = int(key[-1])
                found, down = first_alike(piece, _look(t, threshold), oversize)
                if oversize:
                    down |= split
                else:
                    found = np.where(split & (found < 0), np.arange(len(key)), found)
                keep = (found >= 0) | down
                first = rep[np.maximum(found, 0)]
                yield pa.record_batch({"key": key[keep], "rep": rep[keep], "first": pa.array(first[keep], mask=found[keep] < 0), "down": down[keep]} | {c: t.column(c).to_numpy()[keep] for c in ("size", *SKETCH)})

        return run

    schema = "key long, rep long, first long, down boolean, size int, s1 long, s2 long, s3 long, s4 long"
    found = []
    often = 1 / threshold - 1
    rows = _expand(classes, often, DEPTH)
    for depth in range(DEPTH, LAST_DEPTH + 1):
        level = materialize(_in_nodes(rows).mapInArrow(compare(depth < LAST_DEPTH), schema), "nodes")
        found.append(level.where("first is not null").drop("down"))
        deeper = level.where("down").select("key", "rep")
        if deeper.isEmpty():
            break
        rows = _expand(deeper.join(classes, "rep").select("key", "rep", "size", "signature", "sketch"), min(1.0, 2 * often), 1)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(row, text) of the rows in ``ids``; others surely not in it skip the shuffle."""
    texts = with_row(docs).where("doc_id is not null").select("row", "text")
    return only_maybe(texts, "row", bitmap(ids.select(F.col("row").alias("key")))).join(ids, "row", "left_semi")


def short_sets(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(rep, short): the sorted shingle hashes of each row in ``ids``, cut to 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            h, off = shingle_sets(b.column("text"), width)
            h = (h >> np.uint64(32)).astype("<u4")
            yield pa.record_batch({"rep": b.column("row"), "short": pa.array([np.unique(h[i:j]).tobytes() for i, j in zip(off, off[1:])], pa.binary())})

    return _texts_of(ids, docs).mapInArrow(run, "rep long, short binary").dropDuplicates(["rep"])


class ShortSets:
    """The 32-bit sets of a table of rows, their hashes numbered from 0."""

    def __init__(self, sets: pa.ChunkedArray):
        data, off = buffer_of(sets)
        values = np.ascontiguousarray(data).view("<u4")
        order = np.argsort(values)
        ranks = np.zeros(len(values), np.int32)
        if len(values):
            ranks[1:] = np.cumsum(np.diff(values[order]) != 0)
        self.token = np.empty(len(values), np.int32)
        self.token[order] = ranks
        self.off = off // 4
        self.present = np.zeros(len(values) + 1, np.int32)

    def nearly_linked(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of rows may be linked; two shared or lost hashes are allowed for."""
        out = np.zeros(len(i), bool)
        if not len(i):
            return out
        size = np.diff(self.off)
        order = np.argsort(i, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(i[order]) != 0, [True]]))
        for a, b in zip(cut, cut[1:]):
            at = order[a:b]
            own, others = i[at[0]], j[at]
            mine = self.token[self.off[own] : self.off[own + 1]]
            self.present[mine] = 1
            ends = np.cumsum(size[others])
            hits = np.concatenate([[0], np.cumsum(self.present[gather(self.token, self.off[others], size[others])])])
            both = hits[ends] - hits[ends - size[others]] + 2
            self.present[mine] = 0
            out[at] = 100 * both >= percent * (size[own] + size[others] - both)
        return out


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as ``threshold`` (per cent of the union, in whole numbers)."""
    percent = round(threshold * 100)
    ids = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            h, off = shingle_sets(b.column("text"), width)
            yield pa.record_batch({"id": b.column("row"), "set": pa.array([h[i:j].tobytes() for i, j in zip(off, off[1:])], pa.binary())})

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch({"a": b.column("a"), "b": b.column("b")}).filter(pa.array(keep, pa.bool_()))

    sets = materialize(_texts_of(ids, docs).mapInArrow(to_sets, "id long, set binary").dropDuplicates(["id"]), "sets")
    rows = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    return rows.select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def links(classes: DataFrame, docs: DataFrame, width: int, threshold: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, component) of the classes that are linked to another one."""
    percent = round(threshold * 100)
    nodes = look_alikes(classes, threshold, cell_rows)
    ordered = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    tested = materialize(ordered(nodes.select(F.col("first").alias("a"), F.col("rep").alias("b"))), "tested")
    sure = materialize(confirmed(tested, docs, width, threshold), "links")
    label = components(sure)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_nodes(batches, 1 << 12):
            rep, key, node = t.column("rep").to_numpy(), t.column("key").to_numpy(), t.column("node").to_numpy()
            piece, low, high = (t.column(c).to_numpy() for c in ("piece", "low", "high"))
            paths, short = padded(t.column("paths").combine_chunks()), ShortSets(t.column("short"))
            for i, j in cross_pairs(key, _look(t, threshold), t.column("part").to_numpy()):
                for k in range(0, len(i), 2048):
                    x, y = i[k : k + 2048], j[k : k + 2048]
                    # in a cell of a grid only pairs between its two parts
                    here = (np.minimum(piece[x], piece[y]) == low[x]) & (np.maximum(piece[x], piece[y]) == high[x])
                    here[here] = lowest_common(paths[x[here]], paths[y[here]]) == node[x[here]]
                    here[here] = short.nearly_linked(x[here], y[here], percent)
                    yield pa.record_batch({"a": np.minimum(rep[x], rep[y])[here], "b": np.maximum(rep[x], rep[y])[here]})

    marked = nodes.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", "rep", "size", *SKETCH, F.coalesce("component", "rep").alias("part"))
    split = marked.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    # a pair is reported only in the smallest of the nodes in which both are
    several = materialize(marked.join(split, "key", "left_semi"), "several")
    paths = several.groupBy("rep").agg(F.array_sort(F.collect_set("key")).alias("paths"))
    short = short_sets(paths.select(F.col("rep").alias("row")), docs, width)
    # a node of many rows becomes a grid: each row goes to the cells of its part with every part
    sizes = several.groupBy("key").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("pieces"))
    cells = several.join(sizes, "key").withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cells = cells.withColumn("low", F.least("piece", "other")).withColumn("high", F.greatest("piece", "other"))
    cells = cells.withColumnRenamed("key", "node").withColumn("key", F.when(F.col("pieces") == 1, F.col("node")).otherwise(F.xxhash64("node", "low", "high"))).drop("pieces", "other")
    dealt = cells.join(paths.join(short, "rep"), "rep").repartition("key").sortWithinPartitions("key", "rep")
    more = materialize(dealt.mapInArrow(rest, "a long, b long").join(tested, ["a", "b"], "left_anti"), "more")
    if more.isEmpty():
        return label
    part = lambda c: label.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part"))
    found = confirmed(more, docs, width, threshold).join(part("a"), "a", "left").join(part("b"), "b", "left")
    joined = components(found.select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b")))
    # components of components; a class outside the first links stands for itself
    upper = joined.select(F.col("id").alias("component"), F.col("component").alias("top"))
    lower = label.join(upper, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return lower.unionByName(joined.join(label.select("id"), "id", "left_anti"))


def padded(lists: pa.ListArray) -> np.ndarray:
    """Rows of equal length from lists of distinct numbers; the first number is repeated."""
    sizes = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy()
    first = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.max(initial=1)))[None, :]
    return flat[first[:, None] + np.where(at < sizes[:, None], at, 0)]


def lowest_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest number that is in both rows, for each pair of rows."""
    out = np.full(len(x), np.iinfo(np.int64).max)
    for c in range(x.shape[1]):
        hit = (y == x[:, c : c + 1]).any(1)
        np.minimum(out, np.where(hit, x[:, c], out), out=out)
    return out


def _decided(docs: DataFrame, width: int, threshold: float, cell_rows: int) -> DataFrame:
    """row, doc_id, n_shingles, component_id and part (the same for linked rows) for every row of ``docs``."""
    small_batches(docs.sparkSession)
    sets = materialize(set_table(docs, width), "signatures")
    some = sets.where("h1 is not null and doc_id is not null")
    first = some.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row")).alias("f"), F.first("n_shingles").cast("int").alias("size"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    classes = materialize(first.select("h1", "h2", F.col("f.row").alias("rep"), F.col("f.doc_id").alias("low"), "size", "signature", "sketch"), "classes")
    label = links(classes.select("rep", "size", "signature", "sketch"), docs, width, threshold, cell_rows)
    linked = materialize(classes.select("rep", "low").join(label.select(F.col("id").alias("rep"), F.col("component").alias("part")), "rep"), "linked")
    lowest = linked.groupBy("part").agg(F.min("low").alias("component"))
    named = classes.select("h1", "h2", "rep", "low").join(linked.select("rep", "part").join(lowest, "part"), "rep", "left")
    named = named.select("h1", "h2", F.coalesce("component", "low").alias("component"), F.coalesce("part", "rep").alias("part"))
    out = sets.select("row", "doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    return out.select("row", "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.coalesce("part", "row").alias("part"))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    out = _decided(docs, width, threshold, cell_rows).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of each group of documents that resemble each other, that of the smallest doc_id; all columns kept.

    Rows that repeat a doc_id and its text stay once, and so do linked rows of
    one doc_id; its rows that are linked with nothing stay.  Rows without a
    doc_id stay.
    """
    known = materialize(_decided(docs, width, threshold, CELL_ROWS).where("doc_id is not null").select("row", "part", (F.col("doc_id") == F.col("component_id")).alias("lowest")), "known")
    lowest = known.where("lowest").select("row", "part")
    twice = lowest.groupBy("part").agg(F.min("row").alias("one"), F.max("row").alias("last")).where("one <> last")
    gone = known.where("not lowest").select("row").unionByName(lowest.join(twice, "part").where("row <> one").select("row")).distinct()
    gone = materialize(gone, "gone")
    again = materialize(lowest.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"), "again")
    names = docs.columns
    row = F.when(F.col("doc_id").cast("long").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), row.alias("row"))
    free = named.where("row is null")
    named = named.where("row is not null")
    bits = bitmap(gone.select(F.col("row").alias("key")))
    left = only_maybe(named, "row", bits, inside=False).unionByName(only_maybe(named, "row", bits).join(gone, "row", "left_anti").select(named.columns))
    if not again.isEmpty():
        left = left.join(again, "row", "left_anti").unionByName(left.join(again, "row", "left_semi").dropDuplicates(["row"]))
    return left.select(free.columns).unionByName(free).drop("row").toDF(*names)
