"""Passages that start more than once: the distributed frame of both substring operators.

Elements are bytes or words; a window is ``width`` consecutive elements of one
document.  Every window picks one of its ``gram``-element pieces as its anchor:
the one with the smallest hash, the first of equals.  The choice looks at the
window alone, so equal windows have equal anchors at equal places, and all
windows of a corpus are dealt out to groups by their anchor without listing
them: consecutive windows with one anchor are a *block* (anchor position, first
and last window).

1. ``anchored`` lists the blocks of every document: one row for about every
   ``width - gram`` / 2 elements.
2. Blocks are counted by the hash of their content, with a partial aggregate;
   anchors with one block in all are done.
3. Of every other block two places are read again (one, if there is one), and
   all of an anchor's go to one shard, where a *resolver* (suffix sorting or an
   FM-index) tells from their content which windows are there twice.  The hash
   only deals out the work and says which further places hold what a read one
   holds; without the resolver nothing is removed.
   An anchor with more than ``CROWD`` different blocks isn't gathered in one
   task: the places read of its blocks are dealt out again, as texts of their
   own and by anchors that another hash picks.  After ``LEVELS`` such rounds,
   windows that still crowd are counted by two 64-bit hashes instead.
4. The covered parts go back to all occurrences, and each document removes them.

A document is known by a hash of its doc_id and text, so rows without a doc_id
or with a repeated one are documents of their own, and repeated rows are copies
of each other.  Two bitmaps of fixed size (8 MB) keep rows that surely have no
part in a join out of its shuffle; when full they only stop saving work.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.bitmaps import bitmap, maybe_in, only_maybe
from lexiloom.llm.rolling import Slices, mixed
from lexiloom.llm.scratch import materialize, release, scope, small_batches
from lexiloom.llm.textblocks import blocks, buffer_of, words

BLOCK = 1 << 20
SHARD_BLOCKS = 8192
#: Distinct blocks that one anchor's group may have in one task.
CROWD = 20_000
LEVELS = 3
#: (contents, anchors, blocks, left, right, width, gram) to the repeated ranges of each content, relative to its anchor; rows are sorted by anchor and block, of which there are two at most.
Resolver = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int], list[list[tuple[int, int]]]]


def elements(texts: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, document offsets): bytes, 64-bit hashes of words, or such hashes as they are ("hash")."""
    data, off = buffer_of(texts)
    if kind == "byte":
        return data, off
    if kind == "hash":
        return np.ascontiguousarray(data).view(np.uint64), off // 8
    s, e, first = words(data, off)
    return Slices(data).hash(s, e), first


def anchors(values: np.ndarray, off: np.ndarray, width: int, gram: int, level: int = 0) -> tuple[np.ndarray, ...]:
    """Blocks as (document, anchor position, first window, last window, anchor hash, block hash); positions in ``values``.

    Each ``level`` picks anchors by another hash.
    """
    n = len(values)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if n < width:
        return none
    hashes = Slices(values)
    at = np.arange(n - gram + 1)
    grams = hashes.hash(at, at + gram)
    if level:
        grams = mixed(grams ^ np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span, size = width - gram + 1, 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    picked = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: n - width + 1]
    inside = np.arange(n - width + 1) + width <= off[1:][doc]
    new = np.ones(len(picked), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & inside)
    # within one run all windows up to the document's last one are inside
    ends = np.append(np.flatnonzero(new)[1:], len(picked)) - 1
    last = np.minimum(ends[np.searchsorted(ends, first)], off[1:][doc[first]] - width)
    p = picked[first]
    block = mixed(hashes.hash(first, last + width) + (p - first).astype(np.uint64))
    return doc[first], p, first, last, grams[p], block


def with_row(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("row", F.xxhash64("doc_id", "text"))


def anchored(rows: DataFrame, kind: str, width: int, gram: int, level: int = 0) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            values, off = elements(b.column("text"), kind)
            doc, p, first, last, anchor, block = anchors(values, off, width, gram, level)
            base = off[doc]
            yield pa.record_batch({"row": b.column("row").take(pa.array(doc)), "p": (p - base).astype(np.int32), "first": (first - base).astype(np.int32), "last": (last - base).astype(np.int32), "anchor": anchor.view(np.int64), "block": block.view(np.int64)})

    return rows.select("row", "text").mapInArrow(run, "row long, p int, first int, last int, anchor long, block long")


def _sorted_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Tables of at least ``limit`` rows that never split an anchor."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= limit:
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("anchor").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield t.slice(0, cut)
            held, rows = t.slice(cut).to_batches(), t.num_rows - cut if cut else 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def first_copies(anchor: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The first of equal neighbours."""
    out = np.ones(len(block), bool)
    out[1:] = (block[1:] != block[:-1]) | (anchor[1:] != anchor[:-1])
    return out


def covered(docs: DataFrame, kind: str, width: int, gram: int, resolver: Resolver, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(documents with ``row``, table of row and spans): the element ranges to remove, for documents that have any."""
    small_batches(docs.sparkSession)
    rows = with_row(docs)
    return rows, repeated_spans(rows, kind, width, gram, resolver, crowd)


def repeated_spans(rows: DataFrame, kind: str, width: int, gram: int, resolver: Resolver, crowd: int = CROWD, level: int = 0) -> DataFrame:
    """(row, spans) of those of ``rows`` (row, text as string or binary) that have any; rows of equal ``row`` have equal texts.

    Of the tables written on the way only the result's stays.
    """
    spark, own = rows.sparkSession, f"repeated spans {uuid.uuid4().hex}"
    with scope(own):
        spans = _spans_of(rows, kind, width, gram, resolver, crowd, level)
    out = materialize(spans, "spans")
    release(spark, own)
    return out


def _spans_of(rows: DataFrame, kind: str, width: int, gram: int, resolver: Resolver, crowd: int, level: int) -> DataFrame:
    listed = f"places {uuid.uuid4().hex}"
    with scope(listed):
        places = materialize(anchored(rows, kind, width, gram, level), "places")
    # the first shuffle moves anchors alone; what follows sees the places of those that are there twice, and a few more
    twice = places.groupBy("anchor").agg(F.count("*").alias("total")).where("total > 1")
    places = materialize(only_maybe(places, "anchor", bitmap(twice.select(F.col("anchor").alias("key")))), "repeated-places")
    release(rows.sparkSession, listed)
    counted = places.groupBy("anchor", "block").agg(F.count("*").alias("n"))
    by_anchor = counted.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    repeated = materialize(counted.join(by_anchor, "anchor").select("anchor", "block", "n", "kinds"), "repeated")
    key = F.col("block").alias("key")
    item = 1 if kind == "byte" else 8

    def asked_texts(open_: DataFrame, both: bool) -> DataFrame:
        """(row, text, asked): the documents with the first (and if ``both`` the last) place of each block of ``open_``, and what is asked of them."""
        place = F.struct("row", "p", "first", "last")
        ends = only_maybe(places, "block", bitmap(open_.select(key))).groupBy("anchor", "block").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
        ends = ends.join(open_, ["anchor", "block"])
        # two places of one row and position are copies of a whole row
        wanted = ends.select("anchor", "block", "n", ((F.col("lo") == F.col("hi")) & (F.col("n") > 1)).alias("same"), F.explode(F.array_distinct(F.array("lo", "hi")) if both else F.array("lo")).alias("o"))
        wanted = materialize(wanted.select("anchor", "block", "n", "same", "o.*"), "wanted")
        requests = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "block", "n", "same", "p", "first", "last")).alias("asked"))
        return only_maybe(rows.select("row", "text"), "row", bitmap(requests.select(F.col("row").alias("key")))).join(requests, "row")

    def each_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, dict[str, pa.Array], np.ndarray, np.ndarray]]:
        """For blocks of documents: values, the places' columns, first and last window."""
        for b in blocks(batches, "text", BLOCK):
            values, off = elements(b.column("text"), kind)
            asked = b.column("asked")
            flat, owner = asked.flatten(), np.repeat(np.arange(b.num_rows), asked.value_lengths().to_numpy())
            f = {c: flat.field(c) for c in ("anchor", "block", "n", "same", "p", "first", "last")}
            yield values, f, off[owner] + f["first"].to_numpy(), off[owner] + f["last"].to_numpy()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: dict[int, int] = {}
        for values, f, first, last in each_asked(batches):
            keep = np.ones(len(first), bool)
            # a row that is repeated everywhere: two of its copies in each task will do
            for i in np.flatnonzero(f["same"].to_numpy(zero_copy_only=False)):
                block = f["block"][i].as_py()
                keep[i] = given.setdefault(block, 0) < 2
                given[block] += 1
            f = {c: x.filter(pa.array(keep)) for c, x in f.items()}
            first, last = first[keep], last[keep]
            raw = values.tobytes()
            content = [raw[i * item : j * item] for i, j in zip(first.tolist(), (last + width).tolist())]
            yield pa.record_batch({"anchor": f["anchor"], "block": f["block"], "left": pa.array(f["p"].to_numpy() - f["first"].to_numpy()), "right": pa.array(f["last"].to_numpy() - f["p"].to_numpy()), "content": pa.array(content, pa.binary())})

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, f, first, last in each_asked(batches):
            one = Slices(values)
            two = Slices(mixed(values.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
            count = last - first + 1
            at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            of = pa.array(np.repeat(np.arange(len(count)), count))
            place = np.repeat(f["p"].to_numpy() - f["first"].to_numpy() + first, count)
            yield pa.record_batch({"anchor": f["anchor"].take(of), "block": f["block"].take(of), "n": f["n"].take(of), "at": (at - place).astype(np.int32), "w1": one.hash(at, at + width).view(np.int64), "w2": two.hash(at, at + width).view(np.int64)})

    content = "anchor long, block long, left int, right int, content binary"
    contents = asked_texts(repeated.where(f"kinds <= {crowd}"), True).mapInArrow(read, content)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _sorted_groups(batches, SHARD_BLOCKS):
            anchor, block = t.column("anchor").to_numpy(), t.column("block").to_numpy()
            third = np.zeros(len(block), bool)
            third[2:] = (anchor[2:] == anchor[:-2]) & (block[2:] == block[:-2])
            if third.any():
                t = t.filter(pa.array(~third))
            columns = [t.column(c).to_numpy() for c in ("anchor", "block", "left", "right")]
            spans = resolver(t.column("content").to_pylist(), *columns, width, gram)
            head = first_copies(*columns[:2])
            has = [i for i in np.flatnonzero(head).tolist() if spans[i]]
            kept = t.select(["anchor", "block"]).take(pa.array(has, pa.int64()))
            yield pa.record_batch({"anchor": kept.column("anchor").combine_chunks(), "block": kept.column("block").combine_chunks(), "cover": pa.array([[{"f": a, "t": b} for a, b in spans[i]] for i in has], _COVER)})

    dealt = contents.repartition("anchor").sortWithinPartitions("anchor", "block")
    results = dealt.mapInArrow(resolve, "anchor long, block long, cover array<struct<f:int,t:int>>")
    crowded = repeated.where(f"kinds > {crowd}")
    if not crowded.isEmpty():
        if level < LEVELS:
            # the places read become texts of their own
            pieces = materialize(asked_texts(crowded, True).mapInArrow(read, content).select(F.xxhash64("anchor", "block", F.monotonically_increasing_id()).alias("piece"), "anchor", "block", "left", "content"), "pieces")
            found = repeated_spans(pieces.select(F.col("piece").alias("row"), F.col("content").alias("text")), "byte" if kind == "byte" else "hash", width, gram, resolver, crowd, level + 1)
            own = pieces.select(F.col("piece").alias("row"), "anchor", "block", "left").join(found, "row")
            covers = own.select("anchor", "block", F.transform("spans", lambda x: F.struct((x.f - F.col("left")).alias("f"), (x.t - F.col("left")).alias("t"))).alias("cover"))
            # both copies of a block say the same
            results = results.unionByName(covers.dropDuplicates(["anchor", "block"]))
        else:
            windows = materialize(asked_texts(crowded, False).mapInArrow(list_windows, "anchor long, block long, n long, at int, w1 long, w2 long").dropDuplicates(["anchor", "block", "at"]), "windows")
            same = ["anchor", "at", "w1", "w2"]
            twice = windows.groupBy(*same).agg(F.sum("n").alias("n")).where("n > 1").select(*same)
            hits = windows.join(twice, same, "left_semi").groupBy("anchor", "block").agg(F.array_sort(F.collect_list("at")).alias("at"))
            results = results.unionByName(hits.select("anchor", "block", F.transform("at", lambda x: F.struct(x.alias("f"), (x + width).alias("t"))).alias("cover")))
    results = materialize(results, "covers")
    found = only_maybe(places, "block", bitmap(results.select(key))).join(results, ["anchor", "block"])
    moved = F.transform("cover", lambda c: F.struct((F.col("p") + c.f).alias("f"), (F.col("p") + c.t).alias("t")))
    spans = found.select("row", moved.alias("spans"))
    return spans.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


_COVER = pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32())]))


def removed(texts: pa.Array, spans: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values or word bounds, document offsets, mask of elements to remove); spans may be null."""
    data, off = buffer_of(texts)
    s = e = None
    if kind == "word":
        s, e, off_ = words(data, off)
    else:
        off_ = off
    n = int(off_[-1])
    lengths = pc.fill_null(spans.value_lengths() if not pa.types.is_null(spans.type) else pa.array([None] * len(spans), pa.int32()), 0).to_numpy()
    owner = np.repeat(np.arange(len(spans)), lengths)
    flat = spans.flatten()
    edge = np.zeros(n + 1, np.int32)
    if len(owner):
        np.add.at(edge, off_[owner] + flat.field("f").to_numpy(), 1)
        np.add.at(edge, off_[owner] + flat.field("t").to_numpy(), -1)
    mask = np.cumsum(edge)[:-1] > 0
    return (data if kind == "byte" else np.stack([s, e])), off_, mask


def finish(rows: DataFrame, spans: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``make`` over every document with its columns of spans; documents that surely have none aren't shuffled."""
    bits = bitmap(spans.select(F.col("row").alias("key")))
    names = [c for c in spans.columns if c != "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            yield make(b)

    def run_plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            b = b.filter(pa.array(~maybe_in(bits, b.column("row").to_numpy())))
            for c in names:
                b = b.append_column(c, pa.nulls(b.num_rows, _COVER))
            yield make(b)

    with_spans = only_maybe(rows, "row", bits).join(spans, "row", "left").drop("row")
    return with_spans.mapInArrow(run, schema).unionByName(rows.mapInArrow(run_plain, schema))
