"""Packing tokenised documents into fixed windows by minimum bin slack.

Each task tokenises its documents and packs them itself, so nothing is
shuffled.  A document's full windows are sequences of their own.  What remains
of each document (under one window) is packed in groups of at most
``GROUP_DOCUMENTS``: the longest remainder opens a window, and a subset-sum
dynamic programme over the multiset of remaining lengths, held as the bits of
one integer, picks the lengths that fill the window closest to its capacity;
walking the programme back gives how many of each length are taken.  If no
choice fills the window, the shortest remainder that is left is cut to fill it
and its rest returns to the multiset.  A group's last tokens, too few for a
window, are cut into sequences whose lengths are powers of two.

Null and empty texts hold the end id alone.  Rows with equal or null ``doc_id``
stay separate documents.  An empty table gives no pieces.  Sequence ids are
unique but not consecutive: task number times 2^32 plus a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.textblocks import BLOCK_BYTES, blocks
from lexiloom.llm.vocabulary import encoder, unload
from lexiloom.sources.corpus import ship

GROUP_DOCUMENTS = 8192
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of lengths, out of ``counts``, with the largest sum that is at most ``capacity``.

    Bit s of ``reach[i]`` tells whether the first i lengths can sum to s.
    """
    full = (1 << (capacity + 1)) - 1
    sizes = sorted((s for s in counts if 0 < s <= capacity), reverse=True)
    reach = [1]
    for size in sizes:
        bits, left, step = reach[-1], min(counts[size], capacity // size), 1
        while left > 0:
            take = min(step, left)
            bits |= (bits << (take * size)) & full
            left -= take
            step *= 2
        reach.append(bits)
        if bits >> capacity & 1:
            break
    target = reach[-1].bit_length() - 1
    taken: dict[int, int] = {}
    for i in range(len(reach) - 1, 0, -1):
        size, n = sizes[i - 1], 0
        while not reach[i - 1] >> (target - n * size) & 1:
            n += 1
        if n:
            taken[size] = n
            target -= n * size
    return taken


def pack_group(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start in the item, length); each token lies in one."""
    by_length: dict[int, list[tuple[int, int]]] = {}
    for item, n in enumerate(lengths):
        if n:
            by_length.setdefault(n, []).append((item, 0))
    counts = {n: len(v) for n, v in by_length.items()}

    def pop(n: int) -> tuple[int, int]:
        counts[n] -= 1
        if not counts[n]:
            del counts[n]
        return by_length[n].pop()

    def push(n: int, item: int, start: int) -> None:
        by_length.setdefault(n, []).append((item, start))
        counts[n] = counts.get(n, 0) + 1

    out: list[list[tuple[int, int, int]]] = []
    total = sum(lengths)
    while total >= window:
        seed = max(counts)
        sequence = [(*pop(seed), seed)]
        room = window - seed
        if room:
            for n, k in fill(counts, room).items():
                sequence += [(*pop(n), n) for _ in range(k)]
                room -= n * k
        if room:  # every remainder is longer than the room
            n = min(counts)
            item, start = pop(n)
            sequence.append((item, start, room))
            push(n - room, item, start + room)
        out.append(sequence)
        total -= window
    rest = [(*pop(n), n) for n in sorted(counts, reverse=True) for _ in range(counts[n])]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        sequence = []
        while room:
            item, start, n = rest.pop()
            used = min(n, room)
            sequence.append((item, start, used))
            room -= used
            if used < n:
                rest.append((item, start + used, n - used))
        out.append(sequence)
    return out


def pack(docs: DataFrame, spec: str, window: int = 1024, end_id: int = 0, keeps_blanks: bool = True, keep_loaded: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit) and place in a sequence.

    ``spec`` is the text of a tokenizer file.  Other columns of ``docs`` are ignored.
    With ``keep_loaded`` a worker keeps the tokenizer for its next task; without,
    its memory is free for other stages.  Smaller blocks take less memory and more time.
    """
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec, keeps_blanks)
        next_sequence = TaskContext.get().partitionId() << 32
        group: list[tuple[int | None, int, int, bytes]] = []  # doc_id, document length, start of the remainder, its ids

        def flush() -> pa.RecordBatch:
            nonlocal next_sequence
            rows = []
            for sequence in pack_group([len(g[3]) // 4 for g in group], window):
                at = 0
                for item, start, n in sequence:
                    doc, size, base, ids = group[item]
                    rows.append((doc, base + start, n, size, next_sequence, at, ids[4 * start : 4 * (start + n)]))
                    at += n
                next_sequence += 1
            group.clear()
            return batch(rows)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(schema)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for b in blocks(batches, "text", block_bytes):
            ids, off = enc.encode(b.column("text"))
            docs_, rows = b.column("doc_id").to_pylist(), []
            for i, doc in enumerate(docs_):
                own = np.append(ids[off[i] : off[i + 1]], end_id).astype("<u4").tobytes()
                size = len(own) // 4
                whole = size // window * window
                for start in range(0, whole, window):
                    rows.append((doc, start, window, size, next_sequence, 0, own[4 * start : 4 * (start + window)]))
                    next_sequence += 1
                if whole < size:
                    group.append((doc, size, whole, own[4 * whole :]))
                    if len(group) == GROUP_DOCUMENTS:
                        yield flush()
            yield batch(rows)
        if group:
            yield flush()
        if not keep_loaded:
            del enc
            unload()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def piece_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
