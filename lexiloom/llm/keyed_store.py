"""Token ids on disk: raw payloads in shards with a minimal perfect hash index.

A shard file holds, little-endian throughout::

    8 bytes   magic "LXKEYED1"
    8 x u64   documents, ids, bytes of an id (2 or 4), hash levels, words of the
              level bitmaps, first key's document count (always 0), 0, 0
    levels    for each level: bits u64, first 64-bit word u64
    bitmaps   u64 words of all levels, one after the other
    ranks     u64 for each word: set bits before it
    slots     for each hash value: first id u64, ids u32, fingerprint u32
    keys      i64 for each document in file order, its ordinal u32, null flag u32
    payload   the ids of all documents, in ascending doc_id order

The hash is built level by level: at each level the keys that are left are
thrown into twice as many bits, those alone in a bit keep it, the others go to
the next level.  A key's hash value is the number of set bits before its own,
so n keys take exactly the values 0 to n - 1.  The stored fingerprint rejects
keys that the shard does not hold.  A key is a doc_id with the ordinal of its
repetition (0 for the first row of a doc_id) and a flag for a null id.

The manifest has a row for each shard with its range of doc_ids, which leads
from a key to its shard.  ``lookup`` then reads the header, two words a level up
to the key's own (less than two levels on average), one slot and the ids, each
at its offset: a number of bytes that doesn't depend on the shard's size.

Shards are written to a temporary name and renamed, so a task that is run again
or twice leaves whole files only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.llm.scratch import materialize, new_path, task_count
from lexiloom.llm.textblocks import blocks
from lexiloom.llm.vocabulary import encoder
from lexiloom.sources.corpus import ship

MAGIC = b"LXKEYED1"
SHARD_BYTES = 64 << 20
BLOCK = 5 << 20
SLOT = np.dtype([("first", "<u8"), ("count", "<u4"), ("print", "<u4")])
KEY = np.dtype([("doc_id", "<i8"), ("ordinal", "<u4"), ("null", "<u4")])
MANIFEST = "task long, shard long, path string, documents long, ids long, first_doc long, last_doc long, nulls long"
HEAD_BYTES = 8 + 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def key_hash(keys: np.ndarray) -> np.ndarray:
    tail = keys["ordinal"].astype(np.uint64) * np.uint64(2) + keys["null"]
    return mixed(keys["doc_id"].astype(np.uint64) ^ mixed(tail))


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mixed(h ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit hashes."""

    def __init__(self, sizes: list[int], firsts: list[int], bitmap: np.ndarray, ranks: np.ndarray):
        self.sizes, self.firsts, self.bitmap, self.ranks = sizes, firsts, bitmap, ranks

    @classmethod
    def build(cls, hashes: np.ndarray) -> "PerfectHash":
        left, sizes, firsts, maps = hashes, [], [], []
        while len(left):
            bits = max(64, -(-2 * len(left) // 64) * 64)
            at = cls._place(left, len(sizes), bits)
            alone = np.bincount(at, minlength=bits)[at] == 1
            words = np.zeros(bits // 64, np.uint64)
            np.bitwise_or.at(words, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            firsts.append(sum(len(m) for m in maps))
            sizes.append(bits)
            maps.append(words)
            left = left[~alone]
        bitmap = np.concatenate(maps) if maps else np.zeros(0, np.uint64)
        counts = np.bitwise_count(bitmap).astype(np.uint64)
        return cls(sizes, firsts, bitmap, np.cumsum(counts) - counts)

    @staticmethod
    def _place(h: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mixed(h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(bits)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Hash values; -1 where no level has a bit set (surely no key)."""
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        for level, (bits, first) in enumerate(zip(self.sizes, self.firsts)):
            at = self._place(hashes[todo], level, bits)
            word = first + (at >> 6)
            bit = (at & 63).astype(np.uint64)
            hit = (self.bitmap[word] >> bit) & np.uint64(1) == 1
            below = self.bitmap[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = (self.ranks[word[hit]] + np.bitwise_count(below)).astype(np.int64)
            todo = todo[~hit]
        return out


def shard_bytes(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    h = key_hash(keys)
    index = PerfectHash.build(h)
    slots = np.zeros(len(keys), SLOT)
    at = index(h)
    slots["first"][at] = np.cumsum(counts) - counts
    slots["count"][at] = counts
    slots["print"][at] = fingerprint(h)
    head = np.array([len(keys), len(ids), width, len(index.sizes), len(index.bitmap), 0, 0, 0], "<u8")
    levels = np.array([*zip(index.sizes, index.firsts)], "<u8")
    parts = [MAGIC, head, levels, index.bitmap.astype("<u8"), index.ranks.astype("<u8"), slots, keys, ids.astype(f"<u{width}")]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class Shard:
    """A shard file opened for reading."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a keyed shard")
        n, total, width, levels, words = (int(x) for x in np.frombuffer(raw, "<u8", 8, 8)[:5])
        at = HEAD_BYTES

        def take(kind: str | np.dtype, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        table = take("<u8", 2 * levels).reshape(levels, 2)
        self.index = PerfectHash([int(x) for x in table[:, 0]], [int(x) for x in table[:, 1]], take("<u8", words), take("<u8", words))
        self.slots, self.keys, self.ids = take(SLOT, n), take(KEY, n), take(f"<u{width}", total)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id, number of ids) for each key; -1, 0 for keys that aren't here."""
        h = key_hash(keys)
        at = self.index(h)
        hit = at >= 0
        hit[hit] = self.slots["print"][at[hit]] == fingerprint(h[hit])
        first, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        first[hit] = self.slots["first"][at[hit]].astype(np.int64)
        count[hit] = self.slots["count"][at[hit]]
        return first, count


class KeyedFile:
    """A shard file asked for single keys: every read is at an offset, and ``bytes_read`` adds them up."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file, self.bytes_read = fs.open_input_file(path), 0
        head = self._read(0, HEAD_BYTES)
        if head[:8] != MAGIC:
            raise ValueError("not a keyed shard")
        n, _, self.width, levels, words = (int(x) for x in np.frombuffer(head, "<u8", 8, 8)[:5])
        self.levels = np.frombuffer(self._read(HEAD_BYTES, 16 * levels), "<u8").reshape(levels, 2).tolist()
        self.bitmap_at = HEAD_BYTES + 16 * levels
        self.ranks_at = self.bitmap_at + 8 * words
        self.slots_at = self.ranks_at + 8 * words
        self.ids_at = self.slots_at + (SLOT.itemsize + KEY.itemsize) * n

    def __enter__(self) -> "KeyedFile":
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def _read(self, at: int, count: int) -> bytes:
        self.file.seek(at)
        self.bytes_read += count
        return self.file.read(count)

    def get(self, doc_id: int | None, ordinal: int = 0) -> np.ndarray | None:
        """The ids of one document, or None."""
        h = key_hash(np.array([(doc_id or 0, ordinal, doc_id is None)], KEY))
        for level, (bits, first) in enumerate(self.levels):
            at = int(PerfectHash._place(h, level, bits)[0])
            word = first + (at >> 6)
            value = int.from_bytes(self._read(self.bitmap_at + 8 * word, 8), "little")
            if value >> (at & 63) & 1:
                before = int.from_bytes(self._read(self.ranks_at + 8 * word, 8), "little")
                place = before + (value & ((1 << (at & 63)) - 1)).bit_count()
                slot = np.frombuffer(self._read(self.slots_at + SLOT.itemsize * place, SLOT.itemsize), SLOT)[0]
                if slot["print"] != fingerprint(h)[0]:
                    return None
                raw = self._read(self.ids_at + self.width * int(slot["first"]), self.width * int(slot["count"]))
                return np.frombuffer(raw, f"<u{self.width}").astype(np.uint32)
        return None


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def read_shard(uri: str) -> Shard:
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        return Shard(f.read())


def write_store(docs: DataFrame, spec: str, end_id: int, keeps_blanks: bool = False, folder: str | None = None) -> DataFrame:
    """Encode every document and write the shards; returns the manifest, one row a shard in order.

    Null and empty texts hold ``end_id`` alone.  Rows are ordered by doc_id
    (nulls first), rows of one doc_id by text.  Columns besides doc_id and text
    are ignored; an empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_path(spark, "keyed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(spec, keeps_blanks), TaskContext.get()
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        shard, last, ordinal = 0, object(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard
            keys, ids, counts = (np.concatenate(x) for x in zip(*held))
            held.clear()
            name = f"shard-{task.partitionId():06d}-{shard:04d}.bin"
            temp = f"{base}/.{name}.{task.taskAttemptId()}"
            with fs.open_output_stream(temp) as f:
                f.write(shard_bytes(keys, ids, counts, width))
            fs.move(temp, f"{base}/{name}")
            shard += 1
            known = keys["doc_id"][keys["null"] == 0]
            row = [task.partitionId(), shard - 1, f"{folder}/{name}", len(keys), len(ids), int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None, len(keys) - len(known)]
            return pa.record_batch([pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in row], names=[c.split()[0] for c in MANIFEST.split(", ")])

        for b in blocks(batches, "text", BLOCK):
            ids, off = enc.encode(b.column("text"))
            n = b.num_rows
            doc_ids = b.column("doc_id").to_pylist()
            keys = np.zeros(n, KEY)
            for i, d in enumerate(doc_ids):
                ordinal = ordinal + 1 if d == last else 0
                last = d
                keys[i] = (d or 0, ordinal, d is None)
            out = np.insert(ids, off[1:], np.uint32(end_id))
            held.append((keys, out, np.diff(off) + 1))
            if sum(x[1].nbytes for x in held) * width // 4 >= SHARD_BYTES:
                yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange(task_count(rows), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(rows.mapInArrow(run, MANIFEST), "keyed-manifest")


def read_store(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, each found by its key in the files."""
    before = W.orderBy("task", "shard").rowsBetween(W.unboundedPreceding, -1)
    starts = manifest.select("path", "documents", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                s = read_shard(path)
                first, count = s.find(s.keys)
                raw = s.ids.astype("<u4")
                crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(first.tolist(), count.tolist())]
                yield pa.record_batch({"doc_id": pa.array(s.keys["doc_id"], pa.int64(), mask=s.keys["null"] == 1), "start": first + base, "n_tokens": count, "ids_crc32": pa.array(crc, pa.int64())})

    n = starts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return starts.repartition(int(n), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_ids: list[int | None], ordinal: int = 0) -> list[np.ndarray | None]:
    """Ids of single documents, read by key on the driver; None for keys that the store does not hold.

    Only the manifest's rows whose range holds an asked doc_id come to the
    driver: one for each, or a few if its repetitions fill several shards.
    """
    known = sorted({d for d in doc_ids if d is not None})
    inside = F.exists(F.array(*map(F.lit, known)), lambda d: d.between(F.col("first_doc"), F.col("last_doc"))) if known else F.lit(False)
    shards = manifest.where(inside | F.lit(None in doc_ids) & (F.col("nulls") > 0)).orderBy("task", "shard").collect()
    out: list[np.ndarray | None] = []
    for d in doc_ids:
        found = None
        for s in shards:
            if s.nulls > 0 if d is None else s.first_doc is not None and s.first_doc <= d <= s.last_doc:
                with KeyedFile(s.path) as f:
                    found = f.get(d, ordinal)
                if found is not None:
                    break
        out.append(found)
    return out
