import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import keyed_store, packing, queries, vocabulary

TEXTS = ["", None, "  a  b\n\n c  d é 'S it's I'M <|endoftext|> 12345  x \x1c y\t\tz  ", "É É  é", "a" * 3000, " " * 50, "x \n", "\n", "don't 'stop' 12ab !!x", "same words here", "same words here", "word " * 5000]


def whole(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path(name))
    t.encode_special_tokens = True
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, "again", "x", "y"), (None, "no id", "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids_crc32 string, start string")


@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunked_ids_equal_whole_ids(name, blanks):
    e = vocabulary.ChunkEncoder(vocabulary.read_vocabulary(queries.tokenizer_path(name)), blanks)
    ids, off = e.encode(pa.array(TEXTS))
    assert [list(ids[a:b]) + [0] for a, b in zip(off, off[1:])] == whole(name, TEXTS, 0)


def test_fill_finds_the_best_sum():
    assert packing.fill({600: 1, 300: 2, 7: 3}, 900) == {600: 1, 300: 1}
    assert packing.fill({5: 3}, 14) == {5: 2}
    assert packing.fill({}, 3) == {}


def test_pack_covers_each_id_once(spark, docs):
    spec = vocabulary.read_vocabulary(queries.tokenizer_path("byte_bpe_50k.json"))
    rows = packing.pack(docs.repartition(3), spec, window=64).collect()
    want = whole("byte_bpe_50k.json", [r.text for r in docs.collect()], 0)
    got = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        got.setdefault(r.doc_id, []).append(r)
    for i in [0, 1, 2, 4, 11]:
        parts = sorted(got[i], key=lambda r: r.start)
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == want[i]
        assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert sum(r.length for r in rows) == sum(map(len, want))


def test_pack_of_nothing(spark, docs):
    spec = vocabulary.read_vocabulary(queries.tokenizer_path("byte_bpe_50k.json"))
    assert packing.pack(docs.limit(0), spec).collect() == []


def test_store_round_trip(spark, docs):
    spec = vocabulary.read_vocabulary(queries.tokenizer_path("word_bpe_49k.json"))
    manifest = keyed_store.write_store(docs, spec, end_id=2)
    rows = sorted(keyed_store.read_store(manifest).collect(), key=lambda r: r.start)
    source = sorted(docs.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or ""))
    want = whole("word_bpe_49k.json", [r.text for r in source], 2)
    assert [r.doc_id for r in rows] == [r.doc_id for r in source]
    assert [r.n_tokens for r in rows] == [len(w) for w in want]
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]
    assert [r.start for r in rows] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    found = keyed_store.lookup(manifest, [11, 10**12, None, 3])
    assert found[0].tolist() == want[-1] and found[1] is None and found[2].tolist() == want[0]
    repeats = [w for r, w in zip(source, want) if r.doc_id == 3]
    assert [keyed_store.lookup(manifest, [3], k)[0].tolist() for k in (0, 1)] == repeats and keyed_store.lookup(manifest, [3], 2) == [None]


def test_keyed_access_reads_few_bytes(spark, monkeypatch):
    """One key costs the same in a small and a large shard; many shards are told apart by their range."""
    spec = vocabulary.read_vocabulary(queries.tokenizer_path("word_bpe_49k.json"))
    docs = spark.range(20_000).selectExpr("id * 3 as doc_id", "concat('word ', id, ' again') as text")
    read = []
    for rows in (300, 20_000):
        manifest = keyed_store.write_store(docs.where(f"doc_id < {3 * rows}").coalesce(1), spec, end_id=2)
        paths = {r.path: r for r in manifest.collect()}
        for d in (3, 297, 300, 889):
            path = next(p for p, r in paths.items() if r.first_doc <= d <= r.last_doc)
            with keyed_store.KeyedFile(path) as f:
                got = f.get(d)
                assert (got is None) == (d % 3 != 0)
                read.append(f.bytes_read)
    assert max(read) < 1500
    monkeypatch.setattr(keyed_store, "SHARD_BYTES", 1 << 10)
    monkeypatch.setattr(keyed_store, "BLOCK", 1 << 12)
    manifest = keyed_store.write_store(docs.limit(3000), spec, end_id=2)
    assert manifest.count() > 8
    whole_ = keyed_store.read_store(manifest).where("doc_id = 4500").first()
    got = keyed_store.lookup(manifest, [4500])[0]
    assert len(got) == whole_.n_tokens and zlib.crc32(got.astype("<u4").tobytes()) == whole_.ids_crc32


def test_empty_store(spark, docs):
    spec = vocabulary.read_vocabulary(queries.tokenizer_path("word_bpe_49k.json"))
    assert keyed_store.read_store(keyed_store.write_store(docs.limit(0), spec, end_id=2)).collect() == []


def test_perfect_hash_is_minimal():
    h = keyed_store.mixed(np.arange(5000, dtype=np.uint64))
    p = keyed_store.PerfectHash.build(h)
    assert sorted(p(h)) == list(range(5000))
