import random

import numpy as np
import pytest

from lexiloom.llm import byte_bpe, inner_product, nearest, queries, vector_cells

rng = np.random.default_rng(9)


@pytest.fixture(scope="module")
def table(spark):
    centres = rng.normal(0, 1, (12, 24))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.4, 24)).tolist(), "x") for i in range(900)]
    rows += [(1000 + i, rows[50][1], "copy") for i in range(60)]
    rows += [(2000, None, "x"), (2050, [0.0] * 24, "x"), (2100, [float("nan")] + [1.0] * 23, "x"), (2150, [None] + [1.0] * 23, "x"), (2200, [float("inf")] + [1.0] * 23, "x"), (2201, [1.0] * 3, "x"), (None, [1.0] * 24, "x"), (2250, [], "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)


def valid(table, zero):
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 24]
    rows = [(i, np.array(v, float)) for i, v in rows if None not in v and np.isfinite(v).all()]
    rows = sorted([(i, v) for i, v in rows if zero or v.any()], key=lambda x: x[0])
    return np.array([i for i, _ in rows]), np.stack([v for _, v in rows])


def test_top_products_equal_brute_force(table, monkeypatch):
    monkeypatch.setattr(vector_cells, "SHARD_ROWS", 200)
    ids, v = valid(table, True)
    w = np.floor(256 * v).astype(np.int64)
    got = {}
    for r in inner_product.top_inner_products(table).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    for q in got:
        s = w @ w[ids.tolist().index(q)]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        assert [got[q][r] for r in range(1, 6)] == [(ids[k], s[k]) for k in order]


def test_nearest_recall_and_ties(table, monkeypatch):
    monkeypatch.setattr(vector_cells, "SHARD_ROWS", 75)
    ids, v = valid(table, False)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in nearest.nearest(table, candidates=48, share=0.0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    hits = []
    for q in got:
        s = v @ v[ids.tolist().index(q)]
        order = [k for k in np.lexsort((ids, -s.round(12))) if ids[k] != q][:5]
        hits += [ids[k] in {x for x, _ in got[q].values()} for k in order]
        assert [got[q][r][1] for r in range(1, 6)] == sorted((x[1] for x in got[q].values()), reverse=True)
    assert np.mean(hits) >= 0.9
    assert [got[50][r][0] for r in range(1, 6)] == [1000, 1001, 1002, 1003, 1004]


@pytest.mark.parametrize("n", [100, 3000, 20_000])
def test_pigeonhole_finds_every_code_in_the_radius(n):
    code = rng.integers(0, 1 << 63, n, np.uint64)
    near = code[7] ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64))
    code = np.concatenate([code, near])
    index = nearest.MultiIndex(code)
    assert sum(bits for _, bits, _, _ in index.tables) == 64
    distance = np.bitwise_count(code ^ code[7])
    for wanted in (1, 30, 90, n + 100):
        rows, seen = index.around(code[7], wanted)
        radius = distance[rows].max()
        assert set(np.flatnonzero(distance <= radius)) == set(rows) and len(rows) >= min(wanted, n + 40) and seen >= len(rows)


def test_recall_inside_the_index_on_a_driver_table(spark):
    """Every search ends at a radius: what it returns is what the probes retrieved, and not the whole table."""
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    v = np.array([r.embedding for r in rows], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in queries.op2_multi_index(spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in got:
        s = u @ u[ids.tolist().index(q)]
        hits += [ids[k] in got[q] for k in [k for k in np.argsort(-s, kind="stable") if ids[k] != q][:5]]
    assert len(got) == sum(ids % 50 == 0) and np.mean(hits) >= 0.9
    mean, matrix = nearest.learn_rotation(v)
    code = nearest.codes(v, mean, matrix)
    index = nearest.MultiIndex(code)
    reached = [index.around(code[i], nearest.CANDIDATES) for i in np.flatnonzero(ids % 50 == 0)]
    assert np.mean([len(r) < len(ids) for r, _ in reached]) > 0.9
    assert np.mean([seen for _, seen in reached]) < len(ids)


def test_repeated_ids(spark):
    rows = [(i, rng.normal(0, 1, 8).tolist()) for i in range(100)] + [(50, [1.0] * 8), (50, [1.0] * 8), (3, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for f in (nearest.nearest, inner_product.top_inner_products):
        got = f(table).collect()
        assert all(r.vec_id != r.query_id for r in got)
        assert max(r["rank"] for r in got) == 5 and 3 in {r.vec_id for r in got if r.query_id == 50}


def test_search_of_nothing(table):
    assert nearest.nearest(table.limit(0)).collect() == []
    assert inner_product.top_inner_products(table.limit(0)).collect() == []


TEXTS = ["", None, "ab  cd  \n\n x'S it's 'll", "日本語 test 123abc", "é́ñ ß", "!!!'re'll", "\t\t\x1c x", "a" * 700, " " * 99, "word " * 300, "<|endoftext|>"]


def test_byte_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(queries.tokenizer_path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(1)
    texts = TEXTS + ["".join(random.choice("abe '\n.1é") for _ in range(200)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x y", 1)], "doc_id long, text string, n_tokens int").repartition(3)
    import hashlib

    want = {}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    for f in (byte_bpe.encode, byte_bpe.encode_folded):
        got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in f(docs, ranks, public_tokenizers.PATTERN).collect()}
        assert got.pop(None)[0] == 2
        assert got == want
        assert f(docs.limit(0), ranks, public_tokenizers.PATTERN).collect() == []
