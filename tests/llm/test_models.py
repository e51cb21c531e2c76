import random

import numpy as np
import pytest

from lexiloom.llm import cotraining, toxicity

random.seed(2)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 8))) for _ in range(500)]


@pytest.fixture(scope="module")
def data(spark):
    rows, labels = [], []
    for i in range(1500):
        words = [random.choice(WORDS) for _ in range(random.randint(5, 80))]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if toxic:
            words.insert(random.randrange(len(words)), random.choice(["Vilex", "grubnar", "sloztik"]))
        if bad:
            words = [w for w in words for _ in range(4)]
        rows.append((i, " ".join(words), "en", f"src{i % 3}", len(words)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, "vilex", "en", "s", 5), (3, rows[3][1], "en", "src0", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.repartition(4), spark.createDataFrame(labels + [(9000, None, None)], "doc_id long, quality int, toxic int")


def held_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 3 == 1


def test_toxicity_on_held_out_rows(data):
    docs, labels = data
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 9000]
    assert all(r.held_out == held_out(r.doc_id) for r in known)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    right = [r.predicted == (r.doc_id % 7 == 0) for r in known if r.held_out]
    assert np.mean(right) > 0.97


def test_toxicity_filter_keeps_columns(data):
    docs, labels = data
    out = toxicity.keep_clean(docs, toxicity.fit(docs, labels))
    assert out.columns == docs.columns and 0 < out.count() < docs.count()


def test_interactions_are_learned():
    rng = np.random.default_rng(0)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    flat, sizes = [], []
    for x, y in zip(a, b):
        own = [1] + [2] * int(x) + [3] * int(y)
        flat += own
        sizes.append(len(own))
    y = (a & b).astype(float)
    off = np.concatenate([[0], np.cumsum(sizes)])
    m = toxicity.train(np.array(flat, np.uint64), off, y)
    s = m.scores(np.array(flat, np.uint64), np.repeat(np.arange(4000), sizes), 4000)
    assert ((s > 0.5) == (y > 0.5)).mean() > 0.99


def test_models_without_labels(data):
    docs, labels = data
    rows = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert {r.predicted for r in rows} == {0}
    assert {r.score for r in cotraining.fit_and_score(docs, labels.limit(0)).collect()} == {1.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).collect() == []
    assert cotraining.fit_and_score(docs.limit(0), labels).collect() == []


def test_cotraining_on_held_out_rows(data):
    docs, labels = data
    rows = cotraining.fit_and_score(docs, labels).collect()
    assert len(rows) == docs.count()
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 9000 and held_out(r.doc_id)]
    assert np.mean([r.kept == (r.doc_id % 5 != 0) for r in known]) > 0.95
    assert cotraining.keep_good(docs, cotraining.fit(docs, labels)).columns == docs.columns


def test_views_teach_each_other():
    rng = np.random.default_rng(3)
    y = (rng.random(1200) < 0.6).astype(float)
    text = (y * 2 - 1)[:, None] * 1.5 + rng.normal(0, 1, (1200, 3))
    meta = (y * 2 - 1)[:, None] * 1.5 + rng.normal(0, 1, (1200, 3))
    x, m = text[80:600], meta[80:600]

    def surest(models, wanted):
        return [(view, float(label), x[rows], m[rows]) for view, label, rows, _ in cotraining.surest_rows(models, wanted, x, m)]

    model = cotraining.cotrain(text[:80], meta[:80], y[:80], surest)
    a, b, both = model.scores(text[600:], meta[600:])
    right = lambda s: ((s > 0.5) == (y[600:] > 0.5)).mean()
    assert right(both) > 0.95 and right(both) >= max(right(a), right(b)) - 0.02


def test_views_see_different_columns():
    import pyarrow as pa

    short, long = pa.array(["a bc. a bc."]), pa.array(["a bc. a bc. " * 50])
    x, y = cotraining.text_features(short)[0], cotraining.text_features(long)[0]
    assert np.abs(x - y)[cotraining.SHAPES :].max() < 1e-6  # not told how long a text is
    other = cotraining.text_features(pa.array(["b bc. b bc."]))[0]
    assert (other != x)[cotraining.SHAPES :].any()  # but which words it has
    codes = cotraining.meta_codes(pa.array(["s", None]), pa.array(["en", "en"]), pa.array([5, None]))
    assert codes[0, 0] != codes[1, 0] and codes[0, 1] == codes[1, 1] and codes[1, 2] == cotraining.META_BUCKETS + cotraining.STEPS - 1


def test_very_long_texts(spark):
    rows = [(i, ("vilex " if i % 2 else "mild ") * 300_000, "en", "s", 1_800_000) for i in range(4)] + [(10 + i, "few words " + ("vilex" if i % 2 else "mild"), "en", "s", 20) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 1 - r[0] % 2, r[0] % 2) for r in rows], "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r.predicted == r.doc_id % 2) == [r[0] for r in rows]
    assert cotraining.fit_and_score(docs, labels).count() == len(rows)
