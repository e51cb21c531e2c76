import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexiloom.llm import components, fm_index, near_duplicates, suffix_dedup

random.seed(4)
WORDS = ["".join(random.choice("abcdeéß") for _ in range(random.randint(1, 8))) for _ in range(400)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def fixture():
    shared, base = prose(60), prose(150).split()
    texts = [prose(random.randint(1, 120)) for _ in range(40)]
    texts += [prose(20) + " " + shared + "\n" + prose(15) for _ in range(12)]
    for k in range(30):
        w = list(base)
        for _ in range(k // 3):
            w[random.randrange(len(w))] = random.choice(WORDS)
        texts.append(" ".join(w))
    texts += ["", None, "   ", "one", "ONE", "one", "a a a a " * 200, "x" * 3000, texts[3], texts[3].upper()]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = fixture()
    rows = [(i, t, 1, "clash") for i, t in enumerate(texts)] + [(5, texts[5], 1, "clash"), (None, texts[6], 1, "clash"), (None, None, 1, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans int, row string").repartition(5)


def covered(sequences, width):
    windows = Counter(tuple(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        mask = [False] * len(s)
        for i in range(len(s) - width + 1):
            if windows[tuple(s[i : i + width])] > 1:
                mask[i : i + width] = [True] * width
        out.append(mask)
    return out


@pytest.mark.parametrize(("width", "gram", "crowd"), [(60, 8, 20_000), (200, 48, 20_000), (60, 8, 2)])
def test_suffix_dedup_equals_brute_force(docs, width, gram, crowd):
    source = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = Counter()
    for (doc, s), mask, more in zip(source, covered([s for _, s in source], width), covered([s for _, s in source], 40)):
        kept = bytes(b for b, m in zip(s, mask) if not m)
        want[doc, len(s), sum(mask), len(re.findall("1+", "".join("01"[m] for m in mask))), hashlib.sha256(kept).hexdigest(), sum(more)] += 1
    got = Counter(tuple(r) for r in suffix_dedup.report(docs, width, gram, crowd, 40, 8).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes").collect())
    assert got == want


def test_suffix_dedup_keeps_columns(docs):
    out = suffix_dedup.dedup(docs, 60, 8)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.spans for r in out.collect()} == {1} and {r.row for r in out.collect()} == {"clash"}


@pytest.mark.parametrize(("width", "gram", "crowd"), [(12, 4, 20_000), (35, 6, 20_000), (12, 4, 2)])
def test_fm_dedup_equals_brute_force(docs, width, gram, crowd):
    source = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()]
    want = Counter()
    for (doc, s), mask in zip(source, covered([s for _, s in source], width)):
        kept = " ".join(w for w, m in zip(s, mask) if not m)
        want[doc, len(s), sum(mask), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = Counter(tuple(r) for r in fm_index.report(docs, width, gram, crowd).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want


def test_dedup_of_nothing(docs):
    assert suffix_dedup.report(docs.limit(0)).collect() == []
    assert fm_index.report(docs.limit(0)).collect() == []
    assert near_duplicates.near_duplicates(docs.limit(0)).collect() == []


def test_deep_shallow_sort_and_prefixes():
    strings = ["".join(random.choice("ab") for _ in range(random.randint(0, 90))).encode() for _ in range(300)]
    strings += [b"abc" * 30, b"abc" * 30, b"abc" * 31, b""]
    order, common = suffix_dedup.deep_shallow_sort(strings, shallow=16)
    ranked = [strings[i] for i in order]
    assert ranked == sorted(strings) and sorted(order) == list(range(len(strings)))
    assert common[1:] == [suffix_dedup.common_prefix(a, b) for a, b in zip(ranked, ranked[1:])]


def test_large_groups_place_by_place():
    contents = [b"L%03d" % i + b"k" * 8 + b"R" * 12 for i in range(40)]
    left, right = np.full(40, 4), np.zeros(40, int)
    spans = suffix_dedup.resolve(contents, np.zeros(40, int), np.arange(40), left, right, 20, 8)
    assert spans == [[(-1, 20)]] * 40  # four blocks share the digit before the anchor


def test_fm_index_counts():
    values = np.array([1, 2, 3, 1, 2, 3, 0, 2, 3, 4, 0])
    fm = fm_index.FMIndex(values, 3)
    windows = np.array([0, 1, 3, 7])
    assert fm.repeated(values, windows, 3).tolist() == [True, False, True, False]
    assert fm.repeated(values, np.array([1, 4, 7]), 2).tolist() == [True, True, True]
    assert fm.repeated(values, np.array([0, 2, 1, 9]), np.array([3, 3, 2, 1])).tolist() == [True, False, True, False]


@pytest.mark.parametrize("module", [suffix_dedup, fm_index])
def test_the_method_decides_equal_blocks(module):
    """Two contents under one block hash are covered only if they are equal."""
    item = 1 if module is suffix_dedup else 8
    own = random.Random(1)
    text = bytes(own.randrange(256) for _ in range(30 * item))
    for other, spans in ((text, [(-5, 25)]), (bytes(30 * item), [])):
        got = module.resolve([text, other], np.array([7, 7]), np.array([9, 9]), np.array([5, 5]), np.array([0, 0]), 25, 4)
        assert got[0] == ([(-5, 25)] if spans else [])


def test_nothing_is_removed_without_the_resolver(docs):
    from lexiloom.llm import passages

    for kind in ("byte", "word"):
        _, spans = passages.covered(docs, kind, 12, 4, lambda contents, *_: [[] for _ in contents])
        assert spans.count() == 0


def links(texts, width, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return sets, [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


@pytest.mark.parametrize(("width", "cell_rows"), [(2, 8192), (5, 8192), (2, 3)])
def test_near_duplicates_equal_brute_force(docs, width, cell_rows):
    rows = docs.where("doc_id is not null").collect()
    sets, found = links([r.text for r in rows], width, 80)
    ids = [r.doc_id for r in rows]
    low = dict(zip(ids, ids))
    while True:
        before = dict(low)
        for i, j in found:
            a, b = ids[i], ids[j]
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    want = Counter((d, len(s), low[d], low[d] == d) for d, s in zip(ids, sets))
    got = near_duplicates.near_duplicates(docs, width, 0.8, cell_rows).collect()
    assert Counter(tuple(r) for r in got if r.doc_id is not None) == want
    assert sum(r.doc_id is None and r.kept for r in got) == 2


def test_one_of_each_keeps_first_and_columns(docs):
    out = near_duplicates.one_of_each(docs, 2, 0.8)
    assert out.columns == docs.columns
    kept = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    want = sorted({r.doc_id for r in near_duplicates.near_duplicates(docs, 2, 0.8).collect() if r.kept and r.doc_id is not None})
    assert kept == want
    assert sum(r.doc_id is None for r in out.collect()) == 2


def test_one_of_each_leaves_own_columns_alone(spark):
    base = prose(40)
    rows = [(1, base, 77, "a", None, 5), (2, base, 88, "b", None, 6), (3, prose(40), 99, "c", None, 7), (3, prose(40), 99, "d", None, 8), (3, base, 11, "e", None, 9), (None, base, 12, "f", None, 1), (4, None, 13, "g", None, 2), (4, "", 13, "h", None, 3), (5, base, 1, "i", None, 4), (6, prose(30), 1, "j", None, 4), (6, rows_six := prose(30), 1, "k", None, 4), (6, rows_six, 1, "k", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _id long, _key string, row string, c0 long")
    out = near_duplicates.one_of_each(docs, 2, 0.8)
    assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted((r.doc_id or 0, r._key, r._id, r.c0) for r in out.collect()) == sorted((r[0] or 0, r[3], r[2], r[5]) for r in rows[:1] + rows[2:4] + rows[5:8] + rows[9:11])


def test_doc_id_with_two_texts(spark):
    """Each text of a doc_id has its own set and links."""
    a, b = prose(40), prose(40)
    rows = [(1, a), (7, a), (7, b), (9, b + " x"), (9, prose(40))]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 0.8).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (7, 1, False), (7, 7, True), (9, 7, False), (9, 9, True)]


def test_oversize_nodes_go_down():
    rng = np.random.default_rng(1)
    n = 3000
    sketch = rng.integers(0, 1 << 63, (n, 4), np.uint64)
    sketch[100:140] = sketch[0]
    look = near_duplicates.Look(sketch, np.full(n, 100), 0.8)
    found, down = near_duplicates.first_alike(np.zeros(n, np.int64), look, True)
    assert (found[100:140] >= 0).all() and found[0] >= 0 and down[200:].all()


def test_large_nodes_are_cut_into_pieces():
    key = np.repeat([3, 5, 9], [4, 7, 2])
    piece, split = near_duplicates.pieces_of(key, 4, None)
    assert piece.tolist() == [1] * 4 + [2] * 4 + [3] * 3 + [4] * 2 and split.tolist() == [False] * 4 + [True] * 7 + [False] * 2
    assert near_duplicates.pieces_of(key, 4, 3)[1][:4].all() and len(near_duplicates.pieces_of(key[:0], 4, 3)[0]) == 0


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_components(spark, local):
    edges = [(1, 2), (2, 3), (10, 11), (11, 9), (20, 21), (3, 30), (30, 29), (7, 7)]
    rows = components.components(spark.createDataFrame(edges, "a long, b long"), local).collect()
    got = {r.id: r.component for r in rows}
    want = {1: 1, 2: 1, 3: 1, 30: 1, 29: 1, 10: 9, 11: 9, 9: 9, 20: 20, 21: 20}
    assert got == want
