"""Lexicon and graph queries over whole vocabularies, against brute force."""

from collections import Counter

import duckdb
import pytest

from lexiloom.plans import queries
from lexiloom.plans.queries import ORACLE_SQL, QUERIES

LANGS = {"en": 620, "de": 700, "fr": 550, "es": 40}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A few hundred words a language, most of them of one count and one beginning."""
    d = str(tmp_path_factory.mktemp("words"))
    rows = []
    for lang, n in LANGS.items():
        words = [f"{'long' if i % 3 else 'é'}{lang}{i:04d}" for i in range(n)] + [lang] * 9
        words += words[: n // 4] * 2 + words[:5]
        rows += [(len(rows) + i, "\n".join(" ".join(words[j : j + 7]) for j in range(i, len(words), 28)), lang) for i in range(0, 28, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.fixture(scope="module")
def ranks(spark, folder):
    """{lang: words in rank order}"""
    found: dict[str, Counter] = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        found.setdefault(r.lang, Counter()).update(r.text.split())
    return {lang: sorted(c, key=lambda w: (-c[w], w)) for lang, c in found.items()}


@pytest.fixture(scope="module")
def near(ranks):
    out: dict[str, set[str]] = {}
    for i in range(max(map(len, ranks.values()))):
        alike = [f"{lang}:{words[i]}" for lang, words in ranks.items() if i < len(words)]
        for w in alike:
            out.setdefault(w, set()).update(x for x in alike if x != w)
    return {w: x for w, x in out.items() if x}


def test_ranks_of_all_words(spark, folder, ranks):
    assert min(map(len, ranks.values())) < 100 and max(map(len, ranks.values())) > 500
    got = {(r.lang, r["rank"]): r.token for r in queries.ranked_words(spark, folder).collect()}
    assert got == {(lang, i): w for lang, words in ranks.items() for i, w in enumerate(words, 1)}


def test_word_graph(spark, folder, near):
    assert sum(map(len, near.values())) > 3000
    assert {(r.a, r.b) for r in QUERIES["word_graph_edges"](spark, folder).collect()} == {(a, b) for a, x in near.items() for b in x}
    want = {}
    reach = {}
    for s in near:
        seen, level = {s: 0}, [s]
        while level:
            level = [n for x in level for n in near[x] if n not in seen and not seen.update({n: seen[x] + 1})]
        reach[s] = min(seen)
        want |= {(s, t): k for t, k in seen.items() if 0 < k <= 3}
    assert {(r.src, r.dst): r.depth for r in QUERIES["khop_neighbors"](spark, folder).collect()} == want
    lines = {s: "\t".join([s, *(f"{t}__{k}" for k, t in sorted((k, t) for (a, t), k in want.items() if a == s))]) for s in near}
    assert {r.src: r.line for r in QUERIES["multi_lexicon_lines"](spark, folder).collect()} == lines
    assert {r.id: r.component for r in QUERIES["components"](spark, folder).collect()} == reach
    most = Counter(reach.values())
    assert [tuple(r) for r in QUERIES["component_max"](spark, folder).select("groups", "most").collect()] == [(len(most), max(most.values()))]


@pytest.mark.parametrize("name", "lexicon_cap lexicon_group multi_lexicon_parse lexicon_unknown_rate ras_bilingual ras_repeat ras_stats augment_union ras_multi".split())
def test_lexicons_of_all_words(spark, folder, name):
    sql = ORACLE_SQL[name]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got, want = QUERIES[name](spark, folder).toPandas(), c.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)
    rows = lambda f: sorted(map(repr, f[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_lexicon_reaches_rare_words(spark, folder, ranks):
    pairs = {(r.src_word, r.trg_lang, r.trg_word) for r in QUERIES["multi_lexicon_parse"](spark, folder).collect()}
    assert pairs == {(a, lang, b) for lang in ("de", "fr", "es") for a, b in zip(ranks["en"], ranks[lang])}
