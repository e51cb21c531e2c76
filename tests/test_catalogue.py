"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pytest

from lexiloom.operators import vocabulary
from lexiloom.plans import queries
from lexiloom.plans.queries import ORACLE_SQL, QUERIES, counts

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, other, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = other.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(map(repr, f[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["bpe_learn", "bpe_vocab_encode", "bpe_vocabulary"])
def test_merges_of_queries_are_learned_without_the_words(spark, monkeypatch, name):
    """With a table over the bound the driver gets a bounded draw of words, and the result stays the same."""
    want = sorted(map(repr, QUERIES[name](spark, FOLDER).collect()))
    taken, bound = [], 10_000
    plain, learn = vocabulary.Merger.__init__, vocabulary.learn_merges
    monkeypatch.setattr(vocabulary.Merger, "__init__", lambda self, tokens, freqs: (taken.append(sum(map(len, tokens.to_pylist()))), plain(self, tokens, freqs))[1])
    monkeypatch.setattr(vocabulary, "learn_merges", lambda vocab, n: learn(vocab, n, most_chars=bound))
    assert sorted(map(repr, QUERIES[name](spark, FOLDER).collect())) == want
    assert max(taken) < bound < sum(len(r.token) for r in counts(spark, FOLDER).collect())


@pytest.mark.parametrize("name", ["bpe_vocab_encode", "bpe_vocabulary"])
def test_pieces_are_counted_over_words_that_are_counted_once(spark, monkeypatch, name):
    read, plain = [], queries.lines
    monkeypatch.setattr(queries, "lines", lambda *a: (read.append(a), plain(*a))[1])
    QUERIES[name](spark, FOLDER)
    assert len(read) == {"bpe_vocab_encode": 2, "bpe_vocabulary": 1}[name]  # for the words, and for their lines
