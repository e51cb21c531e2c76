import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import corpora, evaluation, lexicon, sampling, vocabulary
from lexiloom.sources import corpus
from lexiloom.streaming import monitor


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(100)], "id long, g string")


def test_sample_sizes_are_exact(rows):
    assert sampling.down_sample(rows, F.col("id"), 0.25).count() == 25
    assert sampling.up_sample(rows, F.col("id"), 2.37).count() == 237
    assert sampling.up_sample(rows, F.col("id"), 0.5).count() == 50
    got = Counter(r.g for r in sampling.balance(rows, F.col("id"), "g").collect())
    assert got == {"a": 66, "b": 66}
    assert sampling.head_fraction(rows, "id", 10).count() == 10


def test_shuffle_is_a_permutation_whatever_the_partitions(rows):
    a = {r.id: r.place for r in sampling.shuffled(rows.repartition(1), F.col("id")).collect()}
    b = {r.id: r.place for r in sampling.shuffled(rows.repartition(16), F.col("id")).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 101)) and [a[i] for i in range(100)] != list(range(1, 101))


def test_lexicons(spark):
    text = spark.createDataFrame([(i, f"w{i} x{i}") for i in range(1, 9)] + [(9, "broken")], "rank int, value string")
    assert corpus.lexicon(text, 4).count() == 5
    e = corpus.edge_list(spark.createDataFrame([("a b",), ("c\td",), ("e",)], "value string"), "value")
    assert sorted(tuple(r) for r in e.collect()) == [("a", "b"), ("c", "d")]
    m = corpus.multi_lexicon(spark.createDataFrame([("EN__dog\tDE__hund__1\tFR__chien__2",), ("DE__x\tEN__y__1",)], "value string"), "value", ["en"])
    assert sorted(tuple(r) for r in m.collect()) == [("en", "dog", "de", "hund", 1), ("en", "dog", "fr", "chien", 2)]
    codes = corpus.merges(spark.createDataFrame([(0, "#version: 0.2"), (1, "a b"), (2, "c d"), (3, "a b")], "rank int, value string"))
    assert sorted((r.rank, r.left) for r in codes.collect()) == [(1, "a"), (2, "c")]
    v = corpus.vocabulary(spark.createDataFrame([("a 5",), ("b 1",), ("c x",)], "value string"), "value", threshold=2)
    assert [tuple(r) for r in v.collect()] == [("a", 5)]


def test_pair_directory():
    assert corpus.pair_directory("en", "de", {"de_en"}) == "de_en"
    with pytest.raises(FileNotFoundError):
        corpus.pair_directory("en", "fr", {"de_en"})


def test_graph_equals_search(spark):
    random.seed(5)
    edges = [(f"w{random.randrange(40)}", f"w{random.randrange(40)}") for _ in range(35)]
    df = spark.createDataFrame(edges, "a string, b string")
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, reach = {}, {}
    for s in near:
        seen, level = {s: 0}, [s]
        while level:
            level = [n for x in level for n in near[x] if n not in seen and not seen.update({n: seen[x] + 1})]
        reach[s] = min(seen)
        want |= {(s, t): k for t, k in seen.items() if 0 < k <= 3}
    assert {(r.src, r.dst): r.depth for r in lexicon.neighbours(df, 3).collect()} == want
    assert {r.id: r.component for r in lexicon.components(df).collect()} == reach


def test_substitution_draws(spark):
    n = 2000
    sentences = spark.createDataFrame([(i, ["dog", "x"]) for i in range(n)], "id long, tokens array<string>")
    entries = spark.createDataFrame([("de", "dog", "hund", 1), ("de", "dog", "koeter", 2), ("fr", "dog", "chien", 1)], "lang string, src_word string, trg_word string, rank int")
    out = lexicon.substitute(sentences, entries, ["de", "fr"], 0.15)
    stats = lexicon.statistics(out).first()
    assert stats.total_tokens == 2 * n and 0.12 * n < stats.replaced_tokens < 0.18 * n
    assert {r.tokens[0] for r in lexicon.augmented(out).collect()} == {"hund", "koeter", "chien"}
    for most in (None, 3):  # joined, and looked up by each worker
        again = {(r.id, r.lang): tuple(r.tokens) for r in lexicon.substitute(sentences.repartition(9), entries, ["de", "fr"], 0.15, most=most).collect()}
        assert again == {(r.id, r.lang): tuple(r.tokens) for r in out.collect()}


def test_multi_substitution_prefers_near_words(spark):
    sentences = spark.createDataFrame([(i, "en", ["dog"]) for i in range(3000)], "id long, src_lang string, tokens array<string>")
    entries = spark.createDataFrame([("en", "dog", "de", "hund", 1), ("en", "dog", "fr", "chien", 2), ("en", "dog", "it", "cane", 1)], "src_lang string, src_word string, trg_lang string, trg_word string, depth int")
    got = Counter(r.tokens[0] for r in lexicon.substitute_multi(sentences, entries, ["de", "fr"], 1.0, max_depth=2).collect())
    assert got == Counter(r.tokens[0] for r in lexicon.substitute_multi(sentences, entries, ["de", "fr"], 1.0, max_depth=2, most=3).collect())
    assert set(got) == {"hund", "chien"} and 1.7 < got["hund"] / got["chien"] < 2.3
    assert set(r.tokens[0] for r in lexicon.substitute_multi(sentences.limit(50), entries, ["es"], 1.0).collect()) == {"dog"}


def test_bleu(spark):
    same = spark.createDataFrame([(1, list("abcdef"), list("abcdef"))], "id long, hyp array<string>, ref array<string>")
    assert evaluation.bleu(evaluation.bleu_statistics(same)).first().bleu == 100.0
    half = spark.createDataFrame([(1, "the cat the cat on the mat".split(), "the cat is on the mat".split())], "id long, hyp array<string>, ref array<string>")
    s = evaluation.bleu_statistics(half).first()
    assert (s.match1, s.total1, s.match2, s.total2, s.match3, s.match4) == (5, 7, 3, 6, 1, 0)
    want = 100 * np.exp(np.mean(np.log([5 / 7, 3 / 6, 1 / 5, 1 / (2 * 4)])))
    assert evaluation.bleu(evaluation.bleu_statistics(half)).first().bleu == round(want, 2)


def test_generation_log_is_anchored(spark):
    lines = ["H-1\t-1\tfoo 12", "S-1\tsee T-34", "noise T-34", "P-1\t-0.1 -0.2", "H-2\t-0.5\ta\tb", "H-x"]
    rows = corpus.generation_log(spark.createDataFrame([(l,) for l in lines], "line string"), "line").collect()
    assert [(r.line_type, r.id, r.score, r.text) for r in rows] == [("H", 1, -1.0, "foo 12"), ("S", 1, None, "see T-34"), ("P", 1, None, "-0.1 -0.2"), ("H", 2, -0.5, "a\tb")]


def test_scores_and_checkpoints(spark):
    lines = ["2024-01-01 00:00:00\tcheckpoint_1\tt\t10", "2024-01-02 00:00:00\tcheckpoint_1\tt\t12", "2024-01-02 00:00:00\tcheckpoint_2\tt\tbad", "2024-01-02 00:00:00\tcheckpoint_3\tt\t12", "2024-01-02 00:00:00\tcheckpoint_best\tt\t99", "2024-01-02 00:00:00\tx_avg_2\tt\t98"]
    log = corpus.score_log(spark.createDataFrame(list(enumerate(lines)), "n int, line string"), "line", skip_averaged=True)
    best = evaluation.ranked_checkpoints(evaluation.latest_scores(log, "n"), "t", 0)
    assert [r.ckpt for r in best.collect()] == ["checkpoint_3", "checkpoint_1"]
    assert [r.ckpt for r in evaluation.to_evict(best, 1).collect()] == ["checkpoint_1"]
    assert evaluation.to_evict(best, 2).collect() == []
    with pytest.raises(ValueError):
        evaluation.to_evict(best, 0)
    p = spark.createDataFrame([("checkpoint_1", "w", 0, 1.0), ("checkpoint_3", "w", 0, 3.0)], "ckpt string, param string, pos int, value double")
    got = {r.k: r.value for r in evaluation.top_averages(evaluation.latest_scores(log, "n"), p, "t", [1, 2]).collect()}
    assert got == {1: 3.0, 2: 2.0}
    assert evaluation.same_parameters(p).first().equal


def test_retrieval_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(0)
    s, t = rng.normal(0, 1, (20, 5)), rng.normal(0, 1, (30, 5))
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    got = {(r.src_id, r["rank"]): r.trg_id for r in evaluation.nearest(frame(s), frame(t), 3).collect()}
    norm = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(-(norm(s) @ norm(t).T), axis=1)[:, :3]
    assert got == {(i, k + 1): int(order[i, k]) for i in range(20) for k in range(3)}


def test_pooling_entities_and_rows(spark):
    m = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "s array<array<double>>, m array<int>")
    assert [r.v for r in m.select(evaluation.masked_mean(F.col("s"), F.col("m")).alias("v")).collect()] == [[2.0, 3.0], None]
    e = evaluation.placed(spark.createDataFrame([(1, "Visit New York and york now please"), (2, "york")], "id int, line string"), "line", [("new york", "NY", "LOC"), ("york", "Y", "LOC")])
    got = {r.id: (r.text, r.entities) for r in e.collect()}
    assert got[1] == ("Visit <--plhd-LOC-0/> and <--plhd-LOC-1/> now please", ["NY", "Y"])
    assert got[2] == ("<--plhd-LOC-0/>", ["Y"])
    late = evaluation.placed(spark.createDataFrame([(1, "the york, New York")], "id int, line string"), "line", [("new york", "NY", ""), ("york", "Y", "LOC")], words=["york"] + ["x"] * 9 + ["New York"])
    assert [(r.text, r.entities) for r in late.collect()] == [("the york, <--plhd-PN-0/>", ["NY"])]
    assert [r.entities for r in evaluation.placed(spark.createDataFrame([("x",)], "line string"), "line", []).collect()] == [[]]


def test_entities_without_the_library_are_the_same():
    import sys

    keys, text = ["ab", "c", "abcd", "bc"], "abcd bc xabc ab"
    found = evaluation._finder(keys)(text)
    had = sys.modules.get("ahocorasick")
    sys.modules["ahocorasick"] = None
    try:
        assert evaluation._finder(keys)(text) == found
    finally:
        del sys.modules["ahocorasick"]
        if had:
            sys.modules["ahocorasick"] = had
    assert [k for _, _, k in evaluation._spans(found)] == ["ab", "abcd", "bc", "ab", "c", "ab"]


def test_new_rows(spark):
    fresh = evaluation.new_embedding_rows(spark, 5, 40, 64).collect()
    values = np.array([r.vec for r in fresh])
    assert values.shape == (40, 64) and abs(values.std() - 64**-0.5) < 0.01


def test_dataset_columns(spark):
    x = spark.createDataFrame([([5, 6, 7, 2],), ([5, 6],), ([2],)], "ids array<bigint>")
    assert [r.v for r in x.select(corpora.with_eos(F.col("ids"), 2, 3).alias("v")).collect()] == [[5, 6, 2], [5, 6, 2], [2]]
    pairs = spark.createDataFrame([(1, "en", "de", "a b", "c")], "id long, src_lang string, trg_lang string, src string, trg string")
    assert corpora.both_directions(pairs).count() == 2
    assert corpora.merged(pairs).first().src == "LANG_TOK_EN a b"
    r = corpora.with_ratio(spark.createDataFrame([("你好吗", "a b"), ("a", "")], "src string, trg string")).collect()
    assert [x.ratio for x in r] == [1.5, 0.0]


def test_ranks_leave_own_columns_alone(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", i, -i, 7, "h", "g0") for i in range(60)], "id long, g string, _h long, _rank long, _n int, h string, g0 string")
    for out in (sampling.down_sample(rows, F.col("id"), 0.5, by=["g"]), sampling.up_sample(rows, F.col("id"), 1.5), sampling.balance(rows, F.col("id"), "g"), sampling.shuffled(rows, F.col("id")), sampling.head_fraction(rows, "id", 50)):
        assert out.columns[:7] == rows.columns
        assert all(r._h == r.id and r._rank == -r.id and (r._n, r.h, r.g0) == (7, "h", "g0") for r in out.collect())
    assert sorted(r.id for r in sampling.head_fraction(rows.repartition(7), "id", 50).collect()) == list(range(30))
    ranks = {r.row.id: r["rank"] for r in sampling.ranked_by(rows, "_n", "id", width=4).collect()}
    assert ranks == {i: i + 1 for i in range(60)}


def test_directions_are_resampled(spark):
    rows = spark.createDataFrame([(i, "de", "en", f"d{i}", f"e{i}") for i in range(10)] + [(20 + i, "en", "fr", f"e{i}", f"f{i}") for i in range(4)], "id long, src_lang string, trg_lang string, src string, trg string")
    out = corpora.in_directions(rows, ["en2de", "de2en", "fr2en"], {"en2de": 0.5, "de2en": 2.25})
    got = Counter((r.src_lang, r.trg_lang) for r in out.collect())
    assert got == {("en", "de"): 5, ("de", "en"): 22, ("fr", "en"): 4}
    assert all(r.src.startswith(r.src_lang[0]) and r.trg.startswith(r.trg_lang[0]) for r in out.collect())


def test_abbreviation_files(spark, tmp_path):
    (tmp_path / "nonbreaking_prefix.en").write_text("# titles\nDr\n\nNo #NUMERIC_ONLY#\nart.\n")
    got = corpus.nonbreaking_prefixes(spark, str(tmp_path), "xx")
    assert got == {"Dr": 1, "No": 2, "art.": 1}
    with pytest.raises(FileNotFoundError):
        corpus.nonbreaking_prefixes(spark, str(tmp_path / "none"), "en")
    with pytest.raises(ValueError):
        corpus.nonbreaking_prefixes(spark, str(tmp_path), "en", most=2)
    from lexiloom.functions import tokenizing

    rows = spark.createDataFrame([("Dr. No. 5 and No. X.",)], "t string")
    assert rows.select(tokenizing.tokenize(F.col("t"), "xx", prefixes=got).alias("t")).first().t == "Dr. No. 5 and No . X ."


def test_shards():
    names = {"train.en-de.en", "train1.de-en.en", "train2.en-de.en", "valid.de-en.en"}
    assert corpus.shards(names, "train", "en", "de") == [("train.en-de.", False), ("train1.de-en.", True), ("train2.en-de.", False)]
    assert corpus.shards(names, "train", "en", "de", combine=False) == [("train.en-de.", False)]
    assert corpus.shards(names, "valid", "en", "de") == [("valid.de-en.", True)]
    with pytest.raises(FileNotFoundError):
        corpus.shards(names, "test", "en", "de")


def test_written_files_read_back(spark, tmp_path):
    merges = [("a", "b"), ("ab", "c</w>")]
    vocabulary.write_merges(merges, spark, str(tmp_path / "codes"))
    lines = corpus.text_corpus(spark, str(tmp_path / "codes"), "xx", across_files=True).select(F.col("line_no").alias("rank"), F.col("text").alias("value"))
    assert [(r.left, r.right) for r in corpus.merges(lines).orderBy("rank").collect()] == merges
    vocabulary.write_vocabulary(spark.createDataFrame([("x", 5), ("y", 7)], "token string, freq long"), str(tmp_path / "vocab"))
    assert [r.value for r in spark.read.text(str(tmp_path / "vocab")).collect()] == ["y\t7", "x\t5"]
    corpora.write_languages(spark.createDataFrame([("en", "a"), ("de", "b")], "lang string, text string"), str(tmp_path / "langs"))
    assert [r.value for r in spark.read.text(str(tmp_path / "langs" / "lang=de")).collect()] == ["b"]
    log = spark.createDataFrame([("H", 1, "one", 0), ("H", 1, "more", 1), ("H", 2, "two", 0), ("S", 2, "src", 1), ("H", 3, "x", 0)], "line_type string, id long, text string, at int")
    corpora.write_hypotheses(log, spark.createDataFrame([(1, "r1"), (2, "r2")], "id long, ref string"), str(tmp_path / "out"))
    assert [sorted(r.value for r in spark.read.text(str(tmp_path / "out" / n)).collect()) for n in ("hyp", "ref")] == [["one", "two"], ["r1", "r2"]]
    vectors = spark.createDataFrame([(f"id{i:03d}", f"text {i}", [i + 0.5, -i * 0.25]) for i in range(40)], "id string, text string, vec array<float>")
    corpus.write_embeddings(vectors.repartition(5), str(tmp_path / "emb"), "en")
    back = corpus.embedding_files(spark, str(tmp_path / "emb" / "en_sent_avg_pool.csv"), str(tmp_path / "emb" / "en.txt"), "en")
    assert sorted((r.id, r.text, tuple(r.vec)) for r in back.collect()) == sorted((r.id, r.text, tuple(r.vec)) for r in vectors.collect())


def test_language_token_ids(spark):
    ids = spark.createDataFrame([("LANG_TOK_DE", 7), ("<unk>", 3)], "token string, id long")
    assert vocabulary.token_id(ids, "LANG_TOK_DE", 3) == 7
    for bad in ("LANG_TOK_FR", "<unk>"):
        with pytest.raises(ValueError):
            vocabulary.token_id(ids, bad, 3)


def test_capped_multi_lexicon(spark):
    rows = spark.createDataFrame([(0, "DE__x\tEN__y__1"), (1, "EN__a\tDE__b__1"), (2, "EN__c\tDE__d__1"), (3, "EN__e\tDE__f__1")], "n int, value string")
    assert sorted(r.src_word for r in corpus.multi_lexicon(rows, "value", ["en"], cap=1, order="n").collect()) == ["a", "c"]


def test_side_files(spark, tmp_path):
    pairs = spark.createDataFrame([(2, "b", "y"), (1, "a", "x")], "id long, src string, trg string")
    corpora.write_sides(pairs, str(tmp_path), "id", ("en", "de"))
    src = corpus.text_corpus(spark, str(tmp_path / "en"), "en")
    trg = corpus.text_corpus(spark, str(tmp_path / "de"), "de")
    assert [tuple(r) for r in corpus.parallel_corpus(src, trg).orderBy("line_no").collect()] == [(0, "a", "x"), (1, "b", "y")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several parts
    try:
        corpora.write_sides(spark.range(500).selectExpr("id", "concat('s', id) src", "concat('t', id) trg"), str(tmp_path / "many"), "id")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sides = [corpus.text_corpus(spark, str(tmp_path / "many" / n), "en", across_files=True) for n in ("src", "trg")]
    assert sides[0].select("file").distinct().count() > 1
    assert [tuple(r) for r in corpus.parallel_corpus(*sides).orderBy("line_no").collect()] == [(i, f"s{i}", f"t{i}") for i in range(500)]


def test_vocabulary_sets(spark):
    a = spark.createDataFrame([("x", 5), ("y", 1)], "token string, freq long")
    b = spark.createDataFrame([("y", 3), ("z", 2)], "token string, freq long")
    assert sorted(tuple(r) for r in vocabulary.merged(a, b).collect()) == [("x", 5), ("y", 1), ("z", 20)]
    assert sorted(tuple(r) for r in vocabulary.total_counts(a, b).collect()) == [("x", 5), ("y", 4), ("z", 2)]
    assert [r.token for r in vocabulary.cut(a, 0, 1).collect()] == ["x"]


def test_streams(spark, tmp_path):
    for name in ("checkpoint_1.pt", "checkpoint_best.pt", "a.txt"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("hello, you\n")
    seen: list[str] = []
    q = monitor.for_each_new(monitor.new_files(spark, str(tmp_path / "in")), monitor.checkpoint_name, seen.extend, str(tmp_path / "state"))
    q.awaitTermination(60)
    assert [s.rsplit("/", 1)[1] for s in seen] == ["checkpoint_1.pt"]
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "x.txt").write_text("Hello, you.\n")
    from lexiloom.functions import tokenizing

    stream = monitor.lines(spark, str(tmp_path / "text")).select(tokenizing.tokenize(F.col("line"), "en").alias("t"))
    stream.writeStream.format("memory").queryName("tokenized").trigger(availableNow=True).start().awaitTermination(60)
    assert [r.t for r in spark.table("tokenized").collect()] == ["Hello , you ."]
    scored = monitor.append_scores(monitor.lines(spark, str(tmp_path / "text")), lambda p: p.select(F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("ts"), F.lit("c").alias("ckpt"), F.lit("t").alias("testset"), F.lit(1.5).alias("score")), str(tmp_path / "log"), str(tmp_path / "state2"))
    scored.awaitTermination(60)
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["2024-01-01 00:00:00\tc\tt\t1.5"]
