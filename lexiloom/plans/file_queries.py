"""Queries of readers, writers, streams and dataset steps: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import cleaning, tokenizing
from lexiloom.operators import corpora, evaluation, lexicon, sampling, vocabulary
from lexiloom.plans import config, pipeline, queries, task
from lexiloom.plans.queries import query, table
from lexiloom.sources import corpus
from lexiloom.streaming import monitor

_L, _T, _C, _P = queries._LINES, queries._TOKENS, queries._COUNTS, queries._TURNS


@query("vocab_files", f"WITH {_L}, {_T}, {_C} SELECT token, freq FROM c WHERE freq >= 3 AND NOT regexp_matches(token, '\\s')")
def vocab_files(spark, d):
    """The vocabulary written as text and read back above a threshold; tokens with blanks of other kinds can't be."""
    folder = corpus.new_folder(spark, "vocabulary")
    vocabulary.write_vocabulary(queries.counts(spark, d).where(~F.col("token").rlike(r"\s")), folder)
    return corpus.vocabulary(spark.read.text(folder), "value", "\t", threshold=3)


@query("code_files", "SELECT CAST(min(doc_id) AS BIGINT) AS rank, source AS \"left\", lang AS \"right\" FROM (SELECT row_number() OVER (ORDER BY doc_id) AS doc_id, source, lang FROM documents) GROUP BY source, lang")
def code_files(spark, d):
    """A merge table with a header and repeated pairs, written and read back: the first of equal pairs stays."""
    folder = corpus.new_folder(spark, "codes")
    rows = table(spark, d, "documents").orderBy("doc_id").select(F.concat_ws(" ", "source", "lang").alias("value"))
    header = spark.createDataFrame([("#version: 0.2",)], "value string").coalesce(1)
    header.write.text(folder + "/a")
    rows.write.text(folder + "/b")
    lines = corpus.text_corpus(spark, folder + "/*", "xx", across_files=True)
    return corpus.merges(lines.select(F.col("line_no").alias("rank"), F.col("text").alias("value")))


@query("embedding_files", "SELECT 'v' || vec_id AS id, 'sentence ' || label AS text, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total, CAST(len(embedding) AS BIGINT) AS width FROM embeddings")
def embedding_files(spark, d):
    folder = corpus.new_folder(spark, "embeddings")
    e = table(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), F.concat(F.lit("sentence "), F.col("label").cast("string")).alias("text"), F.col("embedding").alias("vec"))
    corpus.write_embeddings(e, folder, "en")
    back = corpus.embedding_files(spark, f"{folder}/en_sent_avg_pool.csv", f"{folder}/en.txt", "en")
    return back.select("id", "text", F.round(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.size("vec").cast("bigint").alias("width"))


@query("language_files", f"WITH {_L} SELECT lang, replace(line, chr(13), '') AS line, CAST(count(*) AS BIGINT) AS n FROM l WHERE NOT contains(line, chr(13)) GROUP BY ALL")
def language_files(spark, d):
    """Lines written in a folder a language and scanned again by folder."""
    folder = corpus.new_folder(spark, "languages")
    rows = queries.lines(spark, d).where(~F.contains("line", F.lit("\r")))
    corpora.write_languages(rows.select("lang", F.col("line").alias("text")), folder)
    parts = [corpus.text_corpus(spark, f"{folder}/lang={l}", l) for l in ("de", "en", "es", "fr")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("lang", F.col("text").alias("line")).agg(F.count("*").alias("n"))


@query("side_files", f"WITH {_P}, n AS (SELECT row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS line_no, replace(src, chr(10), ' ') AS src, replace(trg, chr(10), ' ') AS trg FROM p) SELECT line_no, src, trg, CASE WHEN line_no % 2 = 0 THEN '0-' || line_no END AS align FROM n")
def side_files(spark, d):
    """Both sides written with one order, read back by line number, with the alignments of some."""
    folder = corpus.new_folder(spark, "sides")
    flat = lambda c: F.replace(c, F.lit("\n"), F.lit(" ")).alias(c)
    corpora.write_sides(queries.turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), flat("src"), flat("trg")), folder, "id")
    src, trg = (corpus.text_corpus(spark, f"{folder}/{n}", "xx", across_files=True) for n in ("src", "trg"))
    n = F.col("line_no")
    return corpus.parallel_corpus(src, trg, src.where(n % 2 == 0).select("line_no", F.concat(F.lit("0-"), n.cast("string")).alias("text")))


@query("hypothesis_files", "SELECT h.text AS hyp, r.text AS ref FROM (SELECT conv_id, replace(text, chr(10), ' ') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant') h JOIN (SELECT conv_id, replace(text, chr(10), ' ') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') r ON h.conv_id = r.conv_id AND h.n = 1 AND r.n = 1")
def hypothesis_files(spark, d):
    folder = corpus.new_folder(spark, "hypotheses")
    c = table(spark, d, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    log = c.where("role = 'assistant'").select(F.lit("H").alias("line_type"), F.col("conv_id").alias("id"), "text", F.col("turn").alias("at"))
    refs = c.where("role = 'user'").groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", "turn").alias("ref"))
    corpora.write_hypotheses(log, refs, folder)
    hyp, ref = (corpus.text_corpus(spark, f"{folder}/{n}", "xx", across_files=True) for n in ("hyp", "ref"))
    return corpus.parallel_corpus(hyp, ref).select(F.col("src").alias("hyp"), F.col("trg").alias("ref"))


@query("lexicon_by_depth", f"WITH {queries._PSEUDO} SELECT 'en' AS src_lang, src_word, 1 + rank % 3 AS depth, string_agg(trg_word || ':' || lang, ' ' ORDER BY trg_word, lang) AS words FROM x GROUP BY ALL")
def lexicon_by_depth(spark, d):
    e = queries.pseudo_lexicon(spark, d).select(F.lit("en").alias("src_lang"), "src_word", F.col("lang").alias("trg_lang"), "trg_word", (1 + F.col("rank") % 3).alias("depth"))
    words = F.array_join(F.transform("words", lambda w: F.concat_ws(":", w.trg_word, w.trg_lang)), " ")
    return lexicon.by_depth(e).select("src_lang", "src_word", "depth", words.alias("words"))


@query("joint_counts", f"WITH {_P}, {_L}, j AS (SELECT 'en' AS lang, src AS line FROM p UNION ALL SELECT 'de', trg FROM p UNION ALL SELECT lang, line FROM l), w AS (SELECT lang, unnest(string_split(line, ' ')) AS token FROM j) SELECT lang, token, CAST(count(*) AS BIGINT) AS freq FROM w WHERE length(token) > 0 GROUP BY ALL")
def joint_counts(spark, d):
    """Word counts over parallel and monolingual text of each language."""
    t = queries.turns(spark, d)
    rows = t.select(F.lit("en").alias("lang"), F.col("src").alias("line")).unionByName(t.select(F.lit("de").alias("lang"), F.col("trg").alias("line"))).unionByName(queries.lines(spark, d).select("lang", "line"))
    return rows.select("lang", F.explode(tokenizing.tokens(F.col("line"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("freq"))


@query("dataset_concat", "SELECT doc_id, CAST(t.c AS INTEGER) AS copy FROM documents, unnest(range(1, CASE WHEN lang = 'en' THEN 3 ELSE 2 END)) AS t(c)")
def dataset_concat(spark, d):
    """Shards one after the other, the first repeated."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    shards = [docs.where(F.col("lang") == l) for l in ("en", "de", "fr", "es")]
    first = sampling.repeat_primary(shards[0], F.lit(True), 2)
    for s in shards[1:]:
        first = first.unionByName(sampling.repeat_primary(s, F.lit(False), 2))
    return first.select("doc_id", "copy")


@query("foreign_lexicons", f"WITH {queries._PSEUDO} SELECT lang, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang FROM x UNION ALL SELECT lang FROM k) WHERE lang <> 'en' GROUP BY lang")
def foreign_lexicons(spark, d):
    rows = queries.pseudo_lexicon(spark, d).select("lang").unionByName(queries.ranked_words(spark, d).select("lang"))
    return rows.where(F.col("lang") != "en").groupBy("lang").agg(F.count("*").alias("n"))


@query("language_ids", f"WITH {_L}, {_T}, {_C}, {queries._IDS} SELECT doc_id, string_agg(id, ' ' ORDER BY pos) || ' 2004' AS ids, '2005' AS prefix FROM ti GROUP BY doc_id")
def language_ids(spark, d):
    """Ids with their language's number at the end, and the one that decoding starts with."""
    rows = corpora.with_prefix(queries._ids(spark, d), 2005)
    text = lambda c: F.array_join(c.cast("array<string>"), " ")
    return rows.select("doc_id", text(corpora.with_language_id(F.col("ids"), 2004)).alias("ids"), text(F.col("prefix")).alias("prefix"))


@query("tok_colon", f"WITH {_L} SELECT doc_id, line_no, {queries._replaced(queries._replaced(chr(39) + 'USA:n 20: x:' + chr(39) + ' || line', (chr(40) + '[^' + chr(92) + 'p{L}' + chr(92) + 'p{Nd}' + chr(92) + 's.:' + chr(39) + '`,' + chr(92) + '-])', ' ' + chr(92) + '1 ')), ('(:)([^' + chr(92) + 'p{Ll}:]|$)', ' ' + chr(92) + '1 ' + chr(92) + '2'))} AS text FROM l WHERE NOT contains(line, ':')")
def tok_colon(spark, d):
    """The colon rule of Finnish and Swedish."""
    from lexiloom.functions.rules import apply

    text = F.concat(F.lit("USA:n 20: x:"), F.col("line"))
    return queries.lines(spark, d).where(~F.contains("line", F.lit(":"))).select("doc_id", "line_no", apply(text, tokenizing.SPECIALS_COLON).alias("text"))


@query("tok_markup", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<seg id=' || doc_id || '>' ELSE '< seg' || doc_id || ' >' END AS text FROM documents")
def tok_markup(spark, d):
    """Lines that are one tag stay; others are tokenised."""
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<seg id="), F.col("doc_id").cast("string"), F.lit(">"))).otherwise(F.concat(F.lit("<seg"), F.col("doc_id").cast("string"), F.lit("> ")))
    return table(spark, d, "documents").select("doc_id", tokenizing.tokenize(text, "en", skip_markup=True).alias("text"))


@query("latest_plain_score", queries.ORACLE_SQL["latest_score"].replace("FROM events WHERE value IS NOT NULL", "FROM events WHERE value IS NOT NULL AND user_id % 3 <> 0"))
def latest_plain_score(spark, d):
    """As latest_score where every third checkpoint is an average, which is left out."""
    e = table(spark, d, "events").where("value is not null")
    name = F.concat(F.lit("checkpoint_"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 3 == 0, F.lit("_avg_5")).otherwise(F.lit("")))
    line = F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), name, "event_type", F.round("value", 4).cast("string"))
    log = corpus.score_log(e.select("event_id", line.alias("line")), "line", skip_averaged=True)
    return evaluation.latest_scores(log, "event_id").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "ckpt", "testset", "score")


_BEST = queries._RANKED + ", bk AS (SELECT ckpt, row_number() OVER (ORDER BY score DESC, number DESC) AS place FROM rk), pm AS (SELECT 'checkpoint_' || (1 + vec_id % 60) AS ckpt, 'p' || (vec_id % 5) AS param, CAST(i.i - 1 AS INTEGER) AS pos, CAST(embedding[CAST(i.i AS INTEGER)] AS DOUBLE) AS value FROM embeddings, unnest(range(1, 65)) AS i(i))"


@query("top_averages", f"{_BEST} SELECT CAST(k.k AS INTEGER) AS k, param, pos, round(avg(value), 6) AS value FROM pm JOIN bk USING (ckpt) JOIN (SELECT unnest([5, 20, 40]) AS k) k ON bk.place <= k.k GROUP BY ALL")
def top_averages(spark, d):
    """Parameters averaged over the best 5, 20 and 40 checkpoints."""
    scores = evaluation.latest_scores(queries.score_rows(spark, d), "event_id")
    e = table(spark, d, "embeddings")
    name = F.concat(F.lit("checkpoint_"), (1 + F.col("vec_id") % 60).cast("string"))
    parameters = e.select(name.alias("ckpt"), F.concat(F.lit("p"), (F.col("vec_id") % 5).cast("string")).alias("param"), F.posexplode("embedding").alias("pos", "value"))
    return evaluation.top_averages(scores, parameters, "click", [5, 20, 40]).select("k", "param", "pos", F.round("value", 6).alias("value"))


_TABLES = "(SELECT unnest(['encoder.embed_tokens.weight', 'decoder.embed_tokens.weight']) AS param)"


@query("extended_parameters", f"WITH {queries._TWO}, n AS (SELECT (SELECT count(*) FROM a) AS old, (SELECT count(*) FROM b WHERE token NOT IN (SELECT token FROM a)) AS fresh) SELECT param, CAST(8 * (old + fresh) AS BIGINT) AS places, CAST(8 * old AS BIGINT) AS kept FROM n, {_TABLES} t UNION ALL SELECT 'other', CAST(1 AS BIGINT), CAST(1 AS BIGINT)")
def extended_parameters(spark, d):
    """New tokens appended to both embedding tables, written and read back: places of each table and those that kept their value."""
    a, b = queries._lang_counts(spark, d, "en"), queries._lang_counts(spark, d, "de")
    width = 8
    rows = spark.range(a.count() * width).select(F.explode(F.array(*map(F.lit, evaluation.EMBEDDING_TABLES))).alias("param"), F.col("id").alias("pos"), F.lit(100.0).alias("value"))
    rows = rows.unionByName(spark.createDataFrame([("other", 0, 100.0)], "param string, pos long, value double"))
    out, _ = evaluation.extended(rows, a, b, width)
    folder = corpus.new_folder(spark, "parameters")
    evaluation.write_parameters(out, folder)
    kept = F.sum(F.when(F.col("value") == 100.0, 1).otherwise(0))
    return spark.read.parquet(folder).groupBy("param").agg(F.count("*").alias("places"), kept.alias("kept"))


_TREE = """
pairs: "en_de;en_fr"
languages: "en;de;fr"
default_pairs:
  deduplicate: true
  shuffle: false
de_en:
  shuffle: true
default_langs:
  tokenizer: Moses
ras:
  vocab_size: 2000
"""


@query("config_flat", "SELECT * FROM (VALUES ('pairs', 'en_de;en_fr'), ('languages', 'en;de;fr'), ('default_pairs_deduplicate', 'true'), ('default_pairs_shuffle', 'false'), ('de_en_shuffle', 'true'), ('default_langs_tokenizer', 'Moses'), ('ras_vocab_size', '2000')) AS t(name, value)")
def config_flat(spark, d):
    return spark.createDataFrame(sorted(config.parse(_TREE).flat.items()), "name string, value string")


@query("config_pairs", "SELECT * FROM (VALUES ('en_de', TRUE, TRUE), ('en_fr', TRUE, FALSE)) AS t(pair, deduplicate, shuffle)")
def config_pairs(spark, d):
    """Settings of each pair, read back from the text generated for it."""
    texts = {k: config.parse(v) for k, v in config.parse(_TREE).generated().items() if "_" in k}
    return spark.createDataFrame([(k, c.tree["deduplicate"] == "true", c.tree["shuffle"] == "true") for k, c in texts.items()], "pair string, deduplicate boolean, shuffle boolean")


@query("reserved_symbols", "SELECT 'no_trans_breaker/>' AS symbol UNION ALL SELECT k || '_ph' || n || '/>' FROM (SELECT unnest(['emoji_trans', 'ignore_trans', 'no_trans', 'punc_trans']) AS k), (SELECT unnest(['', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9']) AS n)")
def reserved_symbols(spark, d):
    return spark.createDataFrame([(s,) for s in task.reserved_symbols()], "symbol string")


@query("encoder_round_trip", f"WITH {_L} SELECT doc_id, line_no, array_to_string(list_filter(string_split(line, ' '), lambda q: length(q) > 0), ' ') AS text FROM l")
def encoder_round_trip(spark, d):
    """Lines through a pipeline of encoders made from its own JSON, and back."""
    merges = [("t", "h"), ("th", "e</w>"), ("e", "r"), ("a", "n"), ("e", "n")]
    first = pipeline.Pipeline([pipeline.MergeEncoder(merges, ["doc_id", "line_no"])])
    again = pipeline.Pipeline.from_json(first.to_json(), {"MergeEncoder": lambda _: pipeline.MergeEncoder(merges, ["doc_id", "line_no"])})
    rows = queries.lines(spark, d).select("doc_id", "line_no", F.col("line").alias("text"))
    return again.decode(again.encode(rows, "text"), "text")


def _streamed(rows: DataFrame, name: str) -> DataFrame:
    """A stream run over what is there, its result as a table."""
    spark = rows.sparkSession
    folder = corpus.new_folder(spark, name)
    rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


@query("stream_clean", queries.ORACLE_SQL["clean_lines"])
def stream_clean(spark, d):
    """The cleaning of clean_lines on a stream of the table's files."""
    docs = table(spark, d, "documents")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "*.parquet").parquet(_folder_of(docs))
    rows = corpus.lines(stream.where("doc_id is not null").select("doc_id", "lang", "text"))
    return _streamed(rows.select("doc_id", "line_no", cleaning.clean(F.col("line"), F.col("lang")).alias("text")), "stream")


def _folder_of(docs: DataFrame) -> str:
    """A folder that holds the files of a table and no others, as file streams read folders: a copy where the table is one file among several."""
    folder = corpus.new_folder(docs.sparkSession, "streamed")
    docs.write.parquet(folder)
    return folder


@query("stream_scores", "SELECT 'checkpoint_' || user_id AS ckpt, event_type AS testset, CAST(count(*) AS BIGINT) AS n, round(max(round(value, 4)), 4) AS best FROM events WHERE value IS NOT NULL GROUP BY ALL")
def stream_scores(spark, d):
    """Scores appended to a log by micro-batches, read back and summed up."""
    e = table(spark, d, "events").where("value is not null").select("ts", F.concat(F.lit("checkpoint_"), F.col("user_id").cast("string")).alias("ckpt"), F.col("event_type").alias("testset"), F.round("value", 4).alias("score"))
    stream = spark.readStream.schema(e.schema).parquet(_folder_of(e))
    folder = corpus.new_folder(spark, "scores")
    monitor.append_scores(stream, lambda part: part, f"{folder}/log", f"{folder}/state").awaitTermination()
    log = corpus.score_log(spark.read.text(f"{folder}/log/*"), "value")
    return log.groupBy("ckpt", "testset").agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("best"))
