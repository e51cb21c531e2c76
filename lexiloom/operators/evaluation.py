"""Corpus BLEU, score logs, checkpoint ranking and averaging, retrieval accuracy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.operators.vocabulary import new_tokens
from lexiloom.sources.corpus import ship

ORDERS = 4
BLOCK_ROWS = 2048


def ngrams(words: Column, n: int) -> Column:
    last = F.size(words) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def _of_order(n: int):
    return lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"))


def bleu_statistics(rows: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """One row: matches and totals of each order, and both lengths; sums of parts are the whole's.

    ``rows``: (id, hyp array<string>, ref array<string>).
    """
    both = []
    for side, column in (("h", hyp), ("r", ref)):
        grams = F.flatten(F.array(*(F.transform(ngrams(F.col(column), n), _of_order(n)) for n in range(1, ORDERS + 1))))
        both.append(rows.select("id", F.explode(grams).alias("x")).groupBy("id", "x.n", "x.g").agg(F.count("*").alias(side)))
    met = both[0].join(both[1], ["id", "n", "g"], "left")
    sums = met.groupBy("n").agg(F.sum(F.least("h", F.coalesce("r", F.lit(0)))).alias("match"), F.sum("h").alias("total"))
    one = sums.agg(*(F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).cast("bigint").alias(f"{c}{n}") for c in ("match", "total") for n in range(1, ORDERS + 1)))
    lengths = rows.agg(F.coalesce(F.sum(F.size(hyp)), F.lit(0)).cast("bigint").alias("hyp_len"), F.coalesce(F.sum(F.size(ref)), F.lit(0)).cast("bigint").alias("ref_len"))
    return one.join(F.broadcast(lengths))  # one row each


def bleu(stats: DataFrame) -> DataFrame:
    """The score with exponential smoothing: each order without a match counts as half of the one before."""
    precision = []
    halvings: Column = F.lit(0)
    for n in range(1, ORDERS + 1):
        match, total = F.col(f"match{n}"), F.col(f"total{n}")
        halvings = halvings + F.when(match == 0, 1).otherwise(0)
        precision.append(F.when(total == 0, F.lit(0.0)).when(match == 0, 1 / (F.pow(F.lit(2.0), halvings) * total)).otherwise(match / total))
    mean = F.when(F.least(*precision) > 0, F.exp(sum((F.log(p) for p in precision), F.lit(0.0)) / ORDERS)).otherwise(0.0)
    brevity = F.when(F.col("hyp_len") == 0, 0.0).when(F.col("hyp_len") < F.col("ref_len"), F.exp(1 - F.col("ref_len") / F.col("hyp_len"))).otherwise(1.0)
    return stats.withColumn("bleu", F.round(100 * brevity * mean, 2))


def unknown_apart(words: Column, is_reference: bool, unknown: str = "<unk>") -> Column:
    """Unknown tokens written so that hypothesis and reference never match on them."""
    return F.transform(words, lambda w: F.when(w == unknown, F.lit("UNKNOWNTOKENINREF" if is_reference else "UNKNOWNTOKENINHYP")).otherwise(w))


def latest_scores(log: DataFrame, order: str) -> DataFrame:
    """The newest score of each checkpoint and test set; of equal times the first by ``order``."""
    w = W.partitionBy("ckpt", "testset").orderBy(F.desc("ts"), order)
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranked_checkpoints(scores: DataFrame, testset: str, k: int) -> DataFrame:
    """Best checkpoints of a test set by score, then number; all for k <= 0."""
    number = F.regexp_extract("ckpt", r"(\d+)$", 1).try_cast("bigint")
    rows = scores.where((F.col("testset") == testset) & F.col("score").isNotNull() & ~F.col("ckpt").isin("checkpoint_best", "checkpoint_last"))
    out = rows.select("ckpt", "score", number.alias("number")).orderBy(F.desc("score"), F.desc("number"))
    return out.limit(k) if k > 0 else out


def to_evict(ranked: DataFrame, keep: int) -> DataFrame:
    """The worst one of keep + 1 checkpoints; none of up to ``keep``."""
    n = ranked.limit(keep + 2).count()
    if n > keep + 1:
        raise ValueError(f"more than {keep + 1} checkpoints")
    return ranked.orderBy("score", "number").limit(1 if n == keep + 1 else 0)


def averaged(parameters: DataFrame) -> DataFrame:
    """(param, pos, value): the mean over checkpoints; ``parameters`` is (ckpt, param, pos, value)."""
    return parameters.groupBy("param", "pos").agg(F.avg(F.col("value").cast("float").cast("double")).alias("value"))


def same_parameters(parameters: DataFrame) -> DataFrame:
    """Whether all checkpoints have the same parameters: (checkpoints, kinds, equal)."""
    sets = parameters.groupBy("ckpt").agg(F.array_join(F.array_sort(F.collect_set("param")), ",").alias("s"))
    return sets.agg(F.count("*").alias("checkpoints"), F.countDistinct("s").alias("kinds")).withColumn("equal", F.col("kinds") <= 1)


def ranked_hypotheses(log: DataFrame, order: str, rank: int = 0) -> DataFrame:
    """The hypothesis of each id in place ``rank`` by arrival."""
    w = W.partitionBy("id").orderBy(order)
    return log.where("line_type = 'H'").withColumn("_n", F.row_number().over(w)).where(F.col("_n") == rank + 1).drop("_n")


def masked_mean(states: Column, mask: Column) -> Column:
    """The mean of the states (array of vectors) whose mask isn't 0."""
    kept = F.filter(F.arrays_zip(states.alias("v"), mask.alias("m")), lambda x: x["m"] != 0)
    n = F.size(kept)
    width = F.size(F.get(states, F.lit(0)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(kept, F.lit(0.0), lambda s, x: s + F.get(x["v"], i)) / n))


def pooled(states: DataFrame, keys: list[str], vec: str, mask: Column) -> DataFrame:
    """(keys, pos, value): the mean of the vectors whose ``mask`` isn't 0, added up where they lie; groups without one have no row."""
    return states.where(mask != 0).select(*keys, F.posexplode(vec).alias("pos", "value")).groupBy(*keys, "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))


def nearest(sources: DataFrame, targets: DataFrame, k: int = 5) -> DataFrame:
    """(src_id, trg_id, similarity, rank): exact cosine top-k of (id, vec) among (id, vec)."""
    one = F.lit("").alias("lang")
    return nearest_in_pairs(sources.select(one, "id", "vec"), targets.select(one, "id", "vec"), k, lambda a, b: True).drop("src_lang", "trg_lang")


def nearest_in_pairs(sources: DataFrame, targets: DataFrame, k: int, wanted: Callable[[str, str], bool]) -> DataFrame:
    """(src_lang, trg_lang, src_id, trg_id, similarity, rank): exact cosine top-k of (lang, id, vec) for all ``wanted`` pairs of languages in one plan.

    Both sides of a pair are dealt into blocks; each pair of blocks is one
    product of matrices in Arrow, which returns k rows for each source, and the
    blocks' best are ranked again.  Only the languages' counts come to the driver.
    """
    ship(sources.sparkSession)
    cuts = []
    for rows in (sources, targets):
        cuts.append({r.lang: max(1, -(-r.n // BLOCK_ROWS)) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()})
    grid = [(a, b, cuts[0][a], cuts[1][b]) for a in sorted(cuts[0]) for b in sorted(cuts[1]) if wanted(a, b)]
    pairs = F.broadcast(sources.sparkSession.createDataFrame(grid, "src_lang string, trg_lang string, sb int, tb int"))  # a row a pair of languages
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    v = F.col("vec").cast("array<double>").alias("vec")
    left = sources.withColumnRenamed("lang", "src_lang").join(pairs, "src_lang").select("src_lang", "trg_lang", "id", v, own("sb").alias("i"), every("tb").alias("j"), F.lit(True).alias("asks"))
    right = targets.withColumnRenamed("lang", "trg_lang").join(pairs, "trg_lang").select("src_lang", "trg_lang", "id", v, every("sb").alias("i"), own("tb").alias("j"), F.lit(False).alias("asks"))
    out = pa.schema([("src_lang", pa.string()), ("trg_lang", pa.string()), ("src_id", pa.int64()), ("trg_id", pa.int64()), ("similarity", pa.float64())])

    def cell(data: pa.Table) -> pa.Table:
        asks = np.asarray(data.column("asks").to_numpy(zero_copy_only=False), bool)
        ids = data.column("id").to_numpy()
        if not asks.any() or asks.all():
            return out.empty_table()
        flat = data.column("vec").combine_chunks()
        x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        sim = x[asks] @ x[~asks].T
        a, b = ids[asks], ids[~asks]
        order = np.stack([np.lexsort((b, -np.round(row, 9)))[:k] for row in sim])
        n = order.size
        names = [pa.array([data.column(c)[0].as_py()] * n, pa.string()) for c in ("src_lang", "trg_lang")]
        return pa.table([*names, np.repeat(a, order.shape[1]), b[order.ravel()], np.take_along_axis(sim, order, 1).ravel()], schema=out)

    found = left.unionByName(right).groupBy("src_lang", "trg_lang", "i", "j").applyInArrow(cell, "src_lang string, trg_lang string, src_id long, trg_id long, similarity double")
    w = W.partitionBy("src_lang", "trg_lang", "src_id").orderBy(F.desc(F.round("similarity", 9)), "trg_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieval_matrix(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(src_lang, trg_lang, top1, top5) for all ordered pairs of ``languages``; ``rows`` is (lang, id, vec), equal ids match."""
    rows = rows.where(F.col("lang").isin(languages))
    found = nearest_in_pairs(rows, rows, 5, lambda a, b: a != b)
    sizes = rows.groupBy(F.col("lang").alias("trg_lang")).agg(F.count("*").alias("n"))
    hit = lambda n: F.sum(F.when((F.col("src_id") == F.col("trg_id")) & (F.col("rank") <= n), 1).otherwise(0))
    hits = found.groupBy("src_lang", "trg_lang").agg(hit(1).alias("one"), hit(5).alias("five")).join(F.broadcast(sizes), "trg_lang")  # a row a language
    return hits.select("src_lang", "trg_lang", F.round(F.col("one") / F.col("n"), 6).alias("top1"), F.round(F.col("five") / F.col("n"), 6).alias("top5"))


def retrieval_accuracy(found: DataFrame, targets: int, match: Column) -> DataFrame:
    """Shares of the targets found first and among the first five."""
    hit = lambda n: F.coalesce(F.sum(F.when(match & (F.col("rank") <= n), 1).otherwise(0)), F.lit(0)) / F.lit(targets)
    return found.agg(F.round(hit(1), 6).alias("top1"), F.round(hit(5), 6).alias("top5"))


def new_embedding_rows(spark: SparkSession, first_id: int, count: int, dimension: int, seed: int = 1) -> DataFrame:
    """(id, vec): rows for new tokens, drawn from N(0, dimension ** -0.5)."""
    places = F.explode(F.sequence(F.lit(0), F.lit(dimension - 1))).alias("pos")
    noise = spark.range(first_id, first_id + count).select("id", places).withColumn("x", F.randn(seed) * dimension**-0.5)
    return noise.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s.x.cast("float")).alias("vec"))


#: The tables of a model that hold a row for each token.
EMBEDDING_TABLES = ("encoder.embed_tokens.weight", "decoder.embed_tokens.weight")


def extended(parameters: DataFrame, current: DataFrame, more: DataFrame, dimension: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(parameters, vocabulary) with a row in both embedding tables for each token of ``more`` that ``current`` lacks.

    ``parameters`` is (param, pos, value), pos counting through a table's rows;
    vocabularies are (token, freq).  Other parameters stay as they are.
    """
    fresh = new_tokens(current, more).select("token", F.lit(20).cast("bigint").alias("freq"))
    rows = current.count()
    tables = F.explode(F.array(*map(F.lit, EMBEDDING_TABLES))).alias("param")
    drawn = new_embedding_rows(parameters.sparkSession, rows, fresh.count(), dimension, seed)
    places = drawn.select("id", F.posexplode("vec").alias("i", "value")).select(tables, (F.col("id") * dimension + F.col("i")).alias("pos"), F.col("value").cast("double").alias("value"))
    return parameters.select("param", F.col("pos").cast("bigint").alias("pos"), "value").unionByName(places), current.select("token", "freq").unionByName(fresh)


def write_parameters(parameters: DataFrame, folder: str) -> None:
    """(param, pos, value) as Parquet, a subfolder for each parameter, in ranges of pos."""
    parameters.repartitionByRange("param", "pos").sortWithinPartitions("param", "pos").write.mode("overwrite").partitionBy("param").parquet(folder)


def top_averages(scores: DataFrame, parameters: DataFrame, testset: str, sizes: list[int]) -> DataFrame:
    """(k, param, pos, value): for each k of ``sizes`` the mean over the k best checkpoints."""
    best = ranked_checkpoints(scores, testset, max(sizes)).withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), F.desc("number"))))
    ks = parameters.sparkSession.createDataFrame([(k,) for k in sizes], "k int")
    # at most max(sizes) * len(sizes) rows
    chosen = best.join(ks, F.col("place") <= F.col("k")).select("k", "ckpt")
    return parameters.join(F.broadcast(chosen), "ckpt").groupBy("k", "param", "pos").agg(F.avg(F.col("value").cast("float").cast("double")).alias("value"))


def placed(rows: DataFrame, column: str, entities: list[tuple[str, str, str]], words: list[str] | None = None, share: float = 0.9) -> DataFrame:
    """Entity placeholders: ``entities`` are (surface, mapped, type), type "PN" if empty.

    Surfaces are found in lower case, anywhere in the text.  Of matches that
    overlap the one that begins first stays, of those that begin together the
    longest.  The k-th entity of a type in a row becomes <--plhd-TYPE-k/>, where
    its text first stands.  With ``words``, an entity counts only if its text is
    in that list, behind the first ``share`` of it.  ``text`` and ``entities``
    (the mapped texts in order) replace ``column``.
    """
    ship(rows.sparkSession)
    table = {a.lower(): (b, t or "PN") for a, b, t in entities if a}
    late = None if words is None else {w for i, w in reversed(list(enumerate(words))) if words.index(w) == i and i / len(words) > share}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(sorted(table))
        for b in batches:
            texts, used = [], []
            for text in b.column(column).to_pylist():
                text = original = text or ""
                counts: dict[str, int] = {}
                mapped = []
                for begin, end, key in _spans(find(text.lower())):
                    surface = original[begin:end]
                    if late is not None and surface not in late:
                        continue
                    target, kind = table[key]
                    counts[kind] = counts.get(kind, -1) + 1
                    text = text.replace(surface, f"<--plhd-{kind}-{counts[kind]}/>", 1) if surface else text
                    mapped.append(target)
                texts.append(text)
                used.append(mapped)
            keep = {c: b.column(c) for c in others}
            yield pa.record_batch(keep | {"text": pa.array(texts, pa.string()), "entities": pa.array(used, pa.list_(pa.string()))})

    others = [c for c in rows.columns if c not in (column, "text", "entities")]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*others).dtypes)
    return rows.mapInArrow(run, f"{schema + ', ' if schema else ''}text string, entities array<string>")


def _finder(keys: list[str]) -> Callable[[str], list[tuple[int, int, str]]]:
    """All places (begin, end, key) of ``keys`` in a text by end, longer ones first; by an automaton where the library is there."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: sorted(((i, i + len(k), k) for k in keys for i in range(len(text)) if text.startswith(k, i)), key=lambda x: (x[1], x[0]))
    automaton = ahocorasick.Automaton()
    for k in keys:
        automaton.add_word(k, k)
    automaton.make_automaton()
    return lambda text: sorted(((end + 1 - len(k), end + 1, k) for end, k in automaton.iter(text)), key=lambda x: (x[1], x[0])) if keys else []


def _spans(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Matches in order of their ends; a later one that begins no later than the last kept takes its place."""
    kept: list[tuple[int, int, str]] = []
    for m in found:
        if kept and m[0] <= kept[-1][0]:
            kept[-1] = m
        elif not kept or m[0] >= kept[-1][1]:
            kept.append(m)
    return kept
