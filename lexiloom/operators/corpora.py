"""Deduplication, ratios, tags, merges and bounds of parallel corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.tokenizing import has_cjk, length_ratio, tagged, tokens
from lexiloom.operators import sampling
from lexiloom.operators.evaluation import ranked_hypotheses
from lexiloom.sources.corpus import settled


def distinct_pairs(rows: DataFrame, src: str = "src", trg: str = "trg") -> DataFrame:
    return rows.dropDuplicates([src, trg])


def sentence_length(column: Column) -> Column:
    """Tokens; text with CJK characters counts by character."""
    by_word = F.size(tokens(column))
    return F.when(has_cjk(column), F.length(F.regexp_replace(column, r"(?U)\s", ""))).otherwise(by_word).cast("bigint")


def with_ratio(rows: DataFrame, src: str = "src", trg: str = "trg") -> DataFrame:
    return rows.withColumn("src_len", sentence_length(F.col(src))).withColumn("trg_len", sentence_length(F.col(trg))).withColumn("ratio", length_ratio(F.col("src_len"), F.col("trg_len")))


def within_ratio(rows: DataFrame, low: float, high: float) -> DataFrame:
    return rows.where(F.col("ratio").between(low, high))


def both_directions(rows: DataFrame) -> DataFrame:
    """Each pair and its reverse: (id, src_lang, trg_lang, src, trg)."""
    back = rows.select("id", F.col("trg_lang").alias("src_lang"), F.col("src_lang").alias("trg_lang"), F.col("trg").alias("src"), F.col("src").alias("trg"))
    return rows.select("id", "src_lang", "trg_lang", "src", "trg").unionByName(back)


def merged(rows: DataFrame) -> DataFrame:
    """Language tags put in front of both sides."""
    return rows.select("id", tagged(F.col("src_lang"), F.col("src")).alias("src"), tagged(F.col("trg_lang"), F.col("trg")).alias("trg"))


def in_directions(rows: DataFrame, directions: list[str], ratios: dict[str, float] | None = None, seed: str = "1") -> DataFrame:
    """Rows of pairs turned into the wanted ``directions`` ("en2de"), each resampled by its ratio: (id, src_lang, trg_lang, src, trg).

    A pair serves both of its directions.  A ratio below 1 keeps floor(n *
    ratio) rows; one above repeats all rows int(ratio) times and samples the rest.
    """
    name = F.concat_ws("2", "src_lang", "trg_lang")
    out = both_directions(rows).where(name.isin(directions))
    if not ratios:
        return out
    asked = name.isin(list(ratios))
    ranks = sampling.ranked(out.where(asked), F.col("id"), seed, ["src_lang", "trg_lang"])
    table = F.create_map(*(F.lit(x) for kv in ratios.items() for x in (kv[0], float(kv[1]))))
    ratio = F.element_at(table, F.concat_ws("2", "row.src_lang", "row.trg_lang"))
    copies = F.floor(ratio) + F.when(F.col("rank") <= F.floor(F.col("total") * F.round(ratio - F.floor(ratio), 12)), 1).otherwise(0)
    return out.where(~asked).unionByName(sampling.repeated(ranks, copies).drop("copy"))


def write_sides(rows: DataFrame, folder: str, order: str, names: tuple[str, str] = ("src", "trg")) -> None:
    """Two folders of line files with one order: the n-th part of each holds the same rows, parts follow by name."""
    one = settled(rows.select(F.col(order).alias("o"), "src", "trg").orderBy("o"))
    for column, name in zip(("src", "trg"), names):
        one.select(F.col(column).alias("value")).write.mode("overwrite").text(f"{folder}/{name}")


def write_languages(rows: DataFrame, folder: str) -> None:
    """(lang, text) as line files, a subfolder lang=.. for each language."""
    rows.select("lang", F.col("text").alias("value")).write.mode("overwrite").partitionBy("lang").text(folder)


def write_hypotheses(log: DataFrame, references: DataFrame, folder: str, rank: int = 0) -> None:
    """Files hyp and ref of a decoder log (line_type, id, text and ``at``, its order) and (id, ref), a line an id that has both, by id."""
    hyp = ranked_hypotheses(log, "at", rank).select("id", F.col("text").alias("src"))
    write_sides(hyp.join(references.select("id", F.col("ref").alias("trg")), "id"), folder, "id", ("hyp", "ref"))


def with_eos(ids: Column, eos: int, longest: int) -> Column:
    """At most ``longest`` ids, the last one ``eos``."""
    bare = F.when(F.element_at(ids, -1) == eos, F.slice(ids, F.lit(1), F.size(ids) - 1)).otherwise(ids)
    return F.concat(F.slice(bare, 1, longest - 1), F.array(F.lit(eos).cast("bigint")))


def with_language_id(ids: Column, language: int) -> Column:
    """The ids with the number of their language's token behind them."""
    return F.concat(ids, F.array(F.lit(language).cast("bigint")))


def with_prefix(rows: DataFrame, prefix: int | None) -> DataFrame:
    """Every row with the ids that decoding starts from: one, or none."""
    return rows.withColumn("prefix", F.array(F.lit(prefix).cast("bigint")) if prefix is not None else F.array().cast("array<bigint>"))


def fits(rows: DataFrame, column: str, most: int) -> DataFrame:
    return rows.where(F.size(column) <= most)
