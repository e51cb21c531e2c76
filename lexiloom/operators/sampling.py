"""Reproducible sampling, balancing, shuffling and sharding.

Draws are hashes of (seed, row key), so they don't depend on partitions or
order and can be checked in SQL.  Exact sample sizes rank rows by their hash; a
single unpartitioned rank would put all rows in one task, so rows are first
ranked within hash ranges and the ranges' counts are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.sources.corpus import hashed, settled

#: Hexadecimal digits of the hash that name its range: 65,536 ranges of each group.
DIGITS = 4


def ranked(rows: DataFrame, key: Column, seed: str, by: list[str] | None = None) -> DataFrame:
    """(row, rank, total): ``rows`` as a struct, from 1 by hash in each group, and the group's size, without a task that holds a group."""
    groups = {f"g{i}": F.col(f"`{c}`") for i, c in enumerate(by or [])}
    inner = rows.select(F.struct("*").alias("row"), hashed(seed, key).alias("h"), key.alias("k"), *(c.alias(n) for n, c in groups.items()))
    return _numbered(inner.withColumn("part", F.substring("h", 1, DIGITS)), list(groups), "part", ["h", "k"]).select("row", "rank", "total")


def _numbered(rows: DataFrame, by: list[str], part: str, order: list[str]) -> DataFrame:
    """``rows`` with rank and total in each group of ``by``, ordered by (part, order): ranks within a part, and the parts' counts added up."""
    counts = rows.groupBy(*by, part).agg(F.count("*").alias("n"))
    w = W.partitionBy(*by).orderBy(part) if by else W.orderBy(part)
    all_ = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    bases = counts.select(*by, part, (F.sum("n").over(w) - F.col("n")).alias("base"), F.sum("n").over(all_).alias("total"))
    within = F.row_number().over(W.partitionBy(*by, part).orderBy(*order))
    return rows.withColumn("rank", within).join(bases, [*by, part]).withColumn("rank", F.col("rank") + F.col("base")).drop("base")


def down_sample(rows: DataFrame, key: Column, ratio: float, seed: str = "1", by: list[str] | None = None) -> DataFrame:
    """floor(n * ratio) rows of each group, without replacement."""
    return ranked(rows, key, seed, by).where(F.col("rank") <= F.floor(F.col("total") * F.lit(ratio))).select("row.*")


def up_sample(rows: DataFrame, key: Column, ratio: float, seed: str = "1", by: list[str] | None = None) -> DataFrame:
    """Each row int(ratio) times and floor(n * fraction) rows once more; ``copy`` counts from 1 and replaces a column of that name."""
    whole = int(ratio)
    copies = F.lit(whole) + F.when(F.col("rank") <= F.floor(F.col("total") * F.lit(round(ratio - whole, 12))), 1).otherwise(0)
    return repeated(ranked(rows, key, seed, by), copies)


def repeated(ranks: DataFrame, copies: Column) -> DataFrame:
    """The rows of ``ranked``, each ``copies`` times; ``copy`` counts from 1."""
    names = [c for c in ranks.schema["row"].dataType.names if c != "copy"]
    copy = F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy")
    return ranks.where(copies > 0).select(*(F.col(f"row.`{c}`") for c in names), copy)


def balance(rows: DataFrame, key: Column, group: str, seed: str = "1") -> DataFrame:
    """Every group repeated up to the size of the largest: whole copies and a sample for the rest."""
    most = rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    out = ranked(rows, key, seed, [group]).join(F.broadcast(most))  # one row
    copies = F.floor(F.col("most") / F.col("total")) + F.when(F.col("rank") <= F.col("most") % F.col("total"), 1).otherwise(0)
    return repeated(out, copies)


def shuffled(rows: DataFrame, key: Column, seed: str = "1") -> DataFrame:
    """Rows with their place in a reproducible permutation; ``place`` replaces a column of that name."""
    names = [c for c in rows.columns if c != "place"]
    return ranked(rows, key, seed).select(*(F.col(f"row.`{c}`") for c in names), F.col("rank").cast("bigint").alias("place"))


def head_fraction(rows: DataFrame, order: str, percent: float) -> DataFrame:
    """The first ``percent`` of the rows by ``order``; ranges of the order are counted, so no task holds more than its own."""
    ranges = settled(rows.repartitionByRange(order).select(F.struct("*").alias("row"), F.col(order).alias("k"), F.spark_partition_id().alias("part")))
    return _numbered(ranges, [], "part", ["k"]).where(F.col("rank") <= F.floor(F.col("total") * F.lit(percent) / 100)).select("row.*")


def ranked_by(rows: DataFrame, order: str, key: str, width: int = 4096) -> DataFrame:
    """(row, rank, total) by (order, key), where ``key`` is a whole number: parts are a value of ``order`` and ``width`` values of the key."""
    inner = rows.select(F.struct("*").alias("row"), F.col(order).alias("o"), F.col(key).alias("k")).withColumn("bucket", F.floor(F.col("k") / width))
    values = inner.groupBy("o").agg(F.count("*").alias("n"))
    before = values.select("o", F.coalesce(F.sum("n").over(W.orderBy("o").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy(F.lit(1))).alias("all"))
    return _numbered(inner, ["o"], "bucket", ["k"]).join(before, "o").select("row", (F.col("rank") + F.col("before")).alias("rank"), F.col("all").alias("total"))


def shard(rows: DataFrame, key: Column, shards: int, epoch: int) -> DataFrame:
    """The shard that an epoch reads, round robin."""
    return rows.where(F.pmod(key, F.lit(shards)) == (epoch - 1) % shards)


def repeat_primary(rows: DataFrame, is_primary: Column, times: int) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(is_primary, times).otherwise(1))))
