"""A query set against all vectors, in cells of bounded size.

Vectors are dealt into shards of about ``SHARD_ROWS`` rows by a hash of their
id, queries into blocks of about ``QUERY_ROWS``; every pair of a shard and a
block is a cell that one task searches, and each cell returns the best few of
each of its queries, so no row of the result stands for a mere candidate.

Vectors that are null, empty, or hold null or non-finite components take no
part, nor do rows without a vec_id or with another length than most sampled
vectors.  Rows that repeat a vec_id are candidates each; none of them is found
for a query of the same vec_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.sources.corpus import ship

SHARD_ROWS = 8192
QUERY_ROWS = 8192
SAMPLE = 8192


def vectors(table: DataFrame, column: str = "embedding", nonzero: bool = False) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    ship(table.sparkSession)
    v = F.col(column).cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def sampled(rows: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """At most ``sample`` vectors of the most common length, those with the smallest hashed id: a bounded sample to learn a rotation from."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow().column("v").to_pylist()
    if not got:
        return np.zeros((0, 0))
    sizes = np.bincount([len(v) for v in got])
    return np.array([v for v in got if len(v) == sizes.argmax()])


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def search(rows: DataFrame, dimensions: int, every: int, top: int, score_type: str, cell_search: Search, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` best of every vector whose id is divisible by ``every``.

    ``cell_search(query ids, queries, ids, vectors)`` returns (query id, id,
    score) rows, at most ``top`` for each query, with its own id left out.
    ``shard_rows`` replaces ``SHARD_ROWS``.
    """
    rows = rows.where(F.size("v") == dimensions)
    queries = rows.where(F.col("vec_id") % every == 0)
    n = rows.count()
    shards, blocks = max(1, -(-n // (shard_rows or SHARD_ROWS))), max(1, -(-n // every // QUERY_ROWS))
    dealt = lambda c, k, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(k))
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = queries.select("vec_id", "v", dealt("vec_id", blocks, 1).alias("block"), each(shards).alias("shard")).select((F.col("shard") * blocks + F.col("block")).alias("cell"), F.lit(True).alias("asks"), "vec_id", "v")
    right = rows.select("vec_id", "v", dealt("vec_id", shards, 2).alias("shard"), each(blocks).alias("block")).select((F.col("shard") * blocks + F.col("block")).alias("cell"), F.lit(False).alias("asks"), "vec_id", "v")
    both = left.unionByName(right).repartition("cell").sortWithinPartitions("cell")
    kind = pa.int64() if score_type == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches):
            asks = np.asarray(cell.column("asks").to_numpy(zero_copy_only=False), bool)
            ids = cell.column("vec_id").to_numpy()
            v = cell.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), dimensions)
            if asks.any() and not asks.all():
                q, i, s = cell_search(ids[asks], v[asks], ids[~asks], v[~asks])
                yield pa.record_batch({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, kind)})

    found = both.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table for each cell; input is sorted by cell."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        while b.num_rows:
            cell = b.column("cell").to_numpy()
            if held and held[0].column("cell")[0].as_py() != cell[0]:
                yield pa.Table.from_batches(held)
                held = []
            cut = int(np.searchsorted(cell, cell[0], side="right"))
            held.append(b.slice(0, cut))
            b = b.slice(cut)
    if held:
        yield pa.Table.from_batches(held)


def best(ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the highest scores, ties to smaller ids."""
    if len(scores) > 4 * top:
        least = np.partition(scores, len(scores) - top)[len(scores) - top]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:top]]
