"""Connected components: contraction rounds, then one bounded task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.scratch import materialize

#: Edges (16 bytes each) that a single task finishes; larger graphs are contracted first.
LOCAL_EDGES = 1_000_000


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    ids = list(parent)
    yield pa.record_batch({"id": pa.array(ids, pa.int64()), "component": pa.array([root(x) for x in ids], pa.int64())})


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (a long, b long); component is the smallest id reachable.

    While more than ``local_edges`` edges are left, every vertex points at the
    smallest vertex among itself and its neighbours, and the edges between
    different targets are contracted, which at least halves the vertices that
    still have an edge.  Each round's tables are written to the shared folder.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    rounds = []
    while left.count() > local_edges:
        hops = materialize(both(left).groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("to")), "hops")
        rounds.append(hops)
        a, b = hops.select(F.col("id").alias("a"), F.col("to").alias("ta")), hops.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        moved = left.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        left = materialize(moved.distinct(), "edges")
    out = materialize(left.coalesce(1).mapInArrow(_finish, "id long, component long"), "labels")
    for hops in reversed(rounds):
        later = out.select(F.col("id").alias("to"), "component")
        out = hops.join(later, "to", "left").select("id", F.coalesce("component", "to").alias("component"))
        # a target that points at itself has no row of its own unless it still had edges
        missing = later.select(F.col("to").alias("id"), "component").join(hops.select("id"), "id", "left_anti")
        out = materialize(out.unionByName(missing), "labels")
    return out
