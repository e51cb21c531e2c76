"""Exact top-k inner products over norm-sorted vectors.

Components become whole numbers, floor(256 * x).  A cell goes through its
vectors by descending length in chunks.  Queries and vectors are turned by the
right singular vectors of a bounded sample, so that the first coordinates hold
most of the length; by Cauchy-Schwarz the product is at most the sum over the
first coordinates plus the product of the lengths of the rests.  The sum grows
over ``HEADS`` coordinates in turn, and at each of them the pairs whose bound is
below the query's k-th best score are dropped; those left at the end get their
exact integer product, and a query stops where its length times the
chunk's largest length can't reach its k-th best.  Bounds carry a slack for
rounding, so the result is exact.

See ``vector_cells`` for rows that take no part.  Components should stay below
2^17 in size, so that sums of products fit a long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lexiloom.llm.vector_cells import best, sampled, search, vectors

HEADS = (16, 32, 48)
CHUNK = 256


def whole(v: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * v).astype(np.int64)


def top_products(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, turn: np.ndarray, top: int, heads: tuple[int, ...] = HEADS, chunk: int = CHUNK):
    """(query id, id, score) of the ``top`` highest products of each query with vectors of another id."""
    length = np.sqrt((v.astype(float) ** 2).sum(1))
    order = np.lexsort((ids, -length))
    ids, v, length = ids[order], v[order], length[order]
    tv, tq = v @ turn, q @ turn
    heads = [h for h in heads if h < q.shape[1]] or [q.shape[1]]
    rests = lambda x: [np.sqrt((x[:, h:] ** 2).sum(1)) for h in heads]
    rest_v, rest_q, length_q = rests(tv), rests(tq), np.sqrt((q.astype(float) ** 2).sum(1))
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    least = np.full(len(q), -np.inf)
    for a in range(0, len(v), chunk):
        b = min(a + chunk, len(v))
        slack = 1e-9 * length_q * length[a] + 1e-6
        open_ = np.flatnonzero(length_q * length[a] + slack >= least)
        if not len(open_):
            break
        sums = tq[open_, : heads[0]] @ tv[a:b, : heads[0]].T
        i, j = np.nonzero(sums + rest_q[0][open_][:, None] * rest_v[0][a:b][None, :] + slack[open_][:, None] >= least[open_][:, None])
        partial, i, j = sums[i, j], open_[i], a + j
        for h, (low, high) in enumerate(zip(heads, heads[1:]), 1):
            partial = partial + (tq[i, low:high] * tv[j, low:high]).sum(1)
            near = partial + rest_q[h][i] * rest_v[h][j] + slack[i] >= least[i]
            partial, i, j = partial[near], i[near], j[near]
        other = ids[j] != query_ids[i]
        i, j = i[other], j[other]
        score = (q[i] * v[j]).sum(1)
        cut = np.searchsorted(i, np.arange(len(q) + 1))
        for k in np.unique(i):
            part = slice(cut[k], cut[k + 1])
            all_ids, all_scores = np.concatenate([found[k][0], ids[j[part]]]), np.concatenate([found[k][1], score[part]])
            keep = best(all_ids, all_scores, top)
            found[k] = all_ids[keep], all_scores[keep]
            if len(keep) == top:
                least[k] = found[k][1][-1]
    sizes = [len(f[0]) for f in found]
    return np.repeat(query_ids, sizes), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def top_inner_products(table: DataFrame, every: int = 50, top: int = 5, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``top`` highest integer inner products, ties to smaller vec_id."""
    rows = vectors(table, column)
    sample = sampled(rows)
    if not len(sample):
        return search(rows, 1, every, top, "long", lambda *_: ([], [], []))
    # the right singular vectors, by descending singular value, from the small square matrix
    x = whole(sample).astype(float)
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]

    def cell(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray):
        return top_products(query_ids, whole(q), ids, whole(v), turn, top)

    return search(rows, sample.shape[1], every, top, "long", cell)
