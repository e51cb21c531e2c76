"""Approximate nearest neighbours by multi-index hashing.

Unit vectors become 64-bit codes: principal directions of a bounded sample,
turned by the rotation that brings the sample closest to the corners of a cube
(iterative quantization), and the signs.  A cell cuts the codes into m
substrings, about two bits shorter than the logarithm of its rows, and indexes
each.  By the pigeonhole principle a code within distance r = s m + a of the
query's agrees with it up to s bits in one of the substrings 0 .. a at least or
up to s - 1 bits in one of the others.  So the radius grows by one bit a step:
step r probes substring r mod m with all values at distance r div m, after
which every code within r has been retrieved.  It stops at the first radius
that holds ``SHARE`` of the cell's rows and no fewer than ``candidates``; no
code is compared that a probe did not retrieve.  All codes within the radius
are then ranked by cosine in double precision.

See ``vector_cells`` for rows that take no part; zero vectors don't either.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from lexiloom.llm import vector_cells
from lexiloom.llm.vector_cells import best, sampled, search, vectors

BITS = 64
CANDIDATES = 512
#: Part of a cell's rows that is reranked, if that is more than ``CANDIDATES``.
SHARE = 0.1


def learn_rotation(sample: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix): codes are the signs of (x - mean) @ matrix, for unit vectors x."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = x.mean(0)
    x = x - mean
    _, _, directions = np.linalg.svd(x, full_matrices=False)
    random = np.random.Generator(np.random.PCG64(5))
    projection = directions[:BITS].T
    if projection.shape[1] < BITS:  # fewer dimensions than bits: further random directions
        projection = np.concatenate([projection, random.normal(0, 1, (x.shape[1], BITS - projection.shape[1])) / np.sqrt(x.shape[1])], 1)
    turned = x @ projection
    rotation = np.linalg.qr(random.normal(0, 1, (BITS, BITS)))[0]
    for _ in range(rounds):
        corners = np.where(turned @ rotation >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(corners.T @ turned)
        rotation = (u @ w).T
    return mean, projection @ rotation


def codes(v: np.ndarray, mean: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    return np.packbits((x - mean) @ matrix >= 0, axis=1, bitorder="little").view("<u8").ravel()


def flips(bits: int, distance: int) -> np.ndarray:
    """All substrings of ``bits`` bits with ``distance`` bits set."""
    if (bits, distance) not in _flips:
        _flips[bits, distance] = np.array([sum(1 << b for b in c) for c in combinations(range(bits), distance)], np.int64)
    return _flips[bits, distance]


_flips: dict[tuple[int, int], np.ndarray] = {}


class MultiIndex:
    """An index of each substring over one cell's codes."""

    def __init__(self, code: np.ndarray):
        self.code = code
        bits = min(16, max(8, len(code).bit_length() - 2))
        cuts = np.linspace(0, BITS, -(-BITS // bits) + 1).astype(int).tolist()
        #: (shift, bits, rows by substring, first row of each substring)
        self.tables: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for low, high in zip(cuts, cuts[1:]):
            part = self.part(code, low, high - low)
            counts = np.bincount(part, minlength=1 << (high - low))
            self.tables.append((low, high - low, np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(counts)])))

    @staticmethod
    def part(code: np.ndarray | np.uint64, shift: int, bits: int):
        return ((code >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def around(self, code: np.uint64, wanted: int) -> tuple[np.ndarray, int]:
        """All rows within the first radius that holds ``wanted`` of them, and how many rows the probes retrieved."""
        seen = np.zeros(len(self.code), bool)
        at_distance = np.zeros(BITS + 1, np.int64)
        found: list[np.ndarray] = []
        distances: list[np.ndarray] = []
        wanted = min(wanted, len(self.code))
        for radius in range(BITS + len(self.tables)):
            s, p = divmod(radius, len(self.tables))
            shift, bits, order, starts = self.tables[p]
            if s <= bits:
                probe = int(self.part(code, shift, bits)) ^ flips(bits, s)
                counts = starts[probe + 1] - starts[probe]
                probe, counts = probe[counts > 0], counts[counts > 0]
                rows = order[np.repeat(starts[probe] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
                rows = rows[~seen[rows]]
                seen[rows] = True
                distance = np.bitwise_count(self.code[rows] ^ code)
                at_distance += np.bincount(distance, minlength=BITS + 1)
                found.append(rows)
                distances.append(distance)
            if at_distance[: radius + 1].sum() >= wanted:
                break
        rows, distance = np.concatenate(found), np.concatenate(distances)
        return np.sort(rows[distance <= radius]), len(rows)


def nearest(table: DataFrame, every: int = 50, top: int = 5, candidates: int = CANDIDATES, share: float = SHARE, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``top`` found neighbours by cosine, ties to smaller vec_id."""
    rows = vectors(table, column, nonzero=True)
    sample = sampled(rows)
    if not len(sample):
        return search(rows, 1, every, top, "double", lambda *_: ([], [], []))
    mean, matrix = learn_rotation(sample)

    def cell(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray):
        index, query_codes = MultiIndex(codes(v, mean, matrix)), codes(q, mean, matrix)
        norms = np.sqrt((v * v).sum(1))
        out = ([], [], [])
        for i, own in enumerate(query_ids):
            rows, _ = index.around(query_codes[i], max(candidates, int(share * len(ids))))
            rows = rows[ids[rows] != own]
            # row-wise sums: equal vectors get equal scores wherever they stand
            score = (v[rows] * q[i]).sum(1) / (norms[rows] * np.sqrt((q[i] * q[i]).sum()))
            b = best(ids[rows], score, top)
            for o, x in zip(out, (np.full(len(b), own), ids[rows][b], score[b])):
                o.append(x)
        return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)

    return search(rows, sample.shape[1], every, top, "double", cell, shard_rows=4 * vector_cells.SHARD_ROWS)
