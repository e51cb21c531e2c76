"""Toxicity by a factorization machine over hashed terms.

Terms of a document are its distinct lower-cased words and the first four and
five bytes of longer words, as 64-bit hashes.  The score is the logistic of

    w0 + sum of w_i + 1/2 * sum over f of ((sum of v_if)^2 - sum of v_if^2)

over the terms that the model kept, so that two terms together can say more
than their weights add up to.  It is learned on the driver by AdaGrad with a
soft threshold on the weights, from a bounded sample of labelled documents
(``sample`` rows, those with the smallest hashed doc_id); all documents are then
scored in place, without a shuffle.  A null text counts as empty; an empty text
gets the bias.  Without labels of both kinds every score is the share of
toxic labels (0 without labels).  Columns besides doc_id and text are ignored;
repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.rolling import Slices
from lexiloom.llm.scratch import small_batches
from lexiloom.llm.textblocks import ascii_lower, blocks, buffer_of

SAMPLE = 12_000
THRESHOLD = 0.7
BLOCK = 1 << 20
#: Bytes of words: letters, digits and all bytes of longer characters.
_INNER = np.zeros(256, bool)
_INNER[128:] = True
_INNER[[*range(48, 58), *range(97, 123)]] = True
_FILTER_BITS = 22


@dataclass
class Model:
    terms: np.ndarray  # sorted 64-bit hashes
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def __post_init__(self):
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.terms >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def scores(self, terms: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Scores of n documents whose terms (repeats allowed) are given with their row."""
        some = self.maybe[(terms >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        terms, rows = terms[some], rows[some]
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        hit = self.terms[at] == terms if len(self.terms) else np.zeros(0, bool)
        pairs = np.unique(rows[hit].astype(np.int64) * max(1, len(self.terms)) + at[hit])
        row, col = np.divmod(pairs, max(1, len(self.terms)))
        return logistic(margins(row, col, n, self.weights, self.factors, self.bias)[0])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def margins(row: np.ndarray, col: np.ndarray, n: int, w: np.ndarray, v: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Margins and, for each row, the factor sums."""
    out = np.bincount(row, w[col], n) + bias
    sums = np.stack([np.bincount(row, v[col, f], n) for f in range(v.shape[1])], 1)
    squares = np.bincount(row, (v[col] ** 2).sum(1), n)
    return out + 0.5 * ((sums**2).sum(1) - squares), sums


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed terms, row of each), repeats included."""
    data, off = buffer_of(texts)
    data = ascii_lower(data)
    inner = np.zeros(len(data) + 2, bool)
    inner[1:-1] = _INNER[data]
    starts, ends = inner[1:-1] & ~inner[:-2], inner[1:-1] & ~inner[2:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] |= inner[1:-1][cuts]
    ends[cuts - 1] |= inner[1:-1][cuts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    rows = np.searchsorted(off, s, side="right") - 1
    h = Slices(data)
    found, at = [h.hash(s, e)], [rows]
    for n in (4, 5):
        long = e - s > n
        found.append(h.hash(s[long], s[long] + n) ^ np.uint64(0x5BF0_3635_AA55_0000 + n))
        at.append(rows[long])
    return np.concatenate(found), np.concatenate(at)


def train(flat: np.ndarray, off: np.ndarray, y: np.ndarray, factors: int = 4, epochs: int = 30, rate: float = 0.2, soft: float = 2e-4, least: int = 5, least_steps: int = 3000, significant: float = 20.0) -> Model:
    """Fit on documents given as distinct terms: document i has flat[off[i] : off[i + 1]].

    Terms in fewer than ``least`` documents, or whose chi-square statistic with
    the label is below ``significant``, are left out: prose has tens of
    thousands of words that say nothing about the label.
    """
    n = len(y)
    share = float(y.mean()) if n else 0.0
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, factors)), float(np.log(share + 1e-9) - np.log(1 - share + 1e-9)))
    if n == 0 or y.min() == y.max() or not len(flat):
        return none
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
    order = np.argsort(flat)
    terms = flat[order]
    start = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    terms = terms[start]
    positive = np.add.reduceat(y.astype(np.int32)[owner[order]], start)
    del order
    counts = np.diff(np.append(start, len(flat)))
    expected = counts * share
    chi = (positive - expected) ** 2 / (expected * (1 - share) * np.maximum(1 - counts / n, 1 / n))
    terms = terms[(counts >= least) & (chi >= significant)]
    if not len(terms):
        return none
    at = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
    keep = terms[at] == flat
    col, owner = at[keep], owner[keep]
    del at, keep
    first = np.searchsorted(owner, np.arange(n + 1))
    random = np.random.Generator(np.random.PCG64(7))
    w, v = np.zeros(len(terms)), random.normal(0, 0.01, (len(terms), factors))
    bias = float(np.log(y.mean() / (1 - y.mean())))
    gw, gv, gb = np.full(len(terms), 1e-3), np.full(v.shape, 1e-3), 1e-3
    for _ in range(max(epochs, least_steps * 256 // n)):
        order = random.permutation(n)
        for start in range(0, n, 256):
            part = order[start : start + 256]
            sizes = first[part + 1] - first[part]
            idx = np.repeat(first[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            r, c = np.repeat(np.arange(len(part)), sizes), col[idx]
            m, sums = margins(r, c, len(part), w, v, bias)
            error = (logistic(m) - y[part]) / len(part)
            used, where = np.unique(c, return_inverse=True)
            g = np.bincount(where, error[r], len(used))
            e2 = error[r][:, None] * (sums[r] - v[c])
            g2 = np.stack([np.bincount(where, e2[:, f], len(used)) for f in range(factors)], 1) + 1e-5 * v[used]
            gw[used] += g * g
            gv[used] += g2 * g2
            step = rate / np.sqrt(gw[used])
            moved = w[used] - step * g
            w[used] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * soft)
            v[used] -= 0.2 * rate / np.sqrt(gv[used]) * g2
            gb += error.sum() ** 2
            bias -= 0.1 * rate / np.sqrt(gb) * error.sum()
    kept = (w != 0) | (np.abs(v).max(1) > 0.01)
    return Model(terms[kept], w[kept], v[kept], bias)


def held_out(doc_id=None):
    """True for rows whose labels are never learned from."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled rows that aren't held out, those with the smallest hashed doc_id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample).dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    small_batches(docs.sparkSession)
    chosen = labelled_sample(labels, label, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            terms, rows = terms_of(b.column("text"))
            order = np.argsort(rows, kind="stable")
            terms, first = terms[order], np.searchsorted(rows[order], np.arange(b.num_rows + 1))
            found = [np.unique(terms[i:j]).tobytes() for i, j in zip(first, first[1:])]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "y": b.column("y"), "terms": pa.array(found, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most ``sample`` rows of 12 bytes are broadcast
    got = rows.join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, y int, terms binary").toArrow().sort_by("doc_id")
    y = np.array(got.column("y").to_pylist(), np.float64)
    data, off = buffer_of(got.column("terms").cast(pa.large_binary()))
    del got
    return train(np.ascontiguousarray(data).view(np.uint64), off // 8, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            terms, rows = terms_of(b.column("text"))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": model.scores(terms, rows, b.num_rows)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())
    scored = rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            terms, rows = terms_of(b.column("text"))
            yield b.filter(pa.array(model.scores(terms, rows, b.num_rows) < threshold))

    return docs.mapInArrow(run, docs.schema)
