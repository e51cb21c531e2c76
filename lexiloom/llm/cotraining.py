"""Document quality by co-training a text view and a page-metadata view.

Two logistic models see the same documents through different columns.  The text
view reads the content: its words, hashed into ``TERMS`` buckets, and shares
that tell its shape and repetition; how long it is it isn't told.  The metadata
view reads source, lang and n_chars.  Both start from a bounded sample of
labelled documents.  In each round each model names, among all documents
without a label, those of which it is most sure, and the other model learns
from these pseudo-labels too.  After the rounds a held-back part of the sample
calibrates each view (a logistic map of its margin) and weighs the calibrated
margins; the sum scores all documents.

The features of all documents are written once and read again in each round.  A
round keeps the ``PER_ROUND`` surest of each task, then of groups of tasks, so
that only the chosen rows reach the driver; documents with equal features count
once, so a group of copies can't fill a round.  ``sample`` labelled rows, those
with the smallest hashed doc_id, bound what the models start from; labels are
learned only from rows whose crc32(doc_id) mod 3 is not 1.

A null text counts as empty, a null metadata value as a value of its own.
Without labels of both kinds every score is the share of good labels (1 without
labels).  Repeated rows are scored each; rows without a doc_id are scored, but
give no pseudo-label.  Columns besides doc_id, text, source, lang and n_chars
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.rolling import Slices
from lexiloom.llm.scratch import materialize, small_batches
from lexiloom.llm.textblocks import _KIND, blocks, buffer_of, encoded, words
from lexiloom.llm.toxicity import labelled_sample, logistic

SAMPLE = 20_000
ROUNDS = 4
PER_ROUND = 500
SURE = 0.97
#: Groups of tasks whose surest rows come to the driver: 600 bytes for each of ``PER_ROUND`` rows a view and group.
GROUPS = 8
THRESHOLD = 0.5
BLOCK = 1 << 20
TERMS = 128
SHAPES = 13
META_BUCKETS = 64
STEPS = 18
SCHEMA = "doc_id long, text_score double, meta_score double, score double"
FEATURES = "doc_id long, y int, x binary, m binary"


def text_features(texts: pa.Array) -> np.ndarray:
    """One row a text: ``SHAPES`` shares of its words, bytes and lines, and the share of its words in each of ``TERMS`` hashed buckets."""
    data, off = buffer_of(texts)
    n = len(off) - 1
    size = np.diff(off).astype(float)
    s, e, first = words(data, off)
    rows = np.repeat(np.arange(n), np.diff(first))
    count = np.diff(first).astype(float)
    h = Slices(data).hash(s, e)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(rows[mask], minlength=n) / np.maximum(count, 1)

    def again(lag: int) -> np.ndarray:
        same = np.zeros(len(h), bool)
        same[lag:] = (h[lag:] == h[:-lag]) & (rows[lag:] == rows[:-lag])
        return share(same)

    order = np.lexsort((h, rows))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    distinct = np.bincount(rows[order][new], minlength=n) / np.maximum(count, 1)
    kind = _KIND[data]

    def bytes_share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(total[off]) / np.maximum(size, 1)

    last = kind[e - 1] if len(e) else kind[:0]
    mean = (np.bincount(rows, e - s, n)) / np.maximum(count, 1)
    shapes = [
        mean, share(e - s == 1), share(e - s > 12), share(e - s < 4), distinct, again(1), again(2),
        bytes_share(kind == 4), bytes_share(kind == 3), bytes_share(kind == 0), share((last == 4) & (e - s > 1)),
        share((kind[s] == 4) if len(s) else kind[:0] == 4), bytes_share(data == 10),
    ]
    terms = np.bincount(rows * TERMS + (h % np.uint64(TERMS)).astype(np.int64), minlength=n * TERMS).reshape(n, TERMS)
    return np.concatenate([np.stack(shapes, 1), terms / np.maximum(count, 1)[:, None]], 1).astype(np.float32)


def meta_codes(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """One row a document: buckets of source and lang, and the logarithm of n_chars in steps (the last step for null)."""
    half = META_BUCKETS // 2

    def hashed(values: pa.Array, mark: str) -> np.ndarray:
        codes, names = encoded(values.fill_null("\0"))
        buckets = np.array([zlib.crc32(f"{mark}{v}".encode()) % half for v in names.to_pylist()], np.int64)
        return buckets[codes] if len(codes) else np.zeros(0, np.int64)

    long = n_chars.fill_null(0).to_numpy(zero_copy_only=False)
    step = np.minimum(np.frexp(np.maximum(long, 0).astype(float))[1], STEPS - 2)
    step = np.where(n_chars.is_null().to_numpy(zero_copy_only=False), STEPS - 1, step)
    return np.stack([hashed(source, "s"), hashed(lang, "l") + half, step + META_BUCKETS], 1).astype(np.int16)


def meta_features(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), META_BUCKETS + STEPS), np.float32)
    out[np.arange(len(codes))[:, None], codes] = 1
    return out


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps on standardised features and the products of the first ``products`` of them."""

    products: int = 0
    ridge: float = 1.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def widened(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        if self.products:
            i, j = np.triu_indices(min(self.products, z.shape[1]))
            z = np.concatenate([z, z[:, i] * z[:, j] / 8], 1)
        return np.concatenate([np.ones((len(z), 1)), z], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Logistic":
        x = np.asarray(x, float)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self.widened(x)
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], self.ridge)
        penalty[0] = 1e-6
        for _ in range(15):
            p = logistic(z @ self.w)
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """In pieces, as the products take several times the room of ``x``."""
        return np.concatenate([self.widened(x[i : i + 2048]) @ self.w for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0)


@dataclass
class Model:
    text: Logistic | None
    meta: Logistic | None
    calibration: np.ndarray  # rows: text, meta (slope, offset); last: weights and offset of the sum
    prior: float

    def scores(self, x_text: np.ndarray, x_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            flat = np.full(len(x_text), self.prior)
            return flat, flat, flat
        a = self.text.margin(x_text) * self.calibration[0, 0] + self.calibration[0, 1]
        b = self.meta.margin(x_meta) * self.calibration[1, 0] + self.calibration[1, 1]
        return logistic(a), logistic(b), logistic(a * self.calibration[2, 0] + b * self.calibration[2, 1] + self.calibration[2, 2])


#: Of which unlabelled rows each view is most sure: (view, label, text features, metadata features) from the views' models and the numbers wanted of labels 0 and 1.
Surest = Callable[[dict[str, Logistic], tuple[int, int]], list[tuple[str, float, np.ndarray, np.ndarray]]]
VIEWS = ("text", "meta")


def surest_rows(models: dict[str, Logistic], wanted: tuple[int, int], x_text: np.ndarray, x_meta: np.ndarray, sure: float = SURE) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """(view, label, rows, sureness) of the at most ``wanted`` rows that each view is surest of, and at least ``sure``."""
    for view, x in zip(VIEWS, (x_text, x_meta)):
        p = logistic(models[view].margin(x))
        for label, sureness in ((0, 1 - p), (1, p)):
            best = np.argsort(-sureness, kind="stable")[: wanted[label]]
            best = best[sureness[best] >= sure]
            yield view, label, best, sureness[best]


def cotrain(x_text: np.ndarray, x_meta: np.ndarray, y: np.ndarray, surest: Surest, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model:
    """Learn from labelled rows, and from what ``surest`` finds among the others."""
    prior = float(y.mean()) if len(y) else 1.0
    held = np.zeros(len(y), bool)
    held[::4] = True
    if min(len(set(y[held])), len(set(y[~held]))) < 2:
        return Model(None, None, np.zeros((3, 3)), prior)
    given = {"text": [(x_text[~held], y[~held])], "meta": [(x_meta[~held], y[~held])]}
    models: dict[str, Logistic] = {}

    def learn() -> None:
        for v in VIEWS:
            xs, ys = zip(*given[v])
            models[v] = Logistic(SHAPES if v == "text" else 0).fit(np.concatenate(xs), np.concatenate(ys))

    learn()
    wanted = (int(per_round * (1 - prior)) + 1, int(per_round * prior) + 1)
    for _ in range(rounds):
        for view, label, x, m in surest(models, wanted):
            # what one view is sure of the other learns
            given["meta" if view == "text" else "text"].append((m if view == "text" else x, np.full(len(x), float(label))))
        learn()
    calibration = np.zeros((3, 3))
    margins = []
    for k, (v, x) in enumerate(zip(VIEWS, (x_text, x_meta))):
        m = models[v].margin(x[held])
        c = Logistic(ridge=1e-2).fit(m[:, None], y[held])
        calibration[k, :2] = c.w[1] / c.scale[0], c.w[0] - c.w[1] * c.mean[0] / c.scale[0]
        margins.append(m * calibration[k, 0] + calibration[k, 1])
    c = Logistic(ridge=1e-2).fit(np.stack(margins, 1), y[held])
    calibration[2, :2] = c.w[1:] / c.scale
    calibration[2, 2] = c.w[0] - (c.w[1:] * c.mean / c.scale).sum()
    return Model(models["text"], models["meta"], calibration, prior)


def _columns(docs: DataFrame) -> DataFrame:
    """The five columns that the views read; metadata columns that are missing count as null."""
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *((F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


def _features(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    string, long = pa.string(), pa.int64()
    return text_features(b.column("text")), meta_codes(*(b.column(c).cast(t) for c, t in (("source", string), ("lang", string), ("n_chars", long))))


def _packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as fixed-width binary values."""
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _unpacked(column: pa.Array | pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.ascontiguousarray(buffer_of(column)[0]).view(kind).reshape(-1, width)


def _both(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _unpacked(b.column("x"), np.float32, SHAPES + TERMS), meta_features(_unpacked(b.column("m"), np.int16, 3))


def feature_table(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, y (null if not in the sample) and the features of both views, for every row of ``docs``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            x, m = _features(b)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "y": b.column("y"), "x": _packed(x), "m": _packed(m)})

    # at most ``sample`` rows of 12 bytes are broadcast
    rows = _columns(docs).join(F.broadcast(labelled_sample(labels, label, sample)), "doc_id", "left")
    return materialize(rows.mapInArrow(run, FEATURES), "features")


def fit_features(features: DataFrame, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model:
    known = features.where("y is not null").toArrow().sort_by("doc_id")
    x, m = _both(known)
    y = np.array(known.column("y").to_pylist(), float)
    others = features.where("y is null and doc_id is not null").select("doc_id", "x", "m")
    schema = "view string, label int, sureness double, doc_id long, x binary, m binary"

    def surest(models: dict[str, Logistic], wanted: tuple[int, int]) -> list[tuple[str, float, np.ndarray, np.ndarray]]:
        def best_of(parts: list[pa.Table]) -> list[pa.Table]:
            """The surest rows of each view and label, equal features once."""
            out = []
            t = pa.concat_tables(parts).combine_chunks()
            for view in VIEWS:
                for label in (0, 1):
                    of = np.flatnonzero((t.column("view").to_numpy(zero_copy_only=False) == view) & (t.column("label").to_numpy() == label))
                    part = t.take(pa.array(of)).sort_by([("sureness", "descending"), ("doc_id", "ascending")])
                    seen, keep = set(), []
                    for i, key in enumerate(zip(part.column("x").to_pylist(), part.column("m").to_pylist())):
                        if key not in seen and len(keep) < wanted[label]:
                            seen.add(key)
                            keep.append(i)
                    out.append(part.take(pa.array(keep, pa.int64())))
            return out

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.Table] = []
            for b in batches:
                # each batch without its copies, so that the surest rows differ
                first = np.unique(_unpacked(b.column("x"), np.uint32, SHAPES + TERMS), axis=0, return_index=True)[1] if b.num_rows else []
                b = b.take(pa.array(np.sort(first), pa.int64()))
                for view, label, rows, sureness in surest_rows(models, wanted, *_both(b)):
                    t = b.take(pa.array(rows))
                    held.append(pa.table({"view": pa.array([view] * len(rows), pa.string()), "label": pa.array(np.full(len(rows), label), pa.int32()), "sureness": sureness, "doc_id": t.column("doc_id"), "x": t.column("x"), "m": t.column("m")}))
                if len(held) >= 16:
                    held = best_of(held)
            for t in best_of(held) if held else []:
                yield from t.to_batches()

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = []
            for b in batches:
                held.append(pa.Table.from_batches([b]))
                if len(held) >= 16:
                    held = best_of(held)
            for t in best_of(held) if held else []:
                yield from t.to_batches()

        # the surest rows of a task, then of a group of tasks; the driver sees those of the groups
        found = others.mapInArrow(choose, schema).repartition(GROUPS, F.xxhash64("doc_id")).mapInArrow(again, schema).toArrow()
        found = pa.concat_tables(best_of([found]))
        out = []
        for view in VIEWS:
            for label in (0, 1):
                of = np.flatnonzero((found.column("view").to_numpy() == view) & (found.column("label").to_numpy() == label))
                if len(of):
                    out.append((view, float(label), *_both(found.take(pa.array(of)).combine_chunks())))
        return out

    return cotrain(x, m, y, surest, rounds, per_round)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    return fit_features(feature_table(docs, labels, label, sample))


def _scored(rows: DataFrame, model: Model, both: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.scores(*both(b))
            yield pa.record_batch({"doc_id": b.column("doc_id")} | dict(zip(("text_score", "meta_score", "score"), map(pa.array, found))))

    return rows.mapInArrow(run, SCHEMA).withColumn("kept", (F.col("score") >= THRESHOLD).cast("int"))


def fit_and_score(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, the calibrated score of each view and of both, and kept (1 at ``THRESHOLD`` or more) for every row."""
    features = feature_table(docs, labels, label, sample)
    return _scored(features.select("doc_id", "x", "m"), fit_features(features), _both)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns kept; needs the columns of documents."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            x, m = _features(b)
            yield b.filter(pa.array(model.scores(x, meta_features(m))[2] >= threshold))

    return docs.mapInArrow(run, docs.schema)
