"""A bitmap of fixed size that keeps rows which surely don't match out of a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.textblocks import give_back

FILTER_BITS = 26


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for each value of the long column ``key``, by its lowest bits; 8 MB whatever the input."""
    h = keys.select((F.col("key").bitwiseAND((1 << FILTER_BITS) - 1) + 1).alias("h"))
    parts = h.groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in parts:  # at most 2048 rows of 4096 bytes
        start = (r.bucket - 1) * 4096
        out[start : start + 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def maybe_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys.view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 == 1


def only_maybe(df: DataFrame, column: str, bits: np.ndarray, inside: bool = True) -> DataFrame:
    """Rows whose key may be (or surely isn't) in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(maybe_in(bits, b.column(column).to_numpy()) == inside))
        give_back()

    return df.mapInArrow(run, df.schema)
