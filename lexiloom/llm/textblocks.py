"""Whole-batch text kernels: many documents as one byte buffer with offsets."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 16 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches joined or cut so that ``column`` holds about ``limit`` bytes in each (one row at least).

    Freed memory goes back to the system: the worker outlives the task.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(lengths_of(batch.column(column)))
        first = 0
        while first < batch.num_rows:
            base = int(ends[first - 1]) if first else 0
            last = max(first + (not held), int(np.searchsorted(ends, base + limit - size, side="right")))
            if last > first:
                held.append(batch.slice(first, last - first))
                size += int(ends[last - 1]) - base
                first = last
            if first < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)
    del held
    give_back()


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def give_back() -> None:
    """Return freed heap pages to the system, where the C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lengths_of(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    if not (pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(kind) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if off else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data and len(data) else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(data: np.ndarray, offsets: np.ndarray, text: bool = True) -> pa.Array:
    """Arrow array over consecutive slices of ``data``, without a copy."""
    kind = pa.large_string() if text else pa.large_binary()
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside 0x20 and 0x09-0x0D, and each document's first word (n + 1 values)."""
    inner = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inner[1:-1])
    start = inner[1:-1] & ~inner[:-2]
    end = inner[1:-1] & ~inner[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] |= inner[1:-1][cuts]
    end[cuts - 1] |= inner[1:-1][cuts - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


#: 1 blank, 2 letter, 3 digit, 4 other ASCII; 0 for bytes of longer characters.
_KIND = np.zeros(256, np.uint8)
_KIND[:128] = 4
_KIND[_SPACE] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_KIND[48:58] = 3


def pretoken_chunks(data: np.ndarray, offsets: np.ndarray, keep_blanks: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut text where no match of a byte-pair splitting pattern can span.

    Those patterns take runs of letters, of digits or of other signs, each with
    at most one blank before it, and contractions after an apostrophe.  So a cut
    is safe between two ASCII characters of different kinds unless the left one
    is a blank or an apostrophe; the chunks of a text can be encoded on their
    own.  Returns starts, ends and each document's first chunk (n + 1 values);
    without blanks where ``keep_blanks`` is false.
    """
    kind = _KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    left, right = kind[:-1], kind[1:]
    np.logical_and(left != right, left > 1, out=cut[1:-1])
    cut[1:-1] &= (right > 0) & (data[:-1] != 39)
    if not keep_blanks:
        cut[1:-1] |= (left == 1) != (right == 1)
    cut[offsets[:-1]] = True
    cut[len(data)] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    if not keep_blanks:
        inner = kind[starts] != 1
        starts, ends = starts[inner], ends[inner]
    return starts, ends, np.searchsorted(starts, offsets)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z as a-z; other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of values[starts[i] : starts[i] + counts[i]]."""
    total = int(counts.sum())
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    at += np.arange(total)
    return values[at]


def encoded(chunks: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the values and the distinct values."""
    d = chunks.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary
