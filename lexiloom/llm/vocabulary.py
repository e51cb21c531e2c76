"""Encoding whole texts with a public tokenizer file, one distinct chunk at a time.

Natural text repeats its words: a block of documents is cut where the
tokenizer's own splitting can never join, the distinct chunks are encoded once
by the tokenizers library, and each document's ids are gathered from them.  The
ids equal those of encoding every text as a whole.
"""

from __future__ import annotations

import gc
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexiloom.llm.textblocks import ascii_lower, buffer_of, encoded, gather, give_back, pretoken_chunks, slices

#: Chunks that need neither normalising nor splitting, with and without blanks and capitals.
_SIMPLE_KEEPING = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_SIMPLE_FOLDED = "^[a-zß-öø-ÿ]+$"
_loaded: dict[tuple[int, bool], "ChunkEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: visible Latin-1 signs stand for themselves, the others count up from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()
_BLANK = _BYTE_LETTERS[32]


def read_vocabulary(path: str) -> str:
    """The tokenizer file's text, read on the driver and shipped with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class ChunkEncoder:
    """Ids of whole documents; ``keeps_blanks`` tells whether blanks reach the ids.

    A tokenizer that drops blanks also folds case here, so that both spellings
    of a word are one chunk.
    """

    def __init__(self, spec: str, keeps_blanks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.keeps_blanks = keeps_blanks
        self.simple = _SIMPLE_KEEPING if keeps_blanks else _SIMPLE_FOLDED

    def distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the chunks, one after the other.

        A chunk of Latin letters that normalising leaves as it is and that the
        splitting pattern takes whole goes to the tokenizer's model at once.
        """
        counts, ids = [], []
        tokens, pipeline = self.tokenizer.model.tokenize, self.tokenizer.encode_batch_fast
        for i in range(0, len(chunks), 8192):
            part = chunks.slice(i, 8192)
            simple = pc.match_substring_regex(part, self.simple)
            rest = iter(pipeline(part.filter(pc.invert(simple)).to_pylist(), add_special_tokens=False))
            got = [
                [t.id for t in tokens(c.replace(" ", _BLANK) if c.isascii() else c.encode().decode("latin-1").translate(_BYTE_LETTERS))] if s else next(rest).ids
                for c, s in zip(part.to_pylist(), simple.to_pylist())
            ]
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32, int(counts[-1].sum())))
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): document i has ids[offsets[i] : offsets[i + 1]]."""
        gc.disable()  # millions of short-lived lists without a cycle
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, off = buffer_of(texts)
        if not self.keeps_blanks:
            data = ascii_lower(data)
        starts, ends, first = pretoken_chunks(data, off, self.keeps_blanks)
        if not self.keeps_blanks:
            data = gather(data, starts, ends - starts)
        codes, values = encoded(slices(data, np.concatenate([[0], np.cumsum(ends - starts)])))
        flat, size = self.distinct(values)
        at = np.cumsum(size) - size
        counts = size[codes]
        total = np.concatenate([[0], np.cumsum(counts)])
        return gather(flat, at[codes], counts), total[first]


def encoder(spec: str, keeps_blanks: bool) -> ChunkEncoder:
    """One encoder for each worker process and tokenizer."""
    key = hash(spec), keeps_blanks
    if key not in _loaded:
        _loaded[key] = ChunkEncoder(spec, keeps_blanks)
    return _loaded[key]


def unload() -> None:
    """Drop this worker's encoders; the next task loads its own."""
    _loaded.clear()
    give_back()
