"""Words of whole texts by their bytes, as Arrow arrays, without a Python string a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from phasegrid.llm.common import binary_buffer

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
WORD, SPACE, BREAK = 0, 1, 2


def byte_kinds(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    """Kind of each byte: part of a word, between words, or between pieces of text."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(spaces)] = SPACE
    kinds[list(breaks)] = BREAK
    return kinds


def words_of(texts: pa.Array, kinds: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Words with A-Z in lower case, flat; the row of each, and its piece.

    Pieces are numbered over all texts, so words next to each other share a number
    exactly if they are in one piece of one text.  Null texts have no words.
    """
    raw, offsets = binary_buffer(texts)
    kind = kinds[raw]
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = kind == WORD
    edge = np.zeros(len(raw) + 1, bool)         # a text starts here
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:]
    start = np.flatnonzero(first)
    last = inside[:-1] & (~inside[1:] | edge[1:])
    stop = np.flatnonzero(last) + 1
    if not len(start):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # words and the gaps between them in turn, of which every other one is taken
    cuts = np.column_stack([start, stop]).ravel().astype(np.int32)
    both = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(_LOWER[raw]))
    words = both.take(pa.array(np.arange(0, len(cuts) - 1, 2)))
    row = np.searchsorted(offsets, start, "right") - 1
    piece = np.cumsum(kind == BREAK)[start] + row
    return words, row, piece


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))
