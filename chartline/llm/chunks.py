"""Texts cut where no token can span, so that equal stretches are tokenised once in a task.

A chunk begins at a space (or another mark) that stands behind a character that is surely no white space.
Tokenizers whose pattern keeps white space only at the front of a token, or drops it, give the same tokens for
the chunks one after another as for the whole text.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa

from chartline.llm import flat

# The first bytes of two-, three- and four-byte characters among which no white space is.
_LEAD_2 = np.zeros(256, bool)
_LEAD_2[0xC3:0xE0] = True
_LEAD_3 = np.zeros(256, bool)
_LEAD_3[0xE0] = _LEAD_3[0xE4:0xF0] = True

_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = True

# A cache sets its chunks aside when it holds so many, and forgets those set aside before. Longer chunks than these
# characters are never kept.
MOST_CHUNKS = 1 << 17
LONGEST_KEPT = 128


def cuts(data: np.ndarray, offsets: np.ndarray, marks: bytes, points: bytes = b"") -> np.ndarray:
    """Where chunks begin: at every row with bytes, at marks behind a character that is surely no white space, and
    at points behind an ASCII letter or digit.

    A mark that ends a row begins no chunk: it would be a chunk of nothing else.
    """
    mark = np.zeros(256, bool)
    mark[list(marks)] = True
    at = np.flatnonzero(mark[data[3:]]) + 3 if len(data) > 3 else np.empty(0, np.int64)
    b1, b2, b3 = data[at - 1], data[at - 2], data[at - 3]
    tail = (b1 >= 0x80) & (b1 < 0xC0)
    tail_2 = (b2 >= 0x80) & (b2 < 0xC0)
    tail_3 = (b3 >= 0x80) & (b3 < 0xC0)
    sure = ((b1 > 0x20) & (b1 < 0x7F)) | (tail & (_LEAD_2[b2] | (tail_2 & (_LEAD_3[b3] | tail_3))))
    begins = np.zeros(len(data) + 1, bool)
    begins[at[sure]] = True
    if points and len(data):
        point = np.zeros(256, bool)
        point[list(points)] = True
        begins[1:-1] |= point[data[1:]] & _ALNUM[data[:-1]]
    begins[offsets[1:] - 1] = False
    begins[offsets[:-1]] = True
    return np.flatnonzero(begins[:-1])


def byte_letters() -> dict[str, int]:
    """What byte-level vocabularies write for bytes: printable ones stand for themselves, the others for characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def unlike(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(the unlike chunks, which of them each chunk is); data begins with the first chunk."""
    borders = np.append(starts, len(data)).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(data))])
    coded = array.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class ChunkCache:
    """What `made` gives for a list of unlike chunks, kept while there is room."""

    def __init__(self, made: Callable[[list[str]], list[Any]]):
        self.made = made
        self.held: dict[str, Any] = {}
        self.aside: dict[str, Any] = {}

    def entries(self, data: np.ndarray, starts: np.ndarray) -> tuple[list[Any], np.ndarray]:
        """(entries of the unlike chunks, which of them each chunk is); data begins with the first chunk."""
        found, which = unlike(data, starts)
        return self.of(found.to_pylist()), which

    def of(self, unlike: list[str]) -> list[Any]:
        held = self.held
        out = [held.get(chunk, held) for chunk in unlike]  # held itself stands for what is missing
        missing = [k for k, entry in enumerate(out) if entry is held]
        if missing:
            for k in missing:
                out[k] = self.aside.get(unlike[k], held)
            new = [k for k in missing if out[k] is held]
            for k, entry in zip(new, self.made([unlike[k] for k in new]) if new else (), strict=True):
                out[k] = entry
            if len(held) + len(missing) > MOST_CHUNKS:
                self.aside, self.held = held, {}
            self.held.update((unlike[k], out[k]) for k in missing if len(unlike[k]) <= LONGEST_KEPT)
        return out


def gathered(parts: list[bytes], which: np.ndarray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(values of all chunks in order, number of values of each chunk) from the packed values of unlike chunks."""
    pool = np.frombuffer(b"".join(parts), dtype)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(dtype).itemsize
    n = lengths[which]
    return pool[flat.ranges((np.cumsum(lengths) - lengths)[which], n)], n
