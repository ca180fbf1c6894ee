"""Words, lines and shingles of Arrow string batches as 64-bit fingerprints, computed on the byte buffers.

Words are runs of bytes other than the six ASCII blanks; A-Z count as a-z. Equal words have equal fingerprints on every
machine. Two different words meet with a probability of about 2^-64; the operators that call this work on such
fingerprints throughout.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
LONG_WORD = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)
PRIME = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (multiply and shift, invertible)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * STEP)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings and the offsets between them; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges of strings that hold about ``most`` bytes together; a longer string is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprint of each byte span."""
    length = end - start
    out = np.zeros(len(start), np.uint64)
    live = np.arange(len(start))
    for i in range(int(min(LONG_WORD, length.max(initial=0)))):
        live = live[length[live] > i]
        out[live] = out[live] * PRIME + BYTE[data[start[live] + i]]
    for i in np.flatnonzero(length > LONG_WORD):
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, np.uint64)[0]
    return mix(out + length.astype(np.uint64) * STEP)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each string (one entry more than strings)."""
    inside = ~BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words in order, and the number of words before each string."""
    data = LOWER[data]
    start, end, before = word_spans(data, offsets)
    return hash_spans(data, start, end), before


def shingle_sets(column: pa.Array, size: int):
    """Per string: the sorted distinct fingerprints of its ``size``-word shingles.

    A string of fewer words has its whole sequence as one; without words the set is empty.
    """
    data, offsets = utf8(column)
    odd = mix((2 * np.arange(size, dtype=np.uint64) + np.uint64(3)) * STEP) | np.uint64(1)
    for at, to in slices(offsets):
        part = offsets[at : to + 1]
        h, before = word_hashes(data[part[0] : part[-1]], part - part[0])
        rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for i in range(size):
            rolled += h[i : len(h) - size + 1 + i] * odd[i] if len(rolled) else rolled
        rolled = mix(rolled)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                short = np.append(h[a:b] * odd[: b - a], np.array([b - a], np.uint64) * STEP)
                yield mix(np.add.reduce(short, keepdims=True))
            else:
                yield np.zeros(0, np.uint64)
