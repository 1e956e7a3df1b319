"""Words of many texts at once, as numpy arrays over the Arrow buffers.

Texts are UTF-8 bytes. A word is a maximal run of bytes that a 256-entry table maps to non-zero; the table also
lower-cases A-Z. Work goes in slices of a few MB, so that memory doesn't depend on the batch or on the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE = 4 << 20
#: Words of at least so many bytes are hashed by blake2b.
LONG_WORD = 1 << 16
BLOCK = 1 << 20


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def whitespace_words() -> np.ndarray:
    """Separators are 0x20 and 0x09-0x0D."""
    table = _lower()
    table[[0x20, *range(0x09, 0x0E)]] = 0
    table[0] = 1  # a NUL byte belongs to a word
    return table


def alnum_words() -> np.ndarray:
    """Words are runs of ASCII letters, digits and all that isn't ASCII."""
    table = _lower()
    for c in range(128):
        if not chr(c).isalnum():
            table[c] = 0
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BASE = 0x9E3779B97F4A7C15
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, up to n."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        row = np.full(n + 1, base, dtype=np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a binary column, cut at rows into about SLICE bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text and their total): no word reaches over two texts."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = table[data] != 0
    first = np.empty(len(data), dtype=bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    edges = offsets[:-1]
    first[edges[edges < len(data)]] = True
    last = np.empty(len(data), dtype=bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    ends = offsets[1:] - 1
    last[ends[ends >= 0]] = True
    starts = np.flatnonzero(inside & first)
    return starts, np.flatnonzero(inside & last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    up, down = power_tables(min(len(data), BLOCK + LONG_WORD))
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + BLOCK, side="right"))
        long = np.flatnonzero(ends[i:j] - starts[i:j] >= LONG_WORD) if j > i else np.zeros(1, dtype=np.int64)
        if len(long) and long[0] == 0:
            word = table[data[starts[i] : ends[i]]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            i += 1
            continue
        if len(long):
            j = i + int(long[0])
        at, block = starts[i], table[data[starts[i] : ends[j - 1]]]
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODES[block] * up[: len(block)], out=sums[1:])
        a, b = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def hash_words(column: pa.Array, table: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each text and their total) by slices."""
    for row, end, data, offsets in slices(column):
        starts, ends, bounds = words(data, offsets, table)
        yield row, end, word_hashes(data, starts, ends, table), bounds


def hash_text(word: str | bytes, table: np.ndarray) -> np.ndarray:
    """The hashes of one text's words."""
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, dtype=np.uint8)
    starts, ends, _ = words(raw, np.array([0, len(raw)]), table)
    return word_hashes(raw, starts, ends, table)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position on, for positions that have as many after them."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + hashes[k : k + m]
    return mix(out + np.uint64(n))


def long_lists(rows: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    """A list column of numpy arrays."""
    bounds = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=bounds[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    if flat.dtype == np.uint64:
        flat = flat.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat).cast(kind))
