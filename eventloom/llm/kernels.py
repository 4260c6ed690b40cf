"""Vectorised text kernels on Arrow buffers: tokenisation and hashing of whole batches in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
GOLD = 0x9E3779B97F4A7C15
BASE = GOLD | 1
#: Bytes of text that are worked on at once; a longer text is cut at word ends, never truncated.
PIECE = 1 << 19

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Everything but letters, digits and bytes of non-ASCII characters.
PUNCT = np.ones(256, bool)
PUNCT[48:58] = PUNCT[65:91] = PUNCT[97:123] = PUNCT[128:] = False
RAW = np.arange(1, 257, dtype=np.uint64)
LOWER = RAW.copy()
LOWER[65:91] = RAW[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    with np.errstate(over="ignore"):
        out = np.full(n, base & MASK, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_POW = _INV = np.zeros(0, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        _POW, _INV = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
    return _POW, _INV


def text_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null texts as empty ones; the bytes are not copied where Arrow allows it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = WHITE, fold: np.ndarray = RAW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: (first byte, end byte, 64-bit hash, number of the text), in order.

    A word is a longest run of bytes not in ``gap`` inside one text. ``fold`` gives the value of each byte that is hashed.
    """
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), empty
    solid = ~gap[data]
    edge = np.zeros(n + 1, bool)
    edge[0], edge[n] = solid[0], solid[-1]
    np.not_equal(solid[1:], solid[:-1], out=edge[1:-1])
    inner = np.unique(offsets[(offsets > 0) & (offsets < n)])
    split = inner[solid[inner] & solid[inner - 1]]  # a word ends and another begins where two texts meet
    if len(split):
        marks = np.sort(np.concatenate([np.flatnonzero(edge), split, split]))
    else:
        marks = np.flatnonzero(edge)
    first, end = marks[0::2], marks[1::2]
    first, end = first.astype(np.int64), end.astype(np.int64)
    hashes = np.empty(len(first), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(first):
            base = first[at]
            upto = max(at + 1, int(np.searchsorted(end, base + PIECE, "right")))
            stop = end[upto - 1]
            power, inverse = _tables(int(stop - base))
            total = np.empty(stop - base + 1, np.uint64)
            total[0] = 0
            np.cumsum(fold[data[base:stop]] * power[: stop - base], out=total[1:])
            f = first[at:upto] - base
            e = end[at:upto] - base
            hashes[at:upto] = (total[e] - total[f]) * inverse[f]
            at = upto
        hashes = mix(hashes ^ (end - first).astype(np.uint64))
    text = np.searchsorted(offsets, first, "right") - 1
    return first, end, hashes, text


def stems(data: np.ndarray, first: np.ndarray, end: np.ndarray, sizes: tuple[int, ...], fold: np.ndarray = RAW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the word) of the first bytes of each word that is longer, for each of ``sizes`` (8 at most), in that order."""
    out, of = [], []
    for size in sizes:
        word = np.flatnonzero(end - first > size)
        packed = np.full(len(word), size, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                packed = packed * np.uint64(257) + fold[data[first[word] + k]]
            out.append(mix(packed * np.uint64(GOLD)))
        of.append(word)
    return np.concatenate(out), np.concatenate(of)


_QPOW: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def rolling(hashes: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each ``width`` consecutive values (len - width + 1 of them); the caller leaves out those across texts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if width <= 4:
            out = np.zeros(n, np.uint64)
            for k in range(width):
                out = out * np.uint64(base) + hashes[k : k + n]
            return mix(out)
        size = 1 << max(16, (len(hashes)).bit_length())
        if (base, size) not in _QPOW:
            _QPOW.clear() if len(_QPOW) > 4 else None
            _QPOW[base, size] = powers(base, size), powers(pow(base, -1, 1 << 64), size)
        power, inverse = _QPOW[base, size]
        total = np.empty(len(hashes) + 1, np.uint64)
        total[0] = 0
        np.cumsum(hashes * power[: len(hashes)], out=total[1:])
        return mix((total[width:] - total[:-width]) * inverse[:n])


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text (a longer text comes alone, and whole)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        n = len(column)
        if not n:
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
        at = 0
        while at < n:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            upto = min(upto, n)
            yield batch.slice(at, upto - at)
            at = upto
