"""Vectorised text kernels shared by the corpus operators.

Everything here works on the raw UTF-8 buffer of an Arrow string column, so a
batch of documents is cut into words, hashed and windowed without creating a
Python object per word.  Hashes only route and pre-sort rows; operators whose
contract is exact compare the bytes afterwards (see ``equal_slices``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# ASCII white space: the complement of the word pattern [^\x20\x09-\x0D]+.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# ASCII-only lower casing.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


#: Bytes that are worked on at a time where eight bytes are held for each.
PIECE = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least n of each."""
    global _POW, _INV
    if len(_POW) < n:
        m = max(n, 2 * len(_POW))
        base = np.full(m, _P)
        base[0] = 1
        _POW = np.cumprod(base, dtype=np.uint64)
        base[1:] = _P_INV
        _INV = np.cumprod(base, dtype=np.uint64)
    return _POW, _INV


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64), salted."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], (off - off[0]).astype(np.int64)


def slices(offsets: np.ndarray, limit: int):
    """Runs (first, last) of documents of about ``limit`` bytes each; a longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of every word, and the first word's index of each document (n+1 entries)."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    gap = separators[data]
    begin = ~gap
    begin[1:] &= gap[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[firsts] = ~gap[firsts]
    stop = ~gap
    stop[:-1] &= gap[1:]
    stop[firsts[1:] - 1] = ~gap[firsts[1:] - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of each byte slice (slices in order), from a running polynomial over the buffer."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # in pieces that stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        piece = data[starts[i] : ends[j - 1]]
        power, inverse = _powers(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1 + salt)) * power[: len(piece)], out=total[1:])
        s, e = starts[i:j] - starts[i], ends[i:j] - starts[i]
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out, salt)


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values; positions that cross a document are the caller's to drop."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = values[:n].copy()
    for i in range(1, k):
        out *= _P
        out += values[i : i + n]
    return mix(out, k)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    if not len(counts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1], dtype=np.int64) - np.repeat(ends - counts, counts)


def take_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The slices' bytes, one after another."""
    counts = ends - starts
    upto = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(upto[-1], np.uint8)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PIECE, "right")) - 1)
        out[upto[i] : upto[j]] = data[np.repeat(starts[i:j] - upto[i:j], counts[i:j]) + np.arange(upto[i], upto[j])]
        i = j
    return out


def equal_slices(data: np.ndarray, s1: np.ndarray, e1: np.ndarray, s2: np.ndarray, e2: np.ndarray, step: int = 20_000) -> np.ndarray:
    """Whether each pair of slices holds the same bytes."""
    same = (e1 - s1) == (e2 - s2)
    for i in range(0, len(s1), step):
        at = np.flatnonzero(same[i : i + step] & (s1[i : i + step] != s2[i : i + step])) + i
        if not len(at):
            continue
        counts = e1[at] - s1[at]
        inner = ranges(counts)
        differ = data[np.repeat(s1[at], counts) + inner] != data[np.repeat(s2[at], counts) + inner]
        bad = np.add.reduceat(differ, np.cumsum(counts) - counts) if len(differ) else np.zeros(len(at), int)
        same[at[bad > 0]] = False
    return same


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each document, sorted within it, and each document's first index.

    A document of fewer words, but some, has its whole sequence as its one shingle.
    """
    starts, ends, first = words(data, offsets)
    value = slice_hashes(data, starts, ends)
    count = np.diff(first)
    long = np.maximum(count - k + 1, 0)
    at = np.repeat(first[:-1], long) + ranges(long)
    hashes, owner = window_hashes(value, k), np.repeat(np.arange(len(count)), long)
    hashes = hashes[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = []
        for d in short:
            one = value[first[d] : first[d + 1]]
            extra.append(window_hashes(one, len(one))[0])
        hashes = np.concatenate([hashes, np.array(extra, np.uint64)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(count) + 1))
