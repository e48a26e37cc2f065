"""Vectorised text primitives on Arrow buffers: words, word hashes, shingle hashes.

Everything here works on the UTF-8 bytes of a block of documents at once. Separators are ASCII, so splitting bytes
and splitting characters give the same words. A very long text is its own block; what is held for each of its bytes is
held for slices of SLICE bytes only, so memory is a few bytes for each byte of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space of the word definition, \x20 and \x09-\x0D.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

SLICE = 4 << 20

_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_BYTE_CODE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(63, _BASE, np.uint64)]))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """_BASE ** 0 .. _BASE ** (n - 1), modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * n, _BASE, np.uint64)]))
    return _powers[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rows + 1 of them) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, text: str, most_bytes: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows of about most_bytes of text, a longer row alone: (rows, bytes, offsets)."""
    data, at = buffers(batch.column(batch.schema.get_field_index(text)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most_bytes, "right")) - 1)
        last = min(last, batch.num_rows)
        yield batch.slice(first, last - first), data[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte of every word of the block, and the words of each row as offsets (rows + 1)."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    edges = at[:-1][at[1:] > at[:-1]]
    starts, ends, last = [], [], False
    for i in range(0, len(data), SLICE):
        solid = ~_IS_SEP[data[i:i + SLICE]]
        before = np.empty(len(solid), bool)
        before[0], before[1:], last = last, solid[:-1], solid[-1]
        edge = np.zeros(len(solid), bool)
        edge[edges[np.searchsorted(edges, i):np.searchsorted(edges, i + len(solid))] - i] = True
        starts.append(np.flatnonzero(solid & (edge | ~before)) + i)
        ends.append(np.flatnonzero(before & (edge | ~solid)) + i)
    if last:
        ends.append(np.array([len(data)]))
    first = np.concatenate(starts)
    return first, np.concatenate(ends), np.searchsorted(first, at, "left").astype(np.int64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE, "right")))
        last = min(last, len(starts))
        length = ends[first:last] - starts[first:last]
        if last - first == 1 and length[0] > SLICE:  # a word of more than a slice: its slices' sums, each shifted to its place
            total, shift = 0, 1
            for i in range(int(starts[first]), int(ends[first]), SLICE):
                piece = _BYTE_CODE[data[i:min(i + SLICE, int(ends[first]))]]
                total += int((piece * powers(len(piece))).sum(dtype=np.uint64)) * shift
                shift = shift * pow(int(_BASE), SLICE, 1 << 64) % (1 << 64)
            out[first] = np.uint64((total + int(length[0])) % (1 << 64))
        else:
            offset = np.concatenate([[0], np.cumsum(length)[:-1]])
            inside = np.arange(int(length.sum())) - np.repeat(offset, length)
            code = _BYTE_CODE[data[inside + np.repeat(starts[first:last], length)]] * powers(int(length.max()))[inside]
            out[first:last] = np.add.reduceat(code, offset) + length.astype(np.uint64)
        first = last
    return mix(out)


def sliding(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k words, by position of its first word, over the whole block (rows not regarded)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) + np.uint64(seed * 1000003)) | np.uint64(1)
    for i in range(k):
        out += words[i:i + n] * factors[i]
    return mix(out)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """The set of shingle hashes of each text of a block, A-Z lower-cased, sorted. Fewer words than a shingle has: the whole
    sequence as one."""
    data = ASCII_LOWER[data]
    starts, ends, first = word_spans(data, at)
    words = word_hashes(data, starts, ends)
    runs = sliding(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            found = np.sort(runs[a:b - size + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            out.append(sliding(words[a:b], b - a, seed=b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fixed_width(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as a binary column."""
    n, width = matrix.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])
