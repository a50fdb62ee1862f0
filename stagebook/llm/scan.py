"""Vectorised looks at a whole batch of texts: bytes, words and shingles as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken up at once within a task.
BATCH_BYTES = 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, *range(9, 14)]] = True
_RANDOM = np.random.default_rng(20240229)
_OF_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_OF_PLACE = _RANDOM.integers(1, 2**63, 5, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))


def parts(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the texts' UTF-8 bytes on end and where each begins (one more at the end)."""
    column = batch.column(batch.schema.get_field_index(text))
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    edges = [0, *(np.nonzero(np.diff((at[1:] - at[0]) // BATCH_BYTES))[0] + 1).tolist(), len(column)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a), data[at[a] : at[b]], at[a : b + 1] - at[a]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values[begin:end], also of empty spans (integers wrap, floats are summed in double)."""
    total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[end] - total[begin]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run without white space, and the number of words before each text."""
    space = np.concatenate([IS_SPACE[data], [True]])
    before = np.concatenate([[True], space[:-1]])
    before[at[:-1]] = True  # a text's end also ends a word
    begin = np.nonzero(~space[:-1] & before[:-1])[0]
    ends = space.copy()
    ends[at[1:]] = True
    stop = np.nonzero(ends)[0]
    end = stop[np.searchsorted(stop, begin, side="right")] if len(begin) else begin
    return begin, end, np.searchsorted(begin, at)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z in lower case: a polynomial over random values of bytes, from one running sum."""
    n = len(data)
    power = np.full(n + 1, _BASE, dtype=np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    back = np.full(n + 1, _BACK, dtype=np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    raw = sums(_OF_BYTE[_LOWER[data]] * power[:n], begin, end) * back[begin]
    return mix(raw + (end - begin).astype(np.uint64))


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles of ``width`` words as sorted 64-bit hashes; fewer words make one shingle, none make none."""
    begin, end, first = words(data, at)
    h = word_hashes(data, begin, end)
    m = len(h)
    full = np.zeros(max(0, m - width + 1), dtype=np.uint64)
    for k in range(width):
        full += h[k : k + len(full)] * _OF_PLACE[k]
    full = mix(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _OF_PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out
