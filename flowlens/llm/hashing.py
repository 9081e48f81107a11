"""Word and shingle hashes of whole Arrow batches, for operators that run in Arrow workers."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text hashed at once; temporaries take some twenty times as much.
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=32)
def _odd(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def odd(n: int, seed: int) -> np.ndarray:
    """The first n odd multipliers of a seed."""
    return _odd(1 << max(6, (n - 1).bit_length()), seed)[:n]


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary Arrow column; NULL is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null(b"") if column.null_count else column
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lowered) and, per text, where its words start among them."""
    base, end = int(offsets[0]), int(offsets[-1])
    data, offsets = _LOWER[data[base:end]], offsets - base
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[borders] = inside[borders]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(inside)
    word = np.cumsum(first)[at] - 1
    place = at - starts[word]
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * odd(int(place.max()) + 1, 1)[place]
    sums = np.add.reduceat(terms, np.flatnonzero(first[at]))
    lengths = np.bincount(word, minlength=len(starts)).astype(np.uint64)
    return mixed(sums + lengths * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words of one text; of all its words as one run if it has fewer; sorted, distinct, signed."""
    if not len(words):
        return np.zeros(0, np.int64)
    run = min(n, len(words))
    total = np.zeros(len(words) - run + 1, np.uint64)
    for j, factor in enumerate(odd(run, 2)):
        total += words[j:len(words) - run + 1 + j] * factor
    return np.unique(mixed(total + np.uint64(run)).view(np.int64))


def each_text(column):
    """Word hashes of each text of a binary column, a few megabytes at a time."""
    data, offsets = texts_of(column)
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, side="right")) - 1)
        words, borders = word_hashes(data, offsets[low:high + 1])
        for a, b in zip(borders[:-1], borders[1:]):
            yield words[a:b]
        low = high


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
