"""Hashed words and word shingles of a batch of UTF-8 texts."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Words of a shingle.
SHINGLE = 5
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRIME = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _PRIME, np.uint64)]), dtype=np.uint64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every word `[^\\x20\\x09-\\x0D]+`, A-Z lowered; texts lie at `offsets` in `data`."""
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0] - offsets[0]
    opens[edges] = inside[edges]
    places = np.flatnonzero(inside)
    if not len(places):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(opens[places])
    lengths = np.diff(np.append(first, len(places)))
    within = np.arange(len(places)) - np.repeat(first, lengths)
    powers = _powers(1 << max(6, int(lengths.max() - 1).bit_length()))
    sums = np.add.reduceat(_VALUES[_LOWER[data[places]]] * powers[within], first)
    owner = np.searchsorted(offsets - offsets[0], places[first], "right") - 1
    return mix(sums + lengths.astype(np.uint64)), owner


def shingles(hashes: np.ndarray, owner: np.ndarray, n_texts: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of the text, place of its first word in `hashes`) of every shingle, by text and place.

    A text with fewer than `size` words has one shingle, its whole sequence; a text without words has none.
    """
    counts = np.bincount(owner, minlength=n_texts)
    begins = np.cumsum(counts) - counts
    if len(hashes) >= size:
        value = np.zeros(len(hashes) - size + 1, np.uint64)
        for k in range(size):
            value = value * np.uint64(_PRIME) + hashes[k : k + len(value)]
        at = np.flatnonzero(owner[: len(value)] == owner[size - 1 :])
        value, texts = mix(value[at]), owner[at]
    else:
        value, texts, at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            whole[has] = whole[has] * np.uint64(_PRIME) + hashes[begins[short[has]] + k]
        value = np.concatenate([value, mix(whole + counts[short].astype(np.uint64))])
        texts, at = np.concatenate([texts, short]), np.concatenate([at, begins[short]])
        order = np.argsort(texts, kind="stable")
        value, texts, at = value[order], texts[order], at[order]
    return value, texts, at
