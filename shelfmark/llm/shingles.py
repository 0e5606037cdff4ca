"""Sets of word n-grams as sorted 64-bit hashes, many documents in one numpy pass.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A document's set holds its
distinct shingles of `words` words; a document with fewer words gives its whole sequence as one shingle; one without
words gives the empty set.
"""

from __future__ import annotations

import numpy as np

from shelfmark.llm.common import mix

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER[_SPACE] = 0
_BASE = 0x9FB21C651E98DF25
_POWERS = np.zeros(0, np.uint64)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of the document that it stands in."""
    global _POWERS
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    index = np.arange(n, dtype=np.int32)
    begun = np.where(first, index, 0)
    np.maximum.accumulate(begun, out=begun)
    index -= begun
    if (longest := int(index.max()) + 1) > len(_POWERS):
        _POWERS = powers(max(longest, 1 << 12))
    value = _LOWER[data]
    value *= _POWERS[index]
    value[: starts[0]] = 0
    return mix(np.add.reduceat(value, starts)), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """For each document its set, as a sorted array without repeats."""
    hashes, doc = word_hashes(data, offsets)
    docs = len(offsets) - 1
    count = np.bincount(doc, minlength=docs) if len(doc) else np.zeros(docs, np.int64)
    weight = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    full = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words if len(full) else 0):
        full += hashes[k : k + len(full)] * weight[k]
    full = mix(full)
    begin = np.concatenate([[0], np.cumsum(count)])
    out = []
    for d in range(docs):
        n = int(count[d])
        if n >= words:
            own = np.sort(full[begin[d] : begin[d] + n - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:
            with np.errstate(over="ignore"):
                own = (hashes[begin[d] : begin[d + 1]] * weight[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mix(np.array([own])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
