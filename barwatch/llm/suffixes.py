"""Suffix sorting in numpy, for indexes of one shard."""

from __future__ import annotations

import numpy as np


def packed(codes: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """As many codes from each position on as 64 bits hold, the first one highest, and how many."""
    many = 64 // bits
    keys = np.zeros(len(codes), np.uint64)
    wide = np.concatenate((codes.astype(np.uint64), np.zeros(many - 1, np.uint64)))
    for i in range(many):
        keys = (keys << np.uint64(bits)) | wide[i : len(codes) + i]
    return keys, many


def _heads(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def suffix_order(codes: np.ndarray, bits: int, first: tuple[np.ndarray, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and each position's place in it.

    Ranks by the first codes are doubled in reach, only where suffixes are
    still tied.  The last code must be the largest one and below 2^bits.
    ``first`` is what ``packed`` gave, where it is known.
    """
    keys, reach = first or packed(codes, bits)
    order = np.argsort(keys)
    heads = _heads(keys[order])
    sizes = np.diff(np.append(heads, len(codes)))
    rank = np.empty(len(codes), np.int64)
    rank[order] = np.repeat(heads, sizes)
    slots = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    while len(slots):
        at = order[slots]
        next_ = np.zeros(len(at), np.int64)
        inside = at + reach < len(codes)
        next_[inside] = rank[at[inside] + reach] + 1
        keys = (rank[at] << 32) | next_
        sort = np.argsort(keys)
        order[slots], keys = at[sort], keys[sort]
        heads = _heads(keys)
        sizes = np.diff(np.append(heads, len(slots)))
        rank[order[slots]] = np.repeat(slots[heads], sizes)
        slots = slots[np.repeat(sizes, sizes) > 1]
        reach *= 2
    return order, rank


def common_prefixes(keys: np.ndarray, many: int, bits: int, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Codes that the suffixes at ``a`` and ``b`` have in common, to ``most``; ``keys`` from ``packed``."""
    found = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    for done in range(0, most, many):
        i, j = a[left] + done, b[left] + done
        inside = (i < len(keys)) & (j < len(keys))
        left, i, j = left[inside], i[inside], j[inside]
        differ = keys[i] ^ keys[j]
        same = np.zeros(len(left), np.int64)
        for k in range(many):
            same += (differ >> np.uint64(64 // bits * bits - (k + 1) * bits)) == 0
        found[left] = done + same
        left = left[differ == 0]
        if not len(left):
            break
    return np.minimum(found, most)
