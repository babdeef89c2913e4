"""Cuckoo filters in numpy: many keys per step, deletion, no false negatives.

A filter is a (buckets, 4) array of 16-bit fingerprints, 0 for a free slot; the bucket count is a power of two. A key is
two 64-bit halves: the first picks a bucket, the second gives the fingerprint, and the other bucket follows
from the first and the fingerprint.
"""

from __future__ import annotations

import numpy as np

from cardflow.llm.common import mix

SLOTS = 4
LOAD = 0.8
ROUNDS = 2_000


def buckets_for(keys: int) -> int:
    need = max(1, int(np.ceil(keys / (SLOTS * LOAD))))
    return 1 << (need - 1).bit_length()


def empty(keys: int) -> np.ndarray:
    return np.zeros((buckets_for(keys), SLOTS), np.uint16)


def prints(second: np.ndarray) -> np.ndarray:
    return np.maximum(second >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def places(first: np.ndarray, marks: np.ndarray, mask) -> tuple[np.ndarray, np.ndarray]:
    one = mix(first) & np.asarray(mask, np.uint64)
    return one.astype(np.int64), other(one, marks, mask)


def other(place: np.ndarray, marks: np.ndarray, mask) -> np.ndarray:
    return (place.astype(np.uint64) ^ (mix(marks.astype(np.uint64)) & np.asarray(mask, np.uint64))).astype(np.int64)


def contains(flat: np.ndarray, first: np.ndarray, second: np.ndarray, mask, offset=0) -> np.ndarray:
    """`flat`: one or more filters in a row; mask and offset (in buckets) may differ per key."""
    marks = prints(second)
    one, two = places(first, marks, mask)
    own = marks[:, None]
    return (flat[one + offset] == own).any(axis=1) | (flat[two + offset] == own).any(axis=1)


def _fill(table: np.ndarray, marks: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Put marks into free slots of their buckets; which found none."""
    order = np.argsort(place, kind="stable")
    sorted_place = place[order]
    first = np.searchsorted(sorted_place, sorted_place)
    rank = np.empty(len(place), np.int64)
    rank[order] = np.arange(len(place)) - first
    free = table[place] == 0
    ok = rank < free.sum(axis=1)
    slot = np.argmax(np.cumsum(free, axis=1) == (rank + 1)[:, None], axis=1)
    table[place[ok], slot[ok]] = marks[ok]
    return ~ok


def insert(table: np.ndarray, first: np.ndarray, second: np.ndarray) -> bool:
    """Insert all keys in place; False if the filter is too full (it is then unusable)."""
    mask = len(table) - 1
    if np.count_nonzero(table) + len(first) > table.size:
        return False
    marks = prints(second)
    one, two = places(first, marks, mask)
    left = _fill(table, marks, one)
    marks, place = marks[left], two[left]
    random = np.random.default_rng(len(table))
    for _ in range(ROUNDS):
        left = _fill(table, marks, place)
        marks, place = marks[left], place[left]
        if not len(marks):
            return True
        # One waiting mark per bucket throws another out, which moves to its other bucket.
        _, lead = np.unique(place, return_index=True)
        slot = random.integers(0, SLOTS, len(lead))
        out = table[place[lead], slot].copy()
        table[place[lead], slot] = marks[lead]
        marks[lead], place[lead] = out, other(place[lead], out, mask)
    return False


def delete(table: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
    """Take out one copy of each key's mark. Only keys that were inserted may be deleted."""
    mask = len(table) - 1
    marks = prints(second)
    one, two = places(first, marks, mask)
    for mark, a, b in zip(marks.tolist(), one.tolist(), two.tolist(), strict=True):
        for place in (a, b):
            at = np.flatnonzero(table[place] == mark)
            if len(at):
                table[place, at[0]] = 0
                break
        else:
            raise KeyError("the key was never inserted")
