"""Two-stage suffix sorting of a byte block in numpy, and runs of equal prefixes in the result.

Only suffixes smaller than their successors are sorted directly; one scan over the buckets of first bytes puts every
other suffix in place, as the predecessor of one already placed. Order is exact for the first ``depth`` bytes.
"""

from __future__ import annotations

import numpy as np

_CUT = np.uint64(0)


def words_at(block: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a native integer that orders like the bytes (zeros past the end)."""
    padded = np.concatenate([block, np.zeros(8, np.uint8)])
    return np.ndarray(len(block), ">u8", padded, strides=(1,)).astype(np.uint64)


def _direct(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``at`` ordered by the ``depth`` bytes that stand there, eight bytes a step, ties only."""
    n = len(words)
    key = words[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    for step in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group, part = np.cumsum(new)[where], at[where]
        key = np.where(part + step < n, words[np.minimum(part + step, n - 1)], _CUT)
        order = np.lexsort((key, group))
        part, key = part[order], key[order]
        at[where] = part
        fresh = np.ones(len(where), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        new[where] = fresh
    return at


def suffix_order(block: np.ndarray, words: np.ndarray | None = None, depth: int = 100) -> np.ndarray:
    """Positions of ``block`` (uint8) in the order of the suffixes that start there."""
    n = len(block)
    if n < 2:
        return np.arange(n)
    words = words_at(block) if words is None else words
    change = np.flatnonzero(block[1:] != block[:-1])
    rises = np.append(block[change] < block[change + 1], False)
    ends = np.append(change, n - 1)
    up = np.repeat(rises, np.diff(ends, prepend=-1))  # smaller than the next suffix
    direct = _direct(np.flatnonzero(up), words, depth)
    first = block[direct]
    cut = np.searchsorted(first, np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[block[-1]].append(np.array([n - 1]))
    out: list[np.ndarray] = []

    def induce(done: np.ndarray, c: int) -> np.ndarray:
        """Puts the predecessors of ``done`` into their buckets; returns those of bucket ``c`` itself."""
        before = done[done > 0] - 1
        before = before[~up[before]]
        at = block[before]
        same = before[at == c]
        before, at = before[at > c], at[at > c]
        order = np.argsort(at, kind="stable")
        before, at = before[order], at[order]
        for d in np.unique(at):
            lo, hi = np.searchsorted(at, [d, int(d) + 1])
            waiting[d].append(before[lo:hi])
        return same

    for c in range(256):
        part = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        while len(part):
            out.append(part)
            part = induce(part, c)
        part = direct[cut[c] : cut[c + 1]]
        if len(part):
            out.append(part)
            induce(part, c)
    return np.concatenate(out)


def equal_prefixes(order: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """For each entry of ``order`` whether its first ``length`` bytes equal those of the entry before.

    ``length`` bytes must remain at every entry.
    """
    same = np.zeros(len(order), bool)
    if len(order) < 2:
        return same
    left = np.arange(1, len(order))
    for step in [*range(0, length - 8, 8), max(0, length - 8)]:
        a, b = words[order[left - 1] + step], words[order[left] + step]
        if length < 8:
            a, b = a >> np.uint64(64 - 8 * length), b >> np.uint64(64 - 8 * length)
        left = left[a == b]
    same[left] = True
    return same
