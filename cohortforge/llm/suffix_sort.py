"""Two-stage suffix sorting of a block of strings, in numpy."""

from __future__ import annotations

import numpy as np


def words(data: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros behind the end."""
    padded = np.zeros(len(data) + depth + 8, dtype=np.uint64)
    padded[: len(data)] = data
    out = padded[: len(data) + depth].copy()
    for j in range(1, 8):
        out <<= np.uint64(8)
        out |= padded[j : j + len(data) + depth]
    return out


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """True for each suffix that is smaller than the suffix behind it; the last, before the empty one, is not."""
    n = len(data)
    out = np.zeros(n, dtype=bool)
    if n < 2:
        return out
    differs = np.flatnonzero(data[:-1] != data[1:])
    verdict = data[differs] < data[differs + 1]
    lengths = np.diff(np.concatenate(([-1], differs)))
    out[: lengths.sum()] = np.repeat(verdict, lengths)  # equal bytes follow the next that differs
    return out


def sort_directly(w: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` by their first ``depth`` bytes, equal ones as they came."""
    order = np.argsort(w[at], kind="stable")
    at = at[order]
    key = w[at]
    group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if len(at) else np.zeros(0, np.int64)
    for d in range(8, depth, 8):
        size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        key = w[at[tied] + d]
        order = np.lexsort((key, group[tied]))
        at[tied] = at[tied][order]
        key = key[order]
        g = group[tied]
        new = np.zeros(len(group), dtype=np.int64)
        new[tied[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        new[1:] |= group[1:] != group[:-1]
        group = np.cumsum(new)
    return at


def suffix_array(data: np.ndarray, depth: int, w: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least.

    First stage: only suffixes smaller than their successors are sorted directly.
    Second stage: the others are induced.  Buckets of one first byte are scanned in
    order; a suffix met puts its predecessor, if that is larger than it, at the next
    free place of the predecessor's bucket.  Predecessors that fall into the bucket
    being scanned are scanned in waves, which is the order of a scan one by one.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    w = words(data, depth) if w is None else w
    small = smaller_than_next(data)
    direct = sort_directly(w, np.flatnonzero(small), depth)
    direct_bounds = np.searchsorted(data[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(met: np.ndarray) -> None:
        before = met[met > 0] - 1
        before = before[~small[before]]
        if len(before):
            first = data[before]
            order = np.argsort(first, kind="stable")
            cuts = np.flatnonzero(np.diff(first[order])) + 1
            for part in np.split(before[order], cuts):
                induced[data[part[0]]].append(part)

    induced[data[n - 1]].append(np.array([n - 1]))  # the empty suffix is the least: it puts the last one first
    for byte in range(256):
        done = 0
        while done < len(induced[byte]):  # a wave: what the last one put into this bucket
            wave = np.concatenate(induced[byte][done:])
            done = len(induced[byte])
            out.append(wave)
            induce(wave)
        own = direct[direct_bounds[byte] : direct_bounds[byte + 1]]
        if len(own):
            out.append(own)
            induce(own)
    return np.concatenate(out)


def adjacent_prefixes(w: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, in whole words of eight bytes up to ``depth``.

    Only ``depth`` itself is exact to the byte; the first entry is zero.
    """
    out = np.zeros(len(order), dtype=np.int64)
    live = np.arange(1, len(order))
    for d in range(0, depth, 8):
        if not len(live):
            break
        d_at = min(d, depth - 8)
        live = live[w[order[live] + d_at] == w[order[live - 1] + d_at]]
        out[live] = min(d + 8, depth)
    return out
