"""Suffix arrays by two-stage sorting, vectorised with numpy.

Stage one sorts only the suffixes smaller than their successors (type S). Stage two scans the first-byte buckets in order
and induces all others (type L) from them: a suffix's predecessor of type L goes to the next place of its own bucket.
Order is exact for the first `depth` bytes, which is all that adjacent common prefixes up to `depth` need.
"""

from __future__ import annotations

import numpy as np


def small_types(t: np.ndarray) -> np.ndarray:
    """True where suffix i is smaller than suffix i + 1 (the empty suffix is the smallest of all)."""
    n = len(t)
    if not n:
        return np.zeros(0, bool)
    last = np.flatnonzero(np.concatenate((t[1:] != t[:-1], [True])))  # last place of each run of one byte
    rising = np.zeros(len(last), bool)
    rising[:-1] = t[last[:-1]] < t[last[:-1] + 1]
    return np.repeat(rising, np.diff(np.concatenate(([-1], last))))


def words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros follow the end."""
    padded = np.concatenate((t, np.zeros(8, np.uint8))).astype(np.uint64)
    w = np.zeros(len(t) + 1, np.uint64)
    for k in range(8):
        w[: len(t)] |= padded[k : k + len(t)] << np.uint64(56 - 8 * k)
    return w


def sort_small(w: np.ndarray, places: np.ndarray, depth: int, deep: np.ndarray | None = None) -> np.ndarray:
    """The given suffixes in the order of their first `depth` bytes: eight bytes at a time, ties only.

    deep: which of them matter that far; the others stand behind those that share their first eight bytes.
    """
    if not len(places):
        return places
    end = len(w) - 1
    key = w[places]
    order = np.argsort(key, kind="stable") if deep is None else np.lexsort((~deep, key))
    out, key = places[order], key[order]
    head = np.ones(len(out), bool)
    head[1:] = key[1:] != key[:-1]
    if deep is not None:
        head |= ~deep[order]
    for at in range(8, depth, 8):
        tied = ~head
        tied[:-1] |= ~head[1:]
        idx = np.flatnonzero(tied)
        if not len(idx):
            break
        group = np.cumsum(head)[idx]
        sub = out[idx]
        key = w[np.minimum(sub + at, end)]
        order = np.lexsort((key, group))
        out[idx], key = sub[order], key[order]
        split = np.ones(len(idx), bool)
        split[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        head[idx] = split
    return out


def suffix_array(t: np.ndarray, depth: int = 200, wanted: np.ndarray | None = None) -> np.ndarray:
    """All suffixes of the bytes t, ordered by their first `depth` bytes.

    wanted: the places whose order matters; the others are then ordered by their first bytes only, and never stand
    between wanted ones with equal first `depth` bytes.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    small = small_types(t)
    places, deep = np.flatnonzero(small), None
    if wanted is not None:
        # a wanted suffix of type L takes its order from the next suffix of type S
        after = np.searchsorted(places, np.flatnonzero(wanted))
        deep = np.zeros(len(places), bool)
        deep[after[after < len(places)]] = True
    s_sorted = sort_small(words(t), places, depth + 8, deep)
    cut = np.searchsorted(t[s_sorted], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))
    done = []
    for c in np.flatnonzero(np.bincount(t, minlength=256)):
        queue = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(queue):  # runs of this byte induce themselves
            bucket.append(queue)
            before = queue[queue > 0] - 1
            queue = before[(t[before] == c) & ~small[before]]
        bucket.append(s_sorted[cut[c] : cut[c + 1]])
        whole = np.concatenate(bucket)
        done.append(whole)
        before = whole[whole > 0] - 1
        before = before[(t[before] > c) & ~small[before]]
        if len(before):
            before = before[np.argsort(t[before], kind="stable")]
            first = t[before]
            edge = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
            for a, b in zip(edge, np.concatenate((edge[1:], [len(before)]))):
                waiting[first[a]].append(before[a:b])
    return np.concatenate(done)


def common_prefixes(t: np.ndarray, sa: np.ndarray, depth: int = 200) -> np.ndarray:
    """Bytes that each suffix of sa shares with the one before it, at most `depth`; 0 for the first."""
    n = len(t)
    out = np.zeros(len(sa), np.int64)
    if len(sa) < 2:
        return out
    w = words(t)
    i = np.arange(1, len(sa))
    for at in range(0, depth, 8):
        a, b = sa[i - 1] + at, sa[i] + at
        x = w[np.minimum(a, n)] ^ w[np.minimum(b, n)]
        lead = np.full(len(x), 8, np.int64)  # equal leading bytes of the two words
        for k in range(8):
            lead -= (x >> np.uint64(56 - 8 * k)) != 0
        lead = np.minimum(lead, np.maximum(0, n - np.maximum(a, b)))
        out[i] += lead
        i = i[lead == 8]
        if not len(i):
            break
    return np.minimum(out, depth)
