"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

Induced sorting scans buckets of suffixes by first sign. Within a bucket,
what a suffix induces into the same bucket is the run of its sign to the left,
so a whole bucket is expanded, filtered and handed on at once: the number of
array operations is that of the signs, not of the suffixes.
"""

from __future__ import annotations

import numpy as np

_EMPTY = np.zeros(0, np.int32)


def ragged_steps(counts: np.ndarray) -> np.ndarray:
    """0, …, counts[0] - 1, 0, …, counts[1] - 1, …"""
    ends = np.cumsum(counts)
    return np.arange(int(counts.sum()), dtype=np.int64) - np.repeat(ends - counts, counts)


def _smaller(text: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the next one (the last, the end mark, is). begins: of runs of a sign."""
    first = np.flatnonzero(begins)
    ends = np.append(first[1:], len(text))
    smaller = np.ones(len(first), bool)
    smaller[:-1] = text[first[:-1]] < text[first[1:]]
    return np.repeat(smaller, ends - first)


class _Buckets:
    """Suffixes waiting for their bucket, in the order of their coming."""

    def __init__(self, signs: int) -> None:
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(signs)]

    def put(self, suffixes: np.ndarray, signs: np.ndarray) -> None:
        if not len(suffixes):
            return
        order = np.argsort(signs, kind="stable")
        sorted_signs, suffixes = signs[order], suffixes[order]
        cuts = np.flatnonzero(sorted_signs[1:] != sorted_signs[:-1]) + 1
        begin = 0
        for end in [*cuts.tolist(), len(suffixes)]:
            self.waiting[sorted_signs[begin]].append(suffixes[begin:end])
            begin = end

    def take(self, sign: int, run: np.ndarray) -> np.ndarray:
        """The bucket in scanning order: all that wait, then all one to the left of these in the same run, and so on."""
        parts = self.waiting[sign]
        if not parts:
            return _EMPTY
        first = np.concatenate(parts)
        self.waiting[sign] = []
        left = run[first]
        if not left.any():
            return first
        steps = ragged_steps(left + 1)
        every = np.repeat(first, left + 1) - steps.astype(np.int32)
        return every[np.argsort(steps, kind="stable")]


def _induced(text: np.ndarray, signs: int, run: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes, from the leftmost-smaller ones in their order within each bucket."""
    larger: list[np.ndarray] = [_EMPTY] * signs
    smaller: list[np.ndarray] = [_EMPTY] * signs
    first = text[leftmost]
    cuts = np.searchsorted(first, np.arange(signs + 1)) if len(first) and (first[:-1] <= first[1:]).all() else None
    if cuts is None:
        order = np.argsort(first, kind="stable")
        leftmost = leftmost[order]
        cuts = np.searchsorted(first[order], np.arange(signs + 1))
    buckets = _Buckets(signs)
    for sign in range(signs):
        here = larger[sign] = buckets.take(sign, run)
        for part in (here, leftmost[cuts[sign]:cuts[sign + 1]]):
            before = part[part > 0] - 1
            at = text[before]
            keep = at > sign
            buckets.put(before[keep], at[keep])
    buckets = _Buckets(signs)
    for sign in range(signs - 1, -1, -1):
        here = smaller[sign] = buckets.take(sign, run)
        for part in (here, larger[sign][::-1]):
            before = part[part > 0] - 1
            at = text[before]
            keep = at < sign
            buckets.put(before[keep], at[keep])
    smaller[0] = np.array([len(text) - 1], np.int32)
    return np.concatenate([x for sign in range(signs) for x in (larger[sign], smaller[sign][::-1])])


def _names(text: np.ndarray, ordered: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """For each leftmost-smaller suffix, in text order, the rank of its substring (up to the next such suffix)."""
    lengths = np.diff(leftmost, append=leftmost[-1])
    length = np.zeros(len(text), np.int32)
    length[leftmost] = lengths
    a, b = ordered[:-1], ordered[1:]
    differs = length[a] != length[b]
    active = np.flatnonzero(~differs)
    step = 0
    while len(active):
        x, y = a[active], b[active]
        unequal = text[x + step] != text[y + step]
        differs[active[unequal]] = True
        active = active[~unequal & (step < length[x])]
        step += 1
    rank = np.zeros(len(text), np.int64)
    rank[ordered] = np.concatenate([[0], np.cumsum(differs)])
    return rank[leftmost]


def ranked(names: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Positions in order of their suffixes of names, by the names' first ``depth`` signs at least.

    Names of runs of names: each round sorts the pairs of what two neighbouring
    runs are called, among those only that are still called the same.
    """
    m = len(names)
    order = np.argsort(names)
    ordered = names[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(m, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    tied = order[~(new & np.append(new[1:], True))]
    span = 1
    while len(tied) and (depth is None or span < depth):
        after = tied + span
        second = np.where(after < m, rank[np.minimum(after, m - 1)] + 1, 0)
        key = rank[tied] * (m + 1) + second
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        old = rank[tied]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(tied))
        start = np.maximum.accumulate(np.where(group, place, 0))
        rank[tied] = old + np.maximum.accumulate(np.where(new, place, 0)) - start
        tied = tied[~(new & np.append(new[1:], True))]
        span *= 2
    if len(tied):  # equal as far as asked for: next to each other in any order
        tied = tied[np.argsort(rank[tied])]
        group = np.concatenate([[True], rank[tied][1:] != rank[tied][:-1]])
        place = np.arange(len(tied))
        rank[tied] += place - np.maximum.accumulate(np.where(group, place, 0))
    out = np.empty(m, np.int64)
    out[rank] = np.arange(m)
    return out


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of ``text`` (uint8, 1 to 255) in order, by their first ``depth`` signs at least."""
    text = np.append(text.astype(np.uint8), np.uint8(0))
    n, signs = len(text), int(text.max()) + 1
    if n == 1:
        return np.zeros(0, np.int32)
    begins = np.concatenate([[True], text[1:] != text[:-1]])
    run = (np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))).astype(np.int32)
    smaller = _smaller(text, begins)
    leftmost = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    ordered = _induced(text, signs, run, leftmost)
    ordered = ordered[is_leftmost[ordered]]
    names = _names(text, ordered, leftmost)
    if len(names) and names.max() + 1 < len(names):
        # leftmost-smaller suffixes are two signs apart at least
        ordered = leftmost[ranked(names, None if depth is None else depth // 2 + 2)]
    return _induced(text, signs, run, ordered)[1:]


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, enough: int | None = None) -> np.ndarray:
    """For each position of the text, the signs it shares with the suffix before it in the array.

    Lengths of ``enough`` and more are told as such, not exactly.

    Where the suffix before is the one after that of the position before, and
    that shares a sign at least, the prefix is one shorter; only the other positions are compared, eight signs
    at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    fresh = np.ones(n, bool)
    fresh[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (text[:-1] != text[before[:-1]])
    fresh &= before >= 0
    if enough is not None:  # look again now and then, so that no comparison has to go on beyond twice of it
        fresh |= (before >= 0) & ((np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))) % enough == 0)
    raw = np.concatenate([text, np.zeros(16, np.uint8)])  # behind its end a text differs from all others
    words = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), strides=(1,))
    at = np.flatnonzero(fresh)
    shared = np.zeros(len(at), np.int64)
    active, a, b, step = np.arange(len(at)), at, before[at], 0
    while len(active):
        x = words[a] ^ words[b]
        equal = x == 0
        low = x[~equal]
        shared[active[~equal]] = step + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) // 8).astype(np.int64)
        active, a, b, step = active[equal], a[equal] + 8, b[equal] + 8, step + 8
        if enough is not None and step >= 2 * enough:
            shared[active] = step
            break
    found = np.zeros(n, np.int64)
    found[at] = shared
    source = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
    chained = (before >= 0) & (source >= 0)
    found[chained] = np.maximum(found[source[chained]] - (np.flatnonzero(chained) - source[chained]), 0)
    return found
