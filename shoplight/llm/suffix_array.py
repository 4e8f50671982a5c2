"""Suffix arrays by induced sorting.

Every suffix is classified: smaller (S) than the next one, or larger (L). The leftmost S of each run
(LMS) starts a substring that ends at the next one. The substrings are sorted by one induction and
named; when names repeat, the suffixes of the name string are sorted the same way, recursively. A
second induction from the sorted LMS suffixes gives the whole array. An induction takes whole buckets at a
time with numpy, for texts (small alphabets). Name strings, which are at most half as long and have large
alphabets, are sorted by doubled prefixes, which numpy does faster than Python induces single symbols.
"""

from __future__ import annotations

import numpy as np

SMALL_ALPHABET = 300


def classify(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S. ``t`` ends with its only smallest symbol, which is S."""
    n = len(t)
    rises = np.sign(t[1:].astype(np.int64) - t[:-1])
    decided = np.where(rises != 0, np.arange(n - 1), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]  # the next place where neighbours differ
    kinds = np.append(rises > 0, True)
    return np.append(kinds[decided], True)


def _induce_buckets(t: np.ndarray, is_s: np.ndarray, sorted_lms: np.ndarray, k: int) -> np.ndarray:
    """The array induced from LMS suffixes in the given order, bucket by bucket."""
    symbols = t[sorted_lms]
    order = np.argsort(symbols, kind="stable")
    cuts = np.searchsorted(symbols[order], np.arange(k + 1))
    lms = [sorted_lms[order[cuts[c] : cuts[c + 1]]] for c in range(k)]
    large: list[list[np.ndarray]] = [[] for _ in range(k)]
    small: list[list[np.ndarray]] = [[] for _ in range(k)]

    def hand_on(before: np.ndarray, to: list[list[np.ndarray]]) -> None:
        c = t[before]
        turn = np.argsort(c, kind="stable")
        c, before = c[turn], before[turn]
        edges = np.flatnonzero(np.diff(c)) + 1
        for symbol, some in zip(c[np.concatenate([[0], edges])].tolist(), np.split(before, edges)):
            to[symbol].append(some)

    for c in range(k):
        # Entries that the bucket gives itself come behind those that smaller buckets gave it.
        at = 0
        while at < len(large[c]):
            some = large[c][at] if at + 1 == len(large[c]) else np.concatenate(large[c][at:])
            large[c][at:] = [some]
            at += 1
            before = some[some > 0] - 1
            before = before[~is_s[before]]
            if len(before):
                hand_on(before, large)
        before = lms[c][lms[c] > 0] - 1
        if len(before):
            hand_on(before, large)
    merged: list[np.ndarray] = []
    for c in range(k - 1, -1, -1):
        at = 0
        while at < len(small[c]):
            some = small[c][at] if at + 1 == len(small[c]) else np.concatenate(small[c][at:])
            small[c][at:] = [some]
            at += 1
            before = some[some > 0] - 1
            before = before[is_s[before]]
            if len(before):
                hand_on(before, small)
        falling = np.concatenate(large[c])[::-1] if large[c] else np.zeros(0, dtype=np.int64)
        before = falling[falling > 0] - 1
        before = before[is_s[before]]
        if len(before):
            hand_on(before, small)
        merged += [*small[c], falling]
        if c == 0:
            merged.append(np.array([len(t) - 1], dtype=np.int64))  # the last suffix is induced by nothing
    return np.concatenate(merged)[::-1]


def _by_doubling(t: np.ndarray) -> np.ndarray:
    """The suffix array of a string of names, by ranks of prefixes that double in length each round.

    A rank is the first slot of the suffixes that are equal so far; only these are sorted further.
    """
    n = len(t)
    order = np.argsort(t, kind="stable")
    slots, at, key = np.arange(n), order, t[order]
    rank = np.zeros(n + 1, dtype=np.int64)
    step = 0
    while True:
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(new, append=len(key))
        rank[at] = np.repeat(slots[new] + 1, sizes)  # 0 stands behind the end
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots):
            return order
        step = max(1, 2 * step)
        at = order[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + step, n)]
        turn = np.argsort(key, kind="stable")
        at, key = at[turn], key[turn]
        order[slots] = at


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of ``t`` over symbols below ``k``; the last symbol is its only 0."""
    n = len(t)
    if n < 3:
        return np.argsort(t, kind="stable")
    if k > SMALL_ALPHABET:
        return _by_doubling(t)
    is_s = classify(t)
    starts = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    array = _induce_buckets(t, is_s, starts, k)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[starts] = True
    ordered = array[is_lms[array]]
    names = _names(t, starts, ordered)
    if names[ordered].max() + 1 < len(starts):
        # Some substrings are equal: the order of their suffixes is that of the name string.
        reduced = names[starts]
        ordered = starts[suffix_array(reduced, int(reduced.max()) + 1)]
    else:
        ordered = starts[np.argsort(names[starts])]
    return _induce_buckets(t, is_s, ordered, k)


def _names(t: np.ndarray, starts: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """At each LMS place the rank of its substring; equal substrings have equal ranks."""
    length = np.zeros(len(t), dtype=np.int64)
    length[starts] = np.append(np.diff(starts), 0) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    left, most = np.flatnonzero(same), length
    step = 0
    while len(left):
        equal = t[a[left] + step] == t[b[left] + step]
        same[left[~equal]] = False
        step += 1
        left = left[equal]
        left = left[most[a[left]] > step]
    names = np.zeros(len(t), dtype=np.int64)
    names[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return names


def common_prefixes(raw: np.ndarray, array: np.ndarray, wanted: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the places ``wanted`` of a text of bytes, in text order: the place before it in the array, and
    their common prefix, counted up to ``length``, in steps of eight bytes.

    ``raw`` goes on for ``length`` bytes behind the last place.
    """
    before = np.empty(len(array), dtype=np.int64)
    before[array[1:]] = array[:-1]
    before[array[0]] = array[0]
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    other = before[wanted]
    common = np.zeros(len(wanted), dtype=np.int64)
    left = np.flatnonzero(other != wanted)
    for step in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        left = left[words[wanted[left] + step] == words[other[left] + step]]
        common[left] = step + 8
    return other, common
