"""Plain versions of the operators for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> set:
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(5)]))


def near_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest linked id)."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    having = defaultdict(list)
    for i, s in sets.items():
        for one in s:
            having[one].append(i)
    both = Counter()
    for ids in having.values():
        for k, b in enumerate(ids):
            for a in ids[:k]:
                both[a, b] += 1
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def removed(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (bytes, removed bytes, runs, digest of the rest)."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - 99):
            window = raw[p : p + 100]
            if window in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(window)
        rest = bytes(b for b, c in zip(raw, covered) if not c)
        runs = sum(1 for p in range(len(raw)) if covered[p] and (p == 0 or not covered[p - 1]))
        out[i] = len(raw), sum(covered), runs, hashlib.sha256(rest).hexdigest()
    return out


def exact_kept(rows: list[tuple[int, str | None]]) -> list[int]:
    """The ids that exact deduplication keeps."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return sorted(min(g)[1] for g in groups.values())


def packed_right(rows, capacity: int = 4096) -> int:
    """Check that pieces lie in their sequences without gaps or overlaps; the number of sequences."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for cut in by_doc.values():
        at = 0
        for n, (piece, start, length) in enumerate(sorted(cut)):
            assert (piece, start) == (n, at)
            at += length
            assert length == capacity or n == len(cut) - 1
    return len(by_sequence)
