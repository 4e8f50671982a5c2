"""Word shingles as 64-bit sets, and PartEnum signatures of such sets.

Sets are grouped into bands of sizes so that similar sets lie in the same or neighbouring bands. For
each band there is one instance of the scheme, whose Hamming distance ``k`` no similar pair of it
exceeds. The domain (all 64-bit values) is cut into groups, and each group into three parts. If every
group held two differences or more, there would be more than ``k``; so in one group of the
first ``k // 2 + 1`` at most one part differs, and one of its three subsets of two parts is the same
in both sets. The signatures are hashes of these subsets. Small distances use one group of ``k + 2``
parts, of which two at least agree, and all subsets of two.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np

from shoplight.llm.common import mix

WORDS = 5
# Similar: 100 times the intersection is 80 times the union or more.
SIMILAR, OF = 80, 100
# Bytes from which a word is known by a digest.
LONG_WORD = 64
SMALL = 4  # largest distance of the one-group scheme

_WORD_SPACE = np.zeros(256, dtype=bool)
_WORD_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACES = mix(np.arange(1, WORDS + 2, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, dtype=np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts in turn, A-Z lowered, and how many words each text has."""
    padded = [b" " + t.lower() for t in texts]
    raw = np.frombuffer(b"".join([*padded, b" "]), dtype=np.uint8)
    space = _WORD_SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), out=total[1:])
    words = mix((total[ends] - total[starts]) * _powers(_INVERSE, len(raw))[starts])
    # Sums of powers can be equal for long words that differ by design; these get a digest.
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        words[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    bounds = np.cumsum([0, *map(len, padded)])
    return words, np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's set of word shingles, sorted; of a text with fewer words its whole sequence, if any."""
    words, counts = word_hashes(texts)
    most = len(words) - WORDS + 1
    runs = np.zeros(0, dtype=np.uint64)
    if most > 0:
        runs = words[:most] * _PLACES[0]
        for i in range(1, WORDS):
            runs = runs + words[i : i + most] * _PLACES[i]
        runs = mix(runs)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            sets.append(np.unique(runs[at : at + n - WORDS + 1]))
        elif n:
            sets.append(mix((words[at : at + n] * _PLACES[:n]).sum(keepdims=True) + np.uint64(n * int(_PLACES[WORDS]) % 2**64)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
        at += n
    return sets


def band_ends(largest: int) -> np.ndarray:
    """The largest size of each band, from size 1: a similar set of any set of band i is in band i + 1 at most."""
    ends, low = [], 1
    while not ends or ends[-1] < largest * OF // SIMILAR + 1:
        ends.append(low * OF // SIMILAR)
        low = ends[-1] + 1
    return np.array(ends, dtype=np.int64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest Hamming distance of similar sets of these sizes."""
    return (OF - SIMILAR) * (a + b) // (OF + SIMILAR)


def instances(sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For a set's own band and the next one: instance, its distance, and the set's own largest distance in it.

    The last is 0 where the set has no similar one but its equals.
    """
    ends = band_ends(int(sizes.max(initial=1)))
    band = np.searchsorted(ends, sizes)
    largest = sizes * OF // SIMILAR
    chosen = []
    for step in (0, 1):
        own = distance(sizes, np.minimum(largest, ends[band + step]))
        if step:
            own = np.where(largest > ends[band], own, 0)
        chosen.append((band + step, distance(ends[band + step], ends[band + step]), np.where(sizes > 0, own, 0)))
    return chosen


def _salt(instance: np.ndarray, group: np.ndarray, subset: np.ndarray) -> np.ndarray:
    packed = instance.astype(np.uint64) << np.uint64(48) | group.astype(np.uint64) << np.uint64(8) | subset.astype(np.uint64)
    return mix(packed + np.uint64(0x5851F42D4C957F2D))


def _part_sums(values: np.ndarray, sizes: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum and count of the values in each part of each set's equal cut of the domain, and where each set's parts begin.

    Values are sorted within a set, so that parts are runs.
    """
    first = np.concatenate([[0], np.cumsum(parts)])
    of = np.repeat(first[:-1], sizes) + ((values >> np.uint64(32)) * np.repeat(parts, sizes).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    sums = np.zeros(first[-1], dtype=np.uint64)
    counts = np.zeros(first[-1], dtype=np.int64)
    if len(values):
        sums[of[starts]] = np.add.reduceat(mix(values ^ np.uint64(0xA0761D6478BD642F)), starts)
        counts[of[starts]] = np.diff(starts, append=len(of))
    return sums, counts, first


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of all sets, and the number of the set that each belongs to."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    found, owners = [], []
    for instance, k, own in instances(sizes):
        for small in (True, False):
            chosen = np.flatnonzero((own > 0) & ((k <= SMALL) == small))
            if not len(chosen):
                continue
            values = np.concatenate([sets[i] for i in chosen])
            make = _small_signatures if small else _group_signatures
            signature, owner = make(values, sizes[chosen], instance[chosen], k[chosen], own[chosen])
            found.append(signature)
            owners.append(chosen[owner])
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found), np.concatenate(owners)


def _small_signatures(values, sizes, instance, k, own):  # noqa: ANN001, ANN202
    sums, _, first = _part_sums(values, sizes, k + 2)
    found, owners = [], []
    for distance_of in np.unique(k):
        mine = np.flatnonzero(k == distance_of)
        for subset, (a, b) in enumerate(combinations(range(int(distance_of) + 2), 2)):
            total = sums[first[mine] + a] + sums[first[mine] + b]
            found.append(mix(total + _salt(instance[mine], np.zeros_like(mine), np.full_like(mine, subset + 1))))
            owners.append(mine)
    return np.concatenate(found), np.concatenate(owners)


def _group_signatures(values, sizes, instance, k, own):  # noqa: ANN001, ANN202
    """A set gives the subsets of its first groups, as many as hold ``own // 2 + 1`` groups without an empty subset.

    Of a similar pair, take the set with fewer groups: one of those groups has one difference at most, and the
    subset that agrees is not empty in it, nor then in the other set, which gives that group too. A set
    with too few such groups gives all its groups, with their empty subsets.
    """
    groups = k // 2 + 1 + np.maximum(1, -(-6 * (k // 2) // 100))
    sums, counts, first = _part_sums(values, sizes, 3 * groups)
    sums, counts = sums.reshape(-1, 3), counts.reshape(-1, 3)
    first = first // 3
    left = counts.sum(axis=1, keepdims=True) - counts
    good = (left > 0).all(axis=1)
    owner = np.repeat(np.arange(len(sizes)), groups)
    before = np.concatenate([[0], np.cumsum(good)])
    rank = before[:-1] - before[first[:-1]][owner]
    need = own // 2 + 1
    lacking = before[first[1:]] - before[first[:-1]] < need
    given = (rank < need[owner]) | lacking[owner]
    given = given[:, None] & ((left > 0) | lacking[owner][:, None])
    row, subset = np.nonzero(given)
    total = sums.sum(axis=1, dtype=np.uint64)[row] - sums[row, subset]
    return mix(total + _salt(instance[owner[row]], row - first[:-1][owner[row]], subset)), owner[row]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= SIMILAR * (len(a) + len(b) - both)
