"""A k2-treap (k = 2) over a grid of terms and documents, and ranked search in it.

The grid is cut into quarters again and again. A cell that holds a point has a node with the
highest value of its points; empty cells have none. Nodes are stored level by level: four bits for the
children of each, and each child's value as what its parent's value is above it, which is small. A term is a row,
so it follows one path of row halves; a search goes down the paths of all its terms together, over one
range of documents at a time, the most promising first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Ranges of documents that a search opens at once.
FRONT = 256
_COUNT = np.array([bin(i).count("1") for i in range(16)], dtype=np.int8)
# Set bits of a mask below a child's own.
_BELOW = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], dtype=np.int32)


def spread(x: np.ndarray) -> np.ndarray:
    """The low 32 bits of each number at the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


def small(values: np.ndarray) -> np.ndarray:
    """The same numbers, none below zero, in the narrowest type that holds them."""
    top = int(values.max(initial=0))
    return values.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(t).max))


@dataclass
class Treap:
    """Masks of all nodes above the leaves, and the values of all nodes, below 2^31, from the root down."""

    height: int
    masks: np.ndarray
    values: np.ndarray

    @staticmethod
    def build(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> Treap:
        """From points that differ in row or column; there must be one at least."""
        height = max(1, int(max(rows.max(), columns.max())).bit_length())
        code = spread(rows) << np.uint64(1) | spread(columns)
        order = np.argsort(code)
        code, best = code[order], values[order].astype(np.int32)
        masks, levels = [], [best]
        for _ in range(height):
            parent = code >> np.uint64(2)
            first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            masks.append(np.bitwise_or.reduceat(np.left_shift(1, (code & np.uint64(3)).astype(np.int64)), first).astype(np.uint8))
            best = np.maximum.reduceat(best, first)
            levels.append(best)
            code = parent[first]
        return Treap(height, np.concatenate(masks[::-1]), np.concatenate(levels[::-1]))

    def packed(self) -> tuple[bytes, bytes, int]:
        """Two masks to a byte; the root's value and then what each node lacks of its parent's, first bytes first; bytes of one such number."""
        masks = np.append(self.masks, np.zeros(len(self.masks) % 2, dtype=np.uint8))
        below = np.repeat(self.values[: len(self.masks)], _COUNT[self.masks]) - self.values[1:]
        lacks = small(below)
        return (masks[::2] | masks[1::2] << 4).tobytes(), self.values[:1].astype("<u8").tobytes() + lacks.view(np.uint8).reshape(-1, lacks.itemsize).T.tobytes(), lacks.itemsize

    @staticmethod
    def unpacked(height: int, masks: bytes, values: bytes, width: int) -> Treap:
        both = np.frombuffer(masks, dtype=np.uint8)
        every = np.stack([both & 15, both >> 4], axis=1).ravel()
        every = every[: len(every) - (every[-1] == 0)]  # a node above the leaves has a child
        lacks = np.ascontiguousarray(np.frombuffer(values, dtype=np.uint8, offset=8).reshape(width, -1).T).view(f"<u{width}").ravel()
        found = np.empty(1 + len(lacks), dtype=np.int32)
        found[0] = np.frombuffer(values, dtype="<u8", count=1)[0]
        # Level by level, as a node needs its parent's value.
        counts = _COUNT[every]
        node, end = 0, 1
        while node < len(every):
            upto = min(end, len(every))
            children = int(counts[node:upto].sum(dtype=np.int64))
            found[end : end + children] = np.repeat(found[node:upto], counts[node:upto]) - lacks[end - 1 : end - 1 + children].astype(np.int32)
            node, end = upto, end + children
        return Treap(height, every, found)

    def __post_init__(self) -> None:
        counts = _COUNT[self.masks]
        self.first_child = (1 + np.cumsum(counts, dtype=np.int64) - counts).astype(np.int32)

    def child(self, nodes: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        """The child of each node in a quarter; -1 where there is none."""
        safe = np.maximum(nodes, 0)
        mask = self.masks[safe]
        there = (nodes >= 0) & (mask >> quarter.astype(np.uint8) & 1 == 1)
        return np.where(there, self.first_child[safe] + _BELOW[mask, quarter], -1)

    def search(self, rows: np.ndarray, weights: np.ndarray, most: int, names: np.ndarray, least: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        """The ``most`` best (score, column), the highest first, equal ones by name.

        A column's score is the sum of its values in ``rows`` times ``weights``; only scores above 0 count. ``names``
        ascend with the columns. With ``least``, a (score, name) that is good enough elsewhere, what ranks after it may be left out.
        """
        live = weights > 0
        rows, weights = rows[live], weights[live].astype(np.int64)
        if not len(rows):
            return []
        floor = least or (0, np.iinfo(np.int64).max)
        # Open ranges: bound, level, first column, and each term's node.
        nodes = np.zeros((1, len(rows)), dtype=np.int32)
        bound = (self.values[nodes] * weights).sum(axis=1)
        level, column = np.array([self.height]), np.array([0])
        found: list[tuple[int, int]] = []
        while len(bound):
            worth = (bound > 0) & ((bound > floor[0]) | ((bound == floor[0]) & (names[np.minimum(column, len(names) - 1)] <= floor[1])))
            if not worth.all():
                bound, level, column, nodes = bound[worth], level[worth], column[worth], nodes[worth]
                if not len(bound):
                    break
            if len(bound) > FRONT:
                # The highest bounds first; of equal ones the first columns, so that ties end early.
                order = np.lexsort((column, -bound))
                now, later = order[:FRONT], order[FRONT:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, dtype=np.int64)
            leaf = level[now] == 0
            if leaf.any():
                found += zip(bound[now[leaf]].tolist(), column[now[leaf]].tolist())
                found.sort(key=lambda x: (-x[0], x[1]))
                del found[most:]
                if len(found) == most:
                    mine = (found[-1][0], int(names[found[-1][1]]))
                    floor = max(floor, mine, key=lambda x: (x[0], -x[1]))
            wide = now[~leaf]
            parts = [(bound[later], level[later], column[later], nodes[later])]
            if len(wide):
                below = level[wide] - 1
                row_half = rows[None, :] >> below[:, None] & 1
                for half in (0, 1):
                    some = self.child(nodes[wide], row_half << 1 | half)
                    value = np.where(some >= 0, self.values[np.maximum(some, 0)], 0)
                    parts.append(((value * weights).sum(axis=1), below, column[wide] | half << below, some))
            bound, level, column, nodes = (np.concatenate(x) for x in zip(*parts))
        return found
