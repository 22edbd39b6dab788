"""A vantage-point tree over fingerprints in Hamming distance, for exact pairs within a radius.

Arrays of fingerprints have the shape (n, words) and hold 64 bits a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A set of at most so many fingerprints is compared outright.
SMALL = 1024


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of ``a`` and the one fingerprint ``b``."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int32)


@dataclass
class Node:
    """Inside: distance to ``point`` at most ``radius``. A leaf has only a number."""

    point: np.ndarray | None = None
    radius: int = 0
    inner: Node | None = None
    outer: Node | None = None
    leaf: int = 0


def build(sample: np.ndarray, leaf_size: int, seed: int = 1) -> tuple[Node, int]:
    """A tree whose leaves hold ``leaf_size`` of the sample or fewer, and its number of leaves.

    The vantage point is, of five of the set, the one whose distances vary most; the
    radius is their median. A set without a split stays a leaf.
    """
    rng, leaves = np.random.default_rng(seed), 0

    def grow(rows: np.ndarray) -> Node:
        nonlocal leaves
        best = None
        if len(rows) > leaf_size:
            for i in rng.choice(len(rows), min(5, len(rows)), replace=False):
                d = distances(rows, rows[i])
                t = int(np.median(d))
                if t >= d.max():  # half of them or more are as far as any
                    t = int(d[d < t].max()) if (d < t).any() else -1
                if t >= 0 and (best is None or d.var() > best[0]):
                    best = (d.var(), rows[i], t, d)
        if best is None:
            leaves += 1
            return Node(leaf=leaves - 1)
        _, point, t, d = best
        return Node(point, t, grow(rows[d <= t]), grow(rows[d > t]))

    return grow(sample), leaves


def route(root: Node, rows: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home) of each leaf that a row belongs to or visits.

    A row that is at home belongs to one leaf. Where two rows within ``radius`` of each
    other part, the inner one is at least at radius + 1 - ``radius`` and visits the outer side
    as well. A visitor goes on to each side that the triangle inequality doesn't rule
    out. So any two rows at home within ``radius`` of each other meet in a leaf in which
    one of them is at home; rows that come as visitors meet all those at home.
    """
    out: list[tuple[np.ndarray, int, np.ndarray]] = []

    def down(node: Node, at: np.ndarray, h: np.ndarray) -> None:
        if not len(at):
            return
        if node.point is None:
            out.append((at, node.leaf, h))
            return
        d = distances(rows[at], node.point)
        inner = np.where(h, d <= node.radius, d <= node.radius + radius)
        outer = np.where(h, d > node.radius, d > node.radius - radius)
        band = h & (d <= node.radius) & (d > node.radius - radius)
        down(node.inner, at[inner], h[inner])
        down(node.outer, np.concatenate([at[outer], at[band]]), np.concatenate([h[outer], np.zeros(band.sum(), bool)]))

    down(root, np.arange(len(rows)), home)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate([a for a, _, _ in out]), np.concatenate([np.full(len(a), leaf) for a, leaf, _ in out]), np.concatenate([h for _, _, h in out])


#: Links that are held before labels follow them.
HELD = 1 << 20


class Labels:
    """Groups of linked rows; label: the least row of a group, once settle() has followed the links so far.

    Links wait until there are many: roots are then hooked to lesser ones, all at once, and paths halved, in a few passes over the rows.
    """

    def __init__(self, n: int):
        self.label, self.links, self.held = np.arange(n), [], 0

    def link(self, row: int, others: np.ndarray) -> None:
        self.links.append(np.stack([np.full(len(others), row), others]))
        self.held += len(others)
        if self.held >= HELD:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.links:
            a, b = np.concatenate(self.links, 1)
            self.links, self.held = [], 0
            while True:
                x, y = self.label[a], self.label[b]
                open_ = x != y
                if not open_.any():
                    break
                a, b, x, y = a[open_], b[open_], x[open_], y[open_]
                np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
                while ((further := self.label[self.label]) != self.label).any():
                    self.label = further
        return self.label


def link_near(rows: np.ndarray, home: np.ndarray, radius: int, labels: Labels | None = None, names: np.ndarray | None = None, depth: int = 0) -> np.ndarray:
    """Label rows so that any two within ``radius`` of each other, one of them at home, have the
    same label. A large set is parted by a tree of its own first."""
    names = np.arange(len(rows)) if names is None else names
    labels = labels or Labels(len(rows))
    mine = np.flatnonzero(home)
    if len(mine) > SMALL and depth < 40:
        root, leaves = build(rows[mine] if len(mine) <= 4 * SMALL else rows[mine[:: len(mine) // (4 * SMALL) + 1]], SMALL // 2, depth)
        if leaves > 1:
            at, leaf, h = route(root, rows, home, radius)
            order = np.argsort(leaf, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1)
            if sum(len(p) * int(h[p].sum()) for p in parts) < 0.8 * len(rows) * len(mine):
                for p in parts:
                    link_near(rows[at[p]], h[p], radius, labels, names[at[p]], depth + 1)
                return labels.settle()
    visitors = np.flatnonzero(~home)
    ordered = np.concatenate([mine, visitors])
    sorted_rows, sorted_names = rows[ordered], names[ordered]
    step = max(1, (1 << 21) // max(1, len(rows)))
    for begin in range(0, len(mine), step):
        block = sorted_rows[begin : begin + step]
        rest = sorted_rows[begin:]
        near = np.bitwise_count(block[:, None, 0] ^ rest[None, :, 0]).astype(np.int16)
        for k in range(1, rows.shape[1]):  # a wide radius lets no single word rule a pair out
            near += np.bitwise_count(block[:, None, k] ^ rest[None, :, k])
        near = near <= radius
        for i in np.flatnonzero(near.sum(1) > 1):
            labels.link(int(sorted_names[begin + i]), sorted_names[begin + np.flatnonzero(near[i])])
    return labels.settle()
