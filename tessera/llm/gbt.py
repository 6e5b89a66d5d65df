"""Gradient-boosted trees for two classes with monotonic constraints, as flat numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All trees in one set of node arrays; a leaf is its own child. Scoring walks all trees of all rows at once."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), block):
            part = x[at : at + block]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                go_left = part[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(go_left, self.left[node], self.right[node])
            out[at : at + block] = self.base + self.value[node].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


@dataclass
class _Nodes:
    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def add(self) -> int:
        at = len(self.value)
        for column, start in ((self.feature, 0), (self.threshold, np.inf), (self.left, at), (self.right, at), (self.value, 0.0)):
            column.append(start)
        return at


def fit_trees(
    x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], *, trees: int = 60, depth: int = 3, rate: float = 0.15,
    bins: int = 48, l2: float = 2.0, min_rows: int = 15,
) -> Trees:
    """Logistic boosting on quantile bins. ``monotone``: for each feature 1 (the score may only rise with it), -1 or 0.

    A split on a constrained feature is taken only if its children's values keep the order, and the
    children's subtrees are held to their side of the middle, so the constraint holds for whole trees and
    their sum. Without rows of both classes the score is the (smoothed) share of class 1.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    nodes, roots = _Nodes(), []
    if 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            gain = np.zeros(len(y))
            roots.append(_grow(nodes, codes, cuts, p - y, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), depth, (-np.inf, np.inf), monotone, rate, l2, min_rows, gain))
            margin += gain
    as_array = {k: np.array(v, dtype=np.int32 if k in ("feature", "left", "right") else np.float64) for k, v in vars(nodes).items()}
    return Trees(**as_array, roots=np.array(roots, np.int32), depth=depth, base=base)


def _grow(nodes, codes, cuts, g, h, rows, depth, bounds, monotone, rate, l2, min_rows, gain) -> int:
    at = nodes.add()
    best = _best_split(codes[rows], cuts, g[rows], h[rows], bounds, monotone, l2, min_rows) if depth and len(rows) >= 2 * min_rows else None
    if best is None:
        nodes.value[at] = rate * float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), *bounds))
        gain[rows] = nodes.value[at]
        return at
    f, cut, low, high = best
    left = codes[rows, f] <= cut
    middle, below, above = (low + high) / 2, bounds, bounds
    if monotone[f]:
        below, above = (bounds[0], middle), (middle, bounds[1])
        if monotone[f] < 0:
            below, above = above, below
    nodes.feature[at], nodes.threshold[at] = f, float(cuts[f][cut])
    args = (monotone, rate, l2, min_rows, gain)
    nodes.left[at] = _grow(nodes, codes, cuts, g, h, rows[left], depth - 1, below, *args)
    nodes.right[at] = _grow(nodes, codes, cuts, g, h, rows[~left], depth - 1, above, *args)
    return at


def _best_split(codes, cuts, g, h, bounds, monotone, l2, min_rows):
    found, most = None, 1e-6
    score = lambda gs, hs, w: -(gs * w + 0.5 * (hs + l2) * w * w)
    value = lambda gs, hs: np.clip(-gs / (hs + l2), *bounds)
    whole = score(g.sum(), h.sum(), value(g.sum(), h.sum()))
    for f, cut in enumerate(cuts):
        n = len(cut) + 1
        if n < 2:
            continue
        gs, hs, count = (np.bincount(codes[:, f], w, n)[:-1].cumsum() for w in (g, h, np.ones(len(g))))
        gr, hr = g.sum() - gs, h.sum() - hs
        low, high = value(gs, hs), value(gr, hr)
        better = score(gs, hs, low) + score(gr, hr, high) - whole
        better[(count < min_rows) | (len(g) - count < min_rows)] = -np.inf
        if monotone[f]:
            better[(high - low) * monotone[f] < 0] = -np.inf
        k = int(np.argmax(better))
        if better[k] > most:
            most, found = better[k], (f, k, float(low[k]), float(high[k]))
    return found
