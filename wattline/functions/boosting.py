"""Boosted histogram trees in numpy, for fits that run side by side as Spark tasks.

Features are bin numbers; bin 0 holds missing values. A tree grows level by level: per open node one histogram of
gradients and counts over (feature, bin), of which only the smaller child of each split is counted, the other is the
parent less it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def bin_numbers(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """(rows, features) bin numbers: 0 for missing values, else 1 + the number of cuts at or below the value."""
    out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
    for j, (x, c) in enumerate(zip(columns, cuts, strict=True)):
        out[:, j] = np.where(np.isnan(x), 0, 1 + np.searchsorted(c, x, side="right"))
    return out


def _histograms(flat: np.ndarray, rows: np.ndarray, slot: np.ndarray, slots: int, width: int, weights: Sequence[np.ndarray | None]) -> np.ndarray:
    """[weight, slot, width] sums over the rows; ``flat`` holds each row's (feature, bin) cells."""
    cells = (flat[rows] + (slot * width)[:, None]).ravel()
    per_row = flat.shape[1]
    return np.stack([np.bincount(cells, None if w is None else np.repeat(w[rows], per_row), slots * width).reshape(slots, width) for w in weights])


def grow_tree(flat: np.ndarray, bins: int, features: int, grad: np.ndarray, hess: np.ndarray | None, depth: int, leaf: int, l2: float, step: float) -> dict[str, np.ndarray]:
    """One tree as a heap: feature (-1: leaf), last bin that goes left, value, gain; children of i are 2i+1 and 2i+2."""
    n, size, width = len(grad), 2 ** (depth + 1) - 1, features * bins
    tree = {"feature": np.full(size, -1, np.int16), "bin": np.zeros(size, np.uint8), "value": np.zeros(size), "gain": np.zeros(size)}
    weights = (grad, hess, None) if hess is not None else (grad, None)
    rows, node, slot = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_nodes = np.array([0])
    hist = _histograms(flat, rows, slot, 1, width, weights)
    for level in range(depth + 1):
        cut = hist.reshape(len(weights), len(open_nodes), features, bins)
        g, h, c = cut[0], cut[1], cut[-1]  # a squared loss has a curvature of 1 per row
        total = [x[:, 0].sum(axis=1) for x in (g, h, c)]
        tree["value"][open_nodes] = step * total[0] / (total[1] + l2 + 1e-12)
        if level == depth:
            break
        gl, hl, cl = (np.cumsum(x, axis=2)[:, :, :-1] for x in (g, h, c))
        gr, hr, cr = (t[:, None, None] - x for t, x in zip(total, (gl, hl, cl), strict=True))
        fit = (cl >= leaf) & (cr >= leaf)
        own = total[0] ** 2 / (total[1] + l2 + 1e-12)
        gain = np.where(fit, gl**2 / (hl + l2 + 1e-12) + gr**2 / (hr + l2 + 1e-12), -np.inf).reshape(len(open_nodes), -1)
        best = gain.argmax(axis=1)
        worth = gain[np.arange(len(best)), best] - own
        split = np.flatnonzero(worth > 1e-9 * (1 + own))
        if not len(split):
            break
        at = open_nodes[split]
        feature, last = best[split] // (bins - 1), best[split] % (bins - 1)
        tree["feature"][at], tree["bin"][at], tree["gain"][at] = feature, last, worth[split]
        # rows of the split nodes go down
        place = np.full(len(open_nodes), -1)
        place[split] = np.arange(len(split))
        down = place[slot] >= 0
        rows, of = rows[down], place[slot[down]]
        right = flat[rows, feature[of]] - feature[of] * bins > last[of]
        node = 2 * at[of] + 1 + right
        open_nodes = np.stack([2 * at + 1, 2 * at + 2], axis=1).ravel()
        slot = 2 * of + right
        if level + 1 == depth:  # leaves need their totals only
            sums = [np.bincount(slot, None if w is None else w[rows], len(open_nodes)) for w in weights]
            tree["value"][open_nodes] = step * sums[0] / (sums[1] + l2 + 1e-12)
            break
        counts = np.bincount(slot, minlength=len(open_nodes)).reshape(-1, 2)
        small = counts.argmin(axis=1)
        counted = right == small[of]
        part = _histograms(flat, rows[counted], of[counted], len(split), width, weights)
        pair = np.empty((len(weights), len(split), 2, width))
        pair[:, np.arange(len(split)), small] = part
        pair[:, np.arange(len(split)), 1 - small] = hist[:, split] - part
        hist = pair.reshape(len(weights), len(open_nodes), width)
    return tree


def drop_through(tree: dict[str, np.ndarray], binned: np.ndarray) -> np.ndarray:
    """The tree's value for each row."""
    node = np.zeros(len(binned), np.int64)
    inner = np.flatnonzero(tree["feature"][node] >= 0)
    while len(inner):
        at = node[inner]
        node[inner] = 2 * at + 1 + (binned[inner, tree["feature"][at]] > tree["bin"][at])
        inner = inner[tree["feature"][node[inner]] >= 0]
    return tree["value"][node]


def _chance(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -500, 500)))


class Booster:
    """A start value and trees; ``classes``: the sum is a log-odds, and the prediction a probability."""

    def __init__(self, base: float, classes: bool, constant: float | None = None):
        self.base, self.classes, self.constant = base, classes, constant
        self.trees: list[dict[str, np.ndarray]] = []

    def predict(self, binned: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(binned), self.constant)
        total = np.full(len(binned), self.base)
        for tree in self.trees:
            total += drop_through(tree, binned)
        return _chance(total) if self.classes else total

    def importances(self, features: int) -> np.ndarray:
        """Each feature's share of the gains."""
        out = np.zeros(features)
        for tree in self.trees:
            inner = tree["feature"] >= 0
            np.add.at(out, tree["feature"][inner], tree["gain"][inner])
        return out / out.sum() if out.sum() > 0 else out


def loss_of(prediction: np.ndarray, y: np.ndarray, classes: bool) -> float:
    """Mean absolute error, or mean squared error of a probability."""
    gap = prediction - y
    return float((gap * gap).mean() if classes else np.abs(gap).mean())


def fit(binned: np.ndarray, y: np.ndarray, val_binned: np.ndarray, val_y: np.ndarray, bins: int, classes: bool, depth: int, leaf: int, rounds: int, step: float = 0.05, l2: float = 0.0, patience: int | None = None) -> tuple[Booster, list[float]]:
    """A booster and its loss after 0, 1, 2, … trees on the validation rows (the training rows if there are none).

    With validation rows the trees after the lowest loss are dropped, and the fit ends once ``patience`` rounds in a row
    brought no lower one. Labels that are all equal give a constant.
    """
    staged = len(val_y) > 0
    check, truth = (val_binned, val_y) if staged else (binned, y)
    if not len(y) or (classes and y.min() == y.max()):
        model = Booster(0.0, classes, float(y[0]) if len(y) else 0.0)
        return model, [loss_of(model.predict(check), truth, classes) if len(truth) else float("inf")]
    mean = float(y.mean())
    model = Booster(float(np.log(mean / (1 - mean))) if classes else mean, classes)
    features = binned.shape[1]
    flat = binned.astype(np.int64) + np.arange(features) * bins
    score, seen = np.full(len(y), model.base), np.full(len(truth), model.base)
    losses = [loss_of(_chance(seen) if classes else seen, truth, classes)]
    for _ in range(rounds):
        p = _chance(score) if classes else score
        tree = grow_tree(flat, bins, features, y - p, p * (1 - p) if classes else None, depth, leaf, l2, step)
        model.trees.append(tree)
        score = score + drop_through(tree, binned)
        seen = seen + drop_through(tree, check) if staged else score
        losses.append(loss_of(_chance(seen) if classes else seen, truth, classes))
        if tree["feature"][0] < 0 or (staged and patience is not None and len(losses) - 1 - int(np.argmin(losses)) >= patience):
            break
    if staged:
        model.trees = model.trees[: int(np.argmin(losses))]
    return model, losses
