"""Small gradient-boosted trees, isotonic calibration and lasso logistic regression in numpy.

They are fitted on the driver from a bounded sample of dense feature rows; the result is a few kilobytes.
"""

from __future__ import annotations

import numpy as np


class Tree:
    """A binary tree in arrays: feature (-1 at leaves), threshold (go left when x <= t), value."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def add(self, value: float) -> int:
        for a, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            a.append(v)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, work = np.empty(len(x)), [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if self.feature[node] < 0:
                out[rows] = self.value[node]
            else:
                below = x[rows, self.feature[node]] <= self.threshold[node]
                work += [(self.left[node], rows[below]), (self.right[node], rows[~below])]
        return out

    def paths(self) -> list[list[tuple[int, float, bool]]]:
        """The conditions (feature, threshold, at_most) on the way to every node but the root."""
        found, work = [], [(0, [])]
        while work:
            node, way = work.pop()
            if way:
                found.append(way)
            if self.feature[node] >= 0:
                f, t = self.feature[node], self.threshold[node]
                work += [(self.left[node], [*way, (f, t, True)]), (self.right[node], [*way, (f, t, False)])]
        return found


def cut_points(x: np.ndarray, bins: int = 64) -> list[np.ndarray]:
    """Per feature the midpoints between quantiles at which a tree may split."""
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1), method="nearest")) if len(x) else np.zeros(0)
        cuts.append((q[1:] + q[:-1]) / 2)
    return cuts


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, least: int = 5, ridge: float = 1.0) -> tuple[float, list[Tree]]:
    """Newton boosting of the logistic loss over histograms.  Returns the starting log-odds and trees."""
    p = (y.sum() + 1) / (len(y) + 2)
    base, cuts = float(np.log(p / (1 - p))), cut_points(x)
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) if len(x) else np.zeros((0, x.shape[1]), int)
    f, trees = np.full(len(y), base), []
    for _ in range(rounds if len(y) else 0):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, q * (1 - q)
        tree, leaves = Tree(), []
        work = [(tree.add(0.0), np.arange(len(y)), 0)]
        while work:
            node, rows, level = work.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            tree.value[node] = rate * gs / (hs + ridge)
            best = (1e-6, None, None)
            if level < depth and len(rows) >= 2 * least:
                for j, c in enumerate(cuts):
                    if len(c):
                        b = binned[rows, j]
                        gl, hl, nl = (np.bincount(b, w, len(c) + 1)[:-1].cumsum() for w in (g[rows], h[rows], None))
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        gain[(nl < least) | (len(rows) - nl < least)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), j, k)
            if best[1] is None:
                leaves.append((node, rows))
                continue
            _, j, k = best
            below = binned[rows, j] <= k
            tree.feature[node], tree.threshold[node] = j, float(cuts[j][k])
            tree.left[node], tree.right[node] = tree.add(0.0), tree.add(0.0)
            work += [(tree.left[node], rows[below], level + 1), (tree.right[node], rows[~below], level + 1)]
        for node, rows in leaves:
            f[rows] += tree.value[node]
        trees.append(tree)
    return base, trees


def margin(base: float, trees: list[Tree], x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), base)
    for t in trees:
        out += t.predict(x)
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing knots (score, probability) for linear interpolation.
    Each block counts half a case of either class, so that no probability is 0 or 1."""
    if not len(score):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, lowest, highest score
    for s, v in zip(score[order], y[order], strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, _, hi = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
            blocks[-1][3] = hi
    xs, ps = [], []
    for v, n, lo, hi in blocks:
        p = (v + 0.5) / (n + 1)
        for e in dict.fromkeys((lo, hi)):
            xs.append(e)
            ps.append(p)
    return np.array(xs), np.maximum.accumulate(np.array(ps))


def lasso_logistic(x: np.ndarray, y: np.ndarray, l1: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the mean logistic loss plus l1 times the weights' sum."""
    n, k = x.shape
    w, b = np.zeros(k), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    step = 4.0 / (1 + float(np.linalg.norm(x, 2) ** 2 / max(n, 1))) if n and k else 1.0
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps if n else 0):
        r = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y
        w2 = v - step * (x.T @ r) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * l1, 0)
        b2, t2 = c - step * r.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w
