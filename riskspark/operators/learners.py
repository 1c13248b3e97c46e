"""The gate's classifiers over one training table of a few thousand days: what a task runs for one date and member."""

from __future__ import annotations

import numpy as np

BINS = 32


def l1_logistic(x: np.ndarray, y: np.ndarray, c: float = 0.1, steps: int = 500) -> tuple[np.ndarray, float]:
    """Weights and constant that minimise |w| + c * (sum of log losses), by accelerated proximal steps; the constant is free."""
    z = np.hstack([x, np.ones((len(x), 1))])
    size = 4.0 / (c * max(1e-12, np.linalg.eigvalsh(z.T @ z)[-1]))
    w = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -500, 500)))
        new = v - size * c * (z.T @ (p - y))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, done = new + (t - 1) / s * (new - w), np.abs(new - w).max() < 1e-9
        w, t = new, s
        if done:
            break
    return w[:-1], float(w[-1])


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Per column the values that part its bins: a value belongs to the bin of as many edges as lie below it."""
    return [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)


class Boosted:
    """Trees of log-loss gradients: splits by squared gradient sums over bins, leaves by one Newton step, ties to the first feature and bin."""

    def __init__(self, trees: int = 100, depth: int = 3, rate: float = 0.05, bins: int = BINS, least: int = 1):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = edges_of(x, self.bins)
        b, k = binned(x, self.edges), x.shape[1]
        mean = np.clip(y.mean(), 1e-9, 1 - 1e-9)
        self.start, self.made = float(np.log(mean / (1 - mean))), []
        f = np.full(len(y), self.start)
        cell = b + np.arange(k) * self.bins  # a row's place in each feature's histogram
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), np.int64), {}
            for level in range(self.depth):
                n = 1 << level
                at = (node[:, None] * k * self.bins + cell).ravel()
                size = n * k * self.bins
                shape = (n, k, self.bins)
                gs = np.bincount(at, np.repeat(g, k), size).reshape(shape).cumsum(axis=2)
                ns = np.bincount(at, minlength=size).reshape(shape).cumsum(axis=2)
                g_all, n_all = gs[:, :1, -1:], ns[:, :1, -1:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = gs**2 / ns + (g_all - gs) ** 2 / (n_all - ns) - g_all**2 / n_all
                gain[(ns < self.least) | (n_all - ns < self.least)] = -np.inf
                gain = np.round(gain.reshape(n, -1), 12)
                best = gain.argmax(axis=1)
                for j in range(n):
                    splits[level, j] = divmod(int(best[j]), self.bins) if gain[j, best[j]] > 1e-12 else (0, self.bins)
                feature, cut = (np.array([splits[level, j][i] for j in range(n)]) for i in (0, 1))
                node = 2 * node + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / np.maximum(np.bincount(node, h, leaves), 1e-12)
            f = f + value[node]
            self.made.append((splits, value))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        b, f = binned(x, self.edges), np.full(len(x), self.start)
        for splits, value in self.made:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                feature, cut = (np.array([splits[level, j][i] for j in range(1 << level)]) for i in (0, 1))
                node = 2 * node + (b[np.arange(len(x)), feature[node]] > cut[node])
            f = f + value[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (scores, values) of the rising step means of y over score; np.interp() reads them."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, rows, first and last score
    for s, v in zip(score[order], y[order], strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([float(v), 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    return xs, np.array([v for b in blocks for v in (b[0] / b[1],) * 2])
