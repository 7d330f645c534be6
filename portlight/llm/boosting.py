"""Boosted shallow trees over binned features, in numpy: fitted on a bounded sample, scored inside tasks."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """`bound` rows of df at most, one for each value of `key`, which hash chooses; all values where there are fewer.

    A value that fills most rows counts once, so neither the sample nor what the driver gets of it can outgrow the bound.
    """
    once = df.dropDuplicates([key])
    n = once.count()
    if n <= bound:
        return once
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    few = once.filter(place < int((1 << 30) * bound / n * 1.1) + 1)  # about a tenth more, then exactly the bound
    return few.orderBy(place, key).limit(bound)


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of at most `bins` bins of about equal counts."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


@dataclass
class Binned:
    edges: list[np.ndarray]

    @classmethod
    def of(cls, x: np.ndarray, bins: int) -> Binned:
        return cls([cut_points(x[:, j], bins) for j in range(x.shape[1])])

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def prior_of(y: np.ndarray) -> float:
    return float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))


# ---- gradient-boosted trees ----


@dataclass
class Trees:
    binned: Binned
    prior: float
    rate: float
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, cut, leaf values

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes, out = self.binned.codes(x), np.full(len(x), self.prior)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (codes[np.arange(len(x)), feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x)) if len(x) else np.zeros(0)


def fit_trees(x: np.ndarray, y: np.ndarray, bins: int = 32, depth: int = 3, rounds: int = 60, rate: float = 0.2, l2: float = 1.0) -> Trees:
    """Logistic boosting of complete trees of one depth, grown level by level on histograms of gradients."""
    binned = Binned.of(x, bins)
    codes = binned.codes(x)
    model = Trees(binned, prior_of(y), rate, depth)
    if len(np.unique(y)) < 2:
        return model
    n, k = codes.shape
    margin, rows = np.full(n, model.prior), np.arange(n)
    for _ in range(rounds):
        p = sigmoid(margin)
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, bins)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for j in range(k):
                place = (node - first) * bins + codes[:, j]
                gs = np.bincount(place, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(place, h, width * bins).reshape(width, bins).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better], feature[first : first + width][better], cut[first : first + width][better] = top[better], j, at[better]
            node = 2 * node + 1 + (codes[rows, feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        model.trees.append((feature, cut, value))
        margin += value[leaf]
    return model


# ---- additive model with pairwise interactions ----


@dataclass
class AdditiveModel:
    """score = sigmoid(prior + sum of one table entry for each feature and for each pair)."""

    binned: Binned
    prior: float
    single: list[np.ndarray]
    coarse: Binned
    pairs: list[tuple[int, int]]
    double: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        out = np.full(len(x), self.prior)
        codes = self.binned.codes(x)
        for j, table in enumerate(self.single):
            out += table[codes[:, j]]
        codes = self.coarse.codes(x)
        for (a, b), table in zip(self.pairs, self.double, strict=True):
            out += table[codes[:, a], codes[:, b]]
        return sigmoid(out)


def _best_cut(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    gl, hl = g.cumsum()[:-1], h.cumsum()[:-1]
    gt, ht = g.sum(), h.sum()
    gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
    at = int(gain.argmax()) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) else (0.0, len(g))


def _stump(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """Leaf values, by bin, of a tree of at most four leaves on one feature's histogram."""
    out, spans = np.zeros(len(g)), [(0, len(g))]
    for _ in range(2):
        spans = [s for a, b in spans for s in ([(a, a + _best_cut(g[a:b], h[a:b], l2)[1]), (a + _best_cut(g[a:b], h[a:b], l2)[1], b)] if b - a > 1 else [(a, b)])]
    for a, b in spans:
        if b > a:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def _cross(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """Leaf values, by cell, of a tree that cuts one feature of a pair and then each side by the other; and its gain."""
    best, value = -1.0, np.zeros(g.shape)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, at = _best_cut(a.sum(1), b.sum(1), l2)
        out, gain = np.zeros(a.shape), 0.0
        for rows in (slice(0, at), slice(at, None)):
            _, cut = _best_cut(a[rows].sum(0), b[rows].sum(0), l2)
            for columns in (slice(0, cut), slice(cut, None)):
                s, t = a[rows, columns].sum(), b[rows, columns].sum() + l2
                out[rows, columns], gain = s / t, gain + s * s / t
        if gain > best:
            best, value = gain, out.T if turned else out
    return value, best


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 12, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.15, l2: float = 2.0) -> AdditiveModel:
    """Boosts one shallow tree for each feature in turn, round after round, and then the pairs that gain most."""
    binned, coarse = Binned.of(x, bins), Binned.of(x, coarse_bins)
    model = AdditiveModel(binned, prior_of(y), [np.zeros(len(e) + 1) for e in binned.edges], coarse, [], [])
    if len(np.unique(y)) < 2:
        return model
    codes, margin = binned.codes(x), np.full(len(x), model.prior)
    for _ in range(rounds):
        for j, tab in enumerate(model.single):
            p = sigmoid(margin)
            step = rate * _stump(np.bincount(codes[:, j], y - p, len(tab)), np.bincount(codes[:, j], p * (1 - p), len(tab)), l2)
            tab += step
            margin += step[codes[:, j]]
    codes = coarse.codes(x)
    size = [len(e) + 1 for e in coarse.edges]

    def histogram(a: int, b: int):
        p, cell, shape = sigmoid(margin), codes[:, a] * size[b] + codes[:, b], (size[a], size[b])
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    gains = {(a, b): _cross(*histogram(a, b), l2)[1] for a, b in combinations(range(x.shape[1]), 2)}
    model.pairs = sorted(gains, key=gains.get, reverse=True)[:n_pairs]
    model.double = [np.zeros((size[a], size[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), tab in zip(model.pairs, model.double, strict=True):
            step = rate * _cross(*histogram(a, b), l2)[0]
            tab += step
            margin += step[codes[:, a], codes[:, b]]
    return model
