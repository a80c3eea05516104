"""Gradient-boosted trees on a panel: a training window is fitted by one task, or in pieces if it is long, to the same trees.

Sums of residuals are exact: residuals are whole multiples of a power of two, ``unit``. So a tree depends neither on the
order of the rows nor on how they are dealt out, and each row is drawn for a tree by its own key.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a feature are cut into so many bins.
BINS = 64
#: The shares of a window's rows below its thresholds.
SHARES = np.linspace(0, 1, BINS + 1)[1:-1]


def unit(n: int, most: float) -> float:
    """The power of two that ``n`` values of at most ``most`` are counted in: sums of 16 times as much are exact."""
    return math.ldexp(1.0, math.frexp(16.0 * n * most)[1] - 53) if most else 1.0


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins by feature and row: the number of thresholds a value is over."""
    return np.stack([np.searchsorted(own, c, "left") for own, c in zip(cuts, x.T)]).astype(np.uint8)


def drawn(keys: np.ndarray, t: int, c) -> np.ndarray:
    """Whether each row is in the share that tree ``t`` learns from (stochastic boosting), by its key alone."""
    z = keys.astype(np.int64).view(np.uint64) + np.random.SeedSequence((c.seed, t)).generate_state(1, np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) >> np.uint64(11) < c.subsample * 2**53


class Tree:
    """A tree that grows by levels. Node i has the children 2i + 1 and 2i + 2; ``feature`` is -1 at leaves; values are in units."""

    def __init__(self, t: int, k: int, c):
        size = 2 ** (c.depth + 1) - 1
        self.depth, self.step, self.open = c.depth, c.step, True
        self.features = np.sort(np.random.default_rng((c.seed, t)).choice(k, max(1, round(c.subsample * k)), replace=False))
        self.feature, self.bin = np.full(size, -1), np.zeros(size, int)
        self.total, self.rows = np.zeros(size), np.zeros(size)

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node each row comes to in so many levels."""
        at = np.zeros(bins.shape[1], np.min_scalar_type(len(self.feature)))
        for i in np.flatnonzero(self.feature[: 2**levels - 1] >= 0):  # parents come first
            at += (at == i) * (at.dtype.type(i + 1) + (bins[self.feature[i]] > self.bin[i]))
        return at

    def sums(self, bins: np.ndarray, rest: np.ndarray, own: np.ndarray, level: int) -> np.ndarray:
        """Sums of residuals, and counts, of the rows ``own`` by feature, node of the level, and bin."""
        first, size = 2**level - 1, 2**level * BINS
        at = self.nodes(bins, level)
        own = np.flatnonzero(own & (at >= first))
        at, rest, out = (at[own].astype(np.intp) - first) * BINS, rest[own], np.empty((2, len(self.features), size))
        for k, f in enumerate(self.features):
            cells = at + bins[f].take(own)
            out[0, k], out[1, k] = np.bincount(cells, rest, size), np.bincount(cells, minlength=size)
        return out

    def split(self, level: int, sums: np.ndarray, unit: float) -> None:
        """Splits the level's nodes by the sums of all rows."""
        sums, n = sums.reshape(2, len(self.features), 2**level, BINS).swapaxes(1, 2)
        at = slice(2**level - 1, 2 ** (level + 1) - 1)
        if level == 0:
            self.total[0], self.rows[0] = sums[0, 0].sum(), n[0, 0].sum()
        left, n = sums.cumsum(2)[:, :, :-1], n.cumsum(2)[:, :, :-1]
        total, m = self.total[at, None, None], self.rows[at, None, None]
        square = lambda s: (s * unit) ** 2
        gain = np.where((n > 0) & (n < m), square(left) / (n + 1) + square(total - left) / (m - n + 1) - square(total) / (m + 1), 0).reshape(2**level, -1)
        found = np.flatnonzero(gain.max(1) > 1e-12) if self.depth else []
        for j in found:
            f, b = divmod(int(gain[j].argmax()), BINS - 1)
            i = at.start + j
            self.feature[i], self.bin[i] = self.features[f], b
            self.total[2 * i + 1], self.rows[2 * i + 1] = left[j, f, b], n[j, f, b]
            self.total[2 * i + 2], self.rows[2 * i + 2] = self.total[i] - left[j, f, b], self.rows[i] - n[j, f, b]
        self.open = len(found) > 0 and level + 1 < self.depth

    def value(self) -> np.ndarray:
        return np.rint(self.step * self.total / (self.rows + 1))

    def nested(self, cuts: list[np.ndarray], unit: float, i: int = 0) -> tuple:
        """(feature, threshold, left, right, rows) or (value, rows); values go left up to the threshold."""
        if self.feature[i] < 0:
            return float(self.value()[i] * unit), int(self.rows[i])
        f, b = int(self.feature[i]), self.bin[i]
        return f, float(cuts[f][b]), self.nested(cuts, unit, 2 * i + 1), self.nested(cuts, unit, 2 * i + 2), int(self.rows[i])


def values(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 2:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = values(tree[2], x[left]), values(tree[3], x[~left])
    return out


def fit(x: np.ndarray, y: np.ndarray, c, keys: np.ndarray | None = None) -> list[tuple]:
    """Trees whose values add up to the prediction; the first is a leaf, the mean. ``c`` is a combine.TreeConfig."""
    keys, one = np.arange(len(y)) if keys is None else keys, unit(len(y), float(np.abs(y).max()))
    cuts = [np.unique(np.quantile(v, SHARES)) for v in x.T]
    bins, rest = binned(x, cuts), np.rint(y / one)
    mean = np.rint(rest.sum() / len(y))
    trees, rest = [(float(mean * one), len(y))], rest - mean
    for t in range(c.trees):
        tree, own, level = Tree(t, x.shape[1], c), drawn(keys, t, c), 0
        while tree.open:
            tree.split(level, tree.sums(bins, rest, own, level), one)
            level += 1
        trees.append(tree.nested(cuts, one))
        rest = rest - tree.value()[tree.nodes(bins, c.depth)]
    return trees


def predict(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    return sum((values(t, x) for t in trees), np.zeros(len(x)))


def sampled(rows: DataFrame, n: F.Column, most: int) -> DataFrame:
    """About ``most`` of ``n`` rows, those of least hash of date and ticker; all, if there are no more. No query calls it."""
    share = F.pmod(F.xxhash64("date", "ticker"), F.lit(1 << 40)) / (1 << 40)
    return rows.where(share * n < most)


def key() -> F.Column:
    return F.xxhash64("date", "ticker").alias("_key")


def spans_of(panel: DataFrame, blocks: list[tuple]) -> DataFrame:
    """One row for each evaluation date, for every task."""
    return F.broadcast(panel.sparkSession.createDataFrame([(i, *b[:3]) for i, b in enumerate(blocks)], "block int, first date, last date, end date"))


def by_task(panel: DataFrame, blocks: list[tuple], names: list[str], c) -> DataFrame:
    spans = spans_of(panel, blocks)
    train = panel.join(spans, F.col("date") <= F.col("end")).select("block", key(), "fwd", *names)
    test = panel.join(spans, F.col("date").between(F.col("first"), F.col("last"))).select("block", "date", "ticker", *names)

    def scored(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        trees = fit(own[names].to_numpy(float), own["fwd"].to_numpy(float), c, own["_key"].to_numpy())
        return asked[["date", "ticker"]].assign(composite_score=predict(trees, asked[names].to_numpy(float)))

    test = test.toDF(*test.columns)  # both come from the panel: new names tell their columns apart
    return train.groupBy("block").cogroup(test.groupBy("block")).applyInPandas(scored, "date date, ticker string, composite_score double")
