"""Shapley values of boosted trees (Lundberg et al. 2018, path-dependent), by the trees' own training counts."""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _paths(tree, path=()):
    """Each leaf with its value and the splits above it: (feature, threshold, whether left, share of the rows that go there)."""
    if len(tree) == 2:
        yield path, tree[0]
        return
    f, threshold, left, right, n = tree
    yield from _paths(left, (*path, (f, threshold, True, left[-1] / n)))
    yield from _paths(right, (*path, (f, threshold, False, right[-1] / n)))


def shapley(trees: list, x: np.ndarray) -> tuple[np.ndarray, float]:
    """(values for each row and feature, base value); they add up to the prediction.

    A leaf counts with the share ``zero`` of each feature of its path that is unknown, and with ``one`` (whether the row
    goes there) of each that is known. The product of (zero + one * y) over the path's other features has, at y^k, the
    sum over all sets of k known ones; so a leaf costs the square of its depth, not two to its power.
    """
    phi, base = np.zeros(x.shape), 0.0
    for tree in trees:
        for path, value in _paths(tree):
            used = sorted({f for f, *_ in path})
            zero = {f: np.prod([share for g, _, _, share in path if g == f]) for f in used}
            one = {f: np.all([(x[:, f] <= t) == left for g, t, left, _ in path if g == f], axis=0).astype(float) for f in used}
            base += value * np.prod(list(zero.values()))
            m = len(used)
            for f in used:
                sets = [np.ones(len(x))]
                for g in used:
                    if g != f:
                        sets = [(sets[k] * zero[g] if k < len(sets) else 0) + (sets[k - 1] * one[g] if k else 0) for k in range(len(sets) + 1)]
                known = sum(s * (factorial(k) * factorial(m - k - 1) / factorial(m)) for k, s in enumerate(sets))
                phi[:, f] += value * (one[f] - zero[f]) * known
    return phi, float(base)


def shap_values(rows: DataFrame, trees: list, names: list[str]) -> DataFrame:
    """``date, ticker, factor_name, shap`` of every row; the trees' size bounds what is broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def explain(batches):
        for pdf in batches:
            phi, _ = shapley(shared.value, pdf[names].to_numpy(float))
            out = pd.DataFrame(phi, columns=names).assign(date=pdf["date"].to_numpy(), ticker=pdf["ticker"].to_numpy())
            yield out.melt(["date", "ticker"], names, "factor_name", "shap")

    return rows.select("date", "ticker", *names).mapInPandas(explain, "date date, ticker string, factor_name string, shap double")


def importance(values: DataFrame) -> DataFrame:
    return values.groupBy("factor_name").agg(F.avg(F.abs("shap")).alias("importance")).orderBy(F.desc("importance"))
