"""Ranks and quantiles over whole panels, regressions, costs, composites and Shapley values, against plain versions."""

import datetime as dt
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions.stats import ordered_counts, pooled_quantiles, pooled_ranks
from panelforge.operators import backtest, boost, combine, shap
from panelforge.sources.scratch import Scratch


def day(i):
    return (dt.date(2020, 1, 1) + pd.DateOffset(months=i + 1) - pd.DateOffset(days=1)).date()


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in "ab" for v in rng.normal(size=400).round(1)] + [("a", 0.0)] * 500 + [("a", None), ("c", None), ("d", 3.5)]
    return pd.DataFrame(rows, columns=["g", "v"]), spark.createDataFrame(rows, "g string, v double").repartition(7)


def test_pooled_ranks(spark, values):
    plain, rows = values
    got = pooled_ranks(rows, "v", ["g"], Scratch(spark)).toPandas()
    want = plain.dropna().assign(rank=plain.dropna().groupby("g")["v"].rank())
    assert sorted(map(tuple, got[["g", "v", "rank"]].to_numpy())) == sorted(map(tuple, want.to_numpy()))
    counts = ordered_counts(rows, "v", [], Scratch(spark)).toPandas().sort_values("v")
    assert (counts["before"].to_numpy() == np.r_[0, np.cumsum(counts["c"])[:-1]]).all() and (counts["n"] == 1301).all()
    assert pooled_ranks(rows.limit(0), "v", ["g"], Scratch(spark)).count() == 0


def test_pooled_quantiles(spark, values):
    plain, rows = values
    shares = [0.0, 0.001, 0.25, 0.5, 0.77777, 1.0]
    got = {r.i: r.quantile for r in pooled_quantiles(rows, "v", shares, Scratch(spark)).collect()}
    assert np.allclose([got[i] for i in range(len(shares))], np.quantile(plain["v"].dropna(), shares))
    assert pooled_quantiles(rows.where("v is null"), "v", shares, Scratch(spark)).count() == 0
    one = pooled_quantiles(rows.where("g = 'd'"), "v", [0.3, 1.0], Scratch(spark)).collect()
    assert [r["quantile"] for r in one] == [3.5, 3.5]


def test_no_window_over_everything(spark):
    """Whole-panel ranks and quantiles sort by ranges: no plan brings all values to one task."""
    rng = np.random.default_rng(2)
    panel = spark.createDataFrame([(day(i % 3), f"T{i}", *map(float, rng.normal(size=2)), 0.0) for i in range(60)], "date date, ticker string, a double, b double, fwd double")
    plan = combine.factor_corr(panel)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "Window" not in plan
    got = {(r.factor_a, r.factor_b): r.correlation for r in combine.factor_corr(panel).collect()}
    pdf = panel.toPandas()
    assert abs(got["a", "b"] - pdf["a"].rank().corr(pdf["b"].rank())) < 1e-12 and len(got) == 3


def test_regressions_equal_least_squares(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d, n in enumerate((40, 9, 6, 30, 25)):
        x = rng.normal(size=(n, 5)) * [1, 100, 0.01, 1, 1] + [0, 1e4, 0, 0, 0]
        if d == 3:
            x[:, 2] = 7.0  # no spread: skipped
        if d == 4:
            x[:, 4] = 2 * x[:, 0] - 1  # determined by another factor
        rows += [(day(d), f"T{i}", *map(float, r), float(y)) for i, (r, y) in enumerate(zip(x, x @ [1, 0.02, 3, -1, 0] + rng.normal(size=n)))]
    panel = spark.createDataFrame(rows, "date date, ticker string, a double, b double, c double, d double, e double, fwd double")
    got = {(r.date, r.factor_name): r.beta for r in combine.regressions(panel).collect()}
    pdf = panel.toPandas()
    assert {d for d, _ in got} == {day(0), day(1), day(4)}  # six rows are too few
    for d in (day(0), day(1)):
        own = pdf[pdf["date"] == d]
        want = np.linalg.lstsq(np.c_[np.ones(len(own)), own[list("abcde")]], own["fwd"].to_numpy(), rcond=None)[0][1:]
        assert np.allclose([got[d, c] for c in "abcde"], want, rtol=1e-7)
    own = pdf[pdf["date"] == day(4)]
    want = np.linalg.lstsq(np.c_[np.ones(len(own)), own[list("abcd")]], own["fwd"].to_numpy(), rcond=None)[0][1:]
    assert np.allclose([got[day(4), c] for c in "abcd"], want, rtol=1e-7) and got[day(4), "e"] == 0
    assert "Python" not in combine.regressions(panel)._jdf.queryExecution().executedPlan().toString()


class Impact(backtest.CostModel):
    """Large trades cost more than in proportion."""

    def of_trade(self, change):
        return change * change * 0.1

    def of_turnover(self, turnover):
        return turnover * 0.001


def test_costs_of_ones_own(spark):
    moves = spark.createDataFrame([("b", day(i), i, 0, t, x, 0.0, y) for i, t, x, y in ((0, "A", 1.0, 0.0), (1, "A", 0.5, 1.0), (1, "B", 0.5, 0.0))], "backtest_name string, date date, i int, first int, ticker string, target double, g double, drifted double")
    got = [r.transaction_costs for r in backtest.backtest_results(moves, costs=Impact()).orderBy("date").collect()]
    assert np.allclose(got, [0.1 + 0.001, 0.1 * 0.5 + 0.001])
    plain = [r.transaction_costs for r in backtest.backtest_results(moves, costs=backtest.LinearCost(2, 4)).orderBy("date").collect()]
    assert np.allclose(plain, [4e-4, 4e-4])


class Mean(combine.Composite):
    method = "mean"

    def fit(self, panel):
        return [c for c in panel.columns if c not in ("date", "ticker", "fwd")]

    def predict(self, panel, fitted):
        return panel.select("date", "ticker", (sum(map(F.col, fitted)) / len(fitted)).alias("composite_score"))


def test_composites_of_ones_own(spark):
    rng = np.random.default_rng(5)
    panel = spark.createDataFrame([(day(i), t, *map(float, rng.normal(size=3))) for i in range(8) for t in "ABCDEFGH"], "date date, ticker string, a double, b double, fwd double")
    methods = [Mean(), combine.ICWeighted(lag=1), combine.FamaMacBeth(), combine.Boosted(combine.TreeConfig(trees=2, depth=1, least_dates=4))]
    got = combine.composites(panel, methods).toPandas()
    assert set(got["method"]) == {"mean", "ic_weighted", "fama_macbeth", "xgboost"} and (got["method"] == "mean").sum() == 64
    pdf = panel.toPandas().set_index(["date", "ticker"])
    own = got[got["method"] == "mean"].set_index(["date", "ticker"])["composite_score"]
    assert np.allclose(own.sort_index(), ((pdf["a"] + pdf["b"]) / 2).sort_index())
    with pytest.raises(ValueError):
        combine.composites(panel, [Mean(), Mean()])


def subsets(trees, x):
    """Shapley values by all subsets of a tree's features."""
    features = lambda t: set() if len(t) == 2 else {t[0]} | features(t[2]) | features(t[3])

    def value(tree, known):
        if len(tree) == 2:
            return np.full(len(x), tree[0])
        f, threshold, left, right, n = tree
        a, b = value(left, known), value(right, known)
        return np.where(x[:, f] <= threshold, a, b) if f in known else (a * left[-1] + b * right[-1]) / n

    phi, base = np.zeros(x.shape), 0.0
    for tree in trees:
        used = sorted(features(tree))
        base += value(tree, set())[0]
        for f in used:
            rest = [u for u in used if u != f]
            for k in range(len(rest) + 1):
                for s in combinations(rest, k):
                    phi[:, f] += factorial(k) * factorial(len(used) - k - 1) / factorial(len(used)) * (value(tree, {*s, f}) - value(tree, set(s)))
    return phi, base


def test_shapley_values_equal_all_subsets():
    rng = np.random.default_rng(6)
    x = rng.uniform(size=(400, 7))
    y = x @ [3, -2, 1, 0.5, 2, -1, 0] + np.where((x[:, 0] > 0.5) & (x[:, 1] < 0.4), 2, 0)
    trees = boost.fit(x, y, combine.TreeConfig(trees=6, depth=3, step=0.3))
    (phi, base), (want, base2) = shap.shapley(trees, x[:60]), subsets(trees, x[:60])
    assert np.allclose(phi, want) and abs(base - base2) < 1e-9
    deep = boost.fit(x, y, combine.TreeConfig(trees=8, depth=6, step=0.3))
    phi, base = shap.shapley(deep, x)
    assert np.allclose(phi.sum(1) + base, boost.predict(deep, x))


def test_models_learn_from_a_bounded_share(spark):
    rows = spark.range(4000).select(F.lit(day(0)).alias("date"), F.col("id").cast("string").alias("ticker"))
    few = boost.sampled(rows, F.lit(4000), 1000).count()
    assert 850 < few < 1150 and boost.sampled(rows, F.lit(4000), 4000).count() == 4000
    assert boost.sampled(rows, F.lit(4000), 1000).exceptAll(boost.sampled(rows, F.lit(4000), 2000)).count() == 0
