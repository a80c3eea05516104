"""The store, ingestion, runs, models, reports and the numbers behind charts, on small tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import boost, combine, report
from panelforge.sources import models, store


@pytest.fixture
def ledger(spark, tmp_path):
    return store.create(spark, f"file://{tmp_path}/store")


def test_store_and_ingest(spark, ledger):
    assert ledger.head()[0] == 1 and all(ledger.read(name).count() == 0 for name in ("prices", "combination_runs", "metadata")) and len(store.TABLES) == 21
    assert store.create(spark, ledger.root).head()[0] == 1
    rows = spark.createDataFrame([(dt.date(2020, 1, 2), "A", 1.0, "x")], "date date, ticker string, adj_close double, extra string")

    def broken():
        raise OSError("no connection")

    got = {r.source: (r.status, r.n_rows, r.error) for r in store.ingest(ledger, {"prices": lambda: rows, "macro": broken, "returns": lambda: spark.createDataFrame([], store.TABLES["returns"].columns)}).collect()}
    assert got == {"prices": ("ok", 1, None), "macro": ("failed", 0, "no connection"), "returns": ("empty", 0, None)}
    kept = ledger.read("prices").collect()
    assert [(r.ticker, r.adj_close, r.open) for r in kept] == [("A", 1.0, None)] and "extra" not in kept[0]


def test_insiders_and_earnings(spark, ledger):
    rows = spark.createDataFrame([(dt.date(2020, 1, 2), "A", "I", 5.0, "Purchase"), (dt.date(2020, 1, 2), "A", "J", 5.0, "Purchase"), (dt.date(2020, 2, 2), "A", None, 5.0, "Sale|x")], "date date, ticker string, insider string, shares double, text string")
    for _ in range(2):  # loading them once more adds none
        assert store.save(ledger, "insider_transactions", rows).count() == 3
    earn = spark.createDataFrame([("A", dt.date(2020, 1, 2), 1.0, 2.0)], "ticker string, date date, eps_estimate double, surprise_pct double")
    store.save(ledger, "earnings_calendar", earn)
    got = store.save(ledger, "earnings_calendar", earn.withColumn("surprise_pct", F.lit(3.0))).collect()
    assert [(r.surprise_pct, r.reported_eps) for r in got] == [(3.0, None)]


def test_save_and_report(spark, ledger, tmp_path):
    ends = [dt.date(2020, m, 28) for m in (1, 2, 3, 4)]
    weights = spark.createDataFrame([("b", d, "A", 1.0) for d in ends], "backtest_name string, date date, ticker string, weight double")
    moves = spark.createDataFrame([("b", d, i, 0, "A", 1.0, 0.05 * (-1) ** i, 1.0 if i else 0.0) for i, d in enumerate(ends)], "backtest_name string, date date, i int, first int, ticker string, target double, g double, drifted double")
    before = ledger.head()[0]
    saved = store.save_backtests(ledger, weights, moves)
    assert ledger.head()[0] == before + 1  # four tables, one commit
    assert saved["portfolio_weights"].count() == 4 and saved["trades"].count() == 0 and saved["backtest_metrics"].count() == 11
    store.write_report(saved, f"file://{tmp_path}/report", "2020-03-01")
    text = "\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/report/summary.md").collect())
    assert "## comparison" in text and "sharpe_ratio" in text
    assert spark.read.csv(f"file://{tmp_path}/report/backtest_results", header=True).count() == 4
    states = spark.createDataFrame([(ends[0], 0), (ends[1], 1)], "date date, regime_id int")
    labels = spark.createDataFrame([(0, "Bear")], "regime_id int, regime_label string")
    assert {(r.regime_label, r.prob_3) for r in store.save_regimes(ledger, states, labels).collect()} == {("Bear", 0.0), ("State 1", 0.0)}
    metrics = {(r.metric_name, r.metric_scope) for r in store.run_metrics(saved["backtest_results"], "2020-03-01").collect()}
    assert metrics == {("sharpe", "full"), ("max_dd", "full"), ("sharpe", "oos"), ("max_dd", "oos")}


def scores(spark, *rows):
    return spark.createDataFrame([(dt.date.fromisoformat(d), t, v) for d, t, v in rows], "date date, ticker string, composite_score double")


def test_a_configuration_has_one_run(spark, ledger, tmp_path):
    weights = spark.createDataFrame([(dt.date(2020, 1, 31), "f", 1.0)], "date date, factor_name string, weight double")
    metrics = spark.createDataFrame([("sharpe", "full", 1.0), ("sharpe", "oos", 2.0)], "metric_name string, metric_scope string, value double")
    first = store.save_run(ledger, "ic_weighted", {"lookback": 36}, scores(spark, ("2020-01-31", "A", 1.0), ("2020-02-29", "A", 2.0)), weights, metrics, train=(dt.date(2019, 1, 1), dt.date(2019, 12, 31)))
    other = store.save_run(ledger, "fama_macbeth", {"lookback": 36}, scores(spark, ("2020-01-31", "A", 5.0)))
    number = ledger.head()[0]
    again = store.save_run(ledger, "ic_weighted", {"lookback": 36}, scores(spark, ("2020-01-31", "A", 3.0)), weights, metrics)
    assert ledger.head()[0] == number + 1 and again != first
    assert {r.run_id for r in ledger.read("combination_runs").collect()} == {again, other} == set(ledger.head()[1]["runs"])
    got = {(str(r.date), r.method): (r.run_id, r.composite_score) for r in ledger.read("composite_scores").collect()}
    assert got == {("2020-01-31", "ic_weighted"): (again, 3.0), ("2020-01-31", "fama_macbeth"): (other, 5.0)}  # February of the first run is gone
    assert {(r.run_id, r.metric_scope, r.value) for r in ledger.read("combination_metrics").collect()} == {(again, "full", 1.0), (again, "oos", 2.0)}
    assert [r.run_id for r in ledger.read("combination_weights").collect()] == [again]
    store.save_run(ledger, "ic_weighted", {"lookback": 12}, scores(spark, ("2020-03-31", "B", 1.0)))
    assert ledger.read("combination_runs").count() == 3  # another configuration, another run
    betas = spark.createDataFrame([(dt.date(2020, 1, 31), n, 0.5) for n in "ba"], "date date, factor_name string, beta double")
    store.write_composite_report(f"file://{tmp_path}/r", spark.createDataFrame([("m", 1.0)], "backtest_name string, full_sharpe double"), {"ic_weighted": weights}, betas)
    assert spark.read.csv(f"file://{tmp_path}/r/fama_macbeth_coefficients", header=True).columns == ["date", "a", "b"]


def test_models_are_saved_and_scored_without_python(spark, ledger):
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(300, 4)).round(2)
    trees = boost.fit(x, x @ [1, -2, 0, 3] + (x[:, 0] > 0.5), combine.TreeConfig(trees=12, depth=4, step=0.3))
    names = ["w", "x", "y", "z"]
    models.save_model(ledger, "m", trees, names)
    models.save_model(ledger, "n", [(2.0, 5)], names)
    models.save_model(ledger, "m", trees, names)  # in place of the first
    back, used = models.load_model(ledger, "m")
    assert np.allclose(boost.predict(back, x[:, [names.index(n) for n in used]]), boost.predict(trees, x))
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, w double, x double, y double, z double").repartition(3)
    got = models.scored(rows, models.nodes_of(ledger, "m"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert np.allclose([r.composite_score for r in got.orderBy("id").collect()], boost.predict(trees, x))
    assert {r.composite_score for r in models.scored(rows, models.nodes_of(ledger, "n")).collect()} == {2.0}
    gone = models.scored(rows.withColumns({n: F.lit(None).cast("double") for n in names}).limit(1), models.nodes_of(ledger, "m")).first()
    assert np.isclose(gone.composite_score, boost.predict(trees, np.full((1, 4), 9.0))[0])  # nulls go right
    with pytest.raises(ValueError):
        models.nodes_of(ledger, "none")


def test_chart_numbers(spark):
    values = [0.0, 0.1, 0.1, 0.9, 1.0, None]
    panel = spark.createDataFrame([(dt.date(2020, 1, 1 + i), "A", v) for i, v in enumerate(values)], "date date, ticker string, value double")
    got = {r.bin: r.n for r in report.histogram(panel, 5).collect()}
    want = np.histogram([v for v in values if v is not None], 5)[0]
    assert [got.get(i, 0) for i in range(5)] == want.tolist()
    q = {round(r.p, 2): r.observed for r in report.normal_quantiles(panel, 3).collect()}
    assert np.allclose([q[p] for p in (0.25, 0.5, 0.75)], np.quantile([0, 0.1, 0.1, 0.9, 1], [0.25, 0.5, 0.75]))
    assert report.histogram(panel.limit(0)).count() == 0
    flags = spark.createDataFrame([(dt.date(2020, 1, 1), "A", False), (dt.date(2020, 1, 9), "A", True), (dt.date(2020, 1, 9), "B", None)], "date date, ticker string, f boolean")
    assert {r.ticker: r.any_true for r in report.any_by_month(flags, "f").collect()} == {"A": True, "B": False}
