"""Goldens of single operators, and queries against their SQL on the smallest tables."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from panelforge.config import Config, Universe
from panelforge.operators import backtest, boost, combine, factors, regime, returns, shap
from panelforge.sources import io

PATH = "/root/testdata/sf0.001"


def day(i):
    return dt.date(2020, 1, 31) if i == 0 else (dt.date(2020, 1, 1) + pd.DateOffset(months=i + 1) - pd.DateOffset(days=1)).date()


def test_log_return(spark):
    rows = spark.createDataFrame([(dt.date(2020, 1, 2 + i), "T", p, p, 1) for i, p in enumerate([100.0, 110.0, 99.0])], "date date, ticker string, adj_close double, close double, volume long")
    got = [r.log_return for r in returns.daily_returns(rows).orderBy("date").collect()]
    assert np.allclose(got, np.log([1.1, 0.9]), atol=1e-10)


def test_winsorize_and_zscore(spark):
    rows = spark.createDataFrame([(1, "f", float(x)) for x in (1, 2, 3, 4, 100)], "date int, factor_name string, raw_score double")
    got = sorted(r.winsorized_score for r in factors.winsorize(rows, low=0.2, high=0.2).collect())
    assert np.allclose(got, [1.8, 2, 3, 4, 23.2])
    flat = spark.createDataFrame([(1, "f", 2.0)] * 3, "date int, factor_name string, winsorized_score double")
    assert [r.z_score for r in factors.zscore(flat).collect()] == [0, 0, 0]


def test_neutralize_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"date": 1, "factor_name": "f", "z_score": rng.normal(size=40), "size": rng.uniform(1, 9, 40), "sector": rng.choice(list("abc"), 40)})
    got = factors.neutralize(spark.createDataFrame(pdf)).toPandas().sort_values("size")
    pdf = pdf.sort_values("size")
    x = np.c_[np.log(pdf["size"]), pd.get_dummies(pdf["sector"]).to_numpy(float)]
    want = pdf["z_score"] - x @ np.linalg.lstsq(x, pdf["z_score"].to_numpy(), rcond=None)[0]
    assert np.allclose(got["final_score"], want, atol=1e-9)


def test_turnover_golden(spark):
    w = spark.createDataFrame([("b", day(0), "A", 0.4), ("b", day(0), "B", 0.6), ("b", day(1), "A", 0.5), ("b", day(1), "B", 0.5)], "backtest_name string, date date, ticker string, weight double")
    r = spark.createDataFrame([(day(1), "A", 0.1), (day(1), "B", -0.05)], "date date, ticker string, simple_return double")
    moves = backtest.drifted(w, r, w.select("date").distinct(), double_drift=False)
    turnover = {x.date: x.turnover for x in backtest.backtest_results(moves).collect()}
    assert abs(turnover[day(1)] - 0.12871287) < 1e-8


def test_cap_waterfills(spark):
    w = spark.createDataFrame([("b", day(0), t, x) for t, x in zip("ABCDE", (0.5, 0.3, 0.1, 0.05, 0.05))], "backtest_name string, date date, ticker string, weight double")
    got = {r.ticker: r.weight for r in backtest.cap_weights(w, 0.3).collect()}
    assert np.allclose([got[t] for t in "ABCDE"], [0.3, 0.3, 0.2, 0.1, 0.1])


def test_hmm_and_shapley():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (80, 2)), rng.normal(5, 1, (80, 2))]
    m = regime.hmm_fit(x, 2, 20)
    assert np.allclose(m["posterior"].sum(1), 1) and np.allclose(m["trans"].sum(1), 1)
    assert len(set(m["states"][:80])) == len(set(m["states"][80:])) == 1 and m["states"][0] != m["states"][-1]
    tree = (0, 0.5, (1.0, 3), (1, 2.0, (2.0, 1), (5.0, 4), 5), 8)
    data = rng.uniform(0, 3, (20, 3))
    phi, base = shap.shapley([tree], data)
    want = np.where(data[:, 0] <= 0.5, 1.0, np.where(data[:, 1] <= 2, 2.0, 5.0))
    assert np.allclose(phi.sum(1) + base, want) and (phi[:, 2] == 0).all()


def test_boosted_trees_learn_and_explain(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (600, 4))
    y = np.where(x[:, 1] > 0.5, 1.0, -1.0) * np.where(x[:, 2] > 0.3, 1.0, 0.2)
    trees = boost.fit(x, y, combine.TreeConfig(trees=150, step=0.1))
    assert np.mean((boost.predict(trees, x) - y) ** 2) < 0.02 * y.var()
    phi, base = shap.shapley(trees[:30], x[:50])
    assert np.allclose(phi.sum(1) + base, boost.predict(trees[:30], x[:50]))
    panel = spark.createDataFrame([(day(i % 9), f"T{i:03}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "date date, ticker string, a double, b double, c double, d double, fwd double")
    got = combine.boosted_trees(panel, list("abcd"), combine.TreeConfig(trees=20))
    assert len(got) == 21 and np.abs(shap.shapley(got, x)[0]).mean(0).argmax() == 1


def test_boosted_walk_scores_every_date_it_can(spark):
    """A training window that is a date short costs that date only, not its block."""
    rng = np.random.default_rng(3)
    rows = [(day(i), t, float(rng.normal()), float(rng.normal())) for i in range(9) if i != 3 for t in "ABCDEF"]
    panel = spark.createDataFrame(rows, "date date, ticker string, f double, fwd double")
    got = combine.boosted_walk(panel, combine.TreeConfig(trees=1, depth=1, least_dates=4, purge_months=2, stride=3))
    assert sorted({r.date for r in got.collect()}) == [day(i) for i in (6, 7, 8)]


def test_hidden_states_are_tried_as_the_operator_does(spark):
    got = {r.k: r.best for r in __spark_entry__.queries()["hmm_bic"](spark, PATH).collect()}
    assert sorted(got) == [2, 3, 4, 5, 6] and sum(got.values()) == 1


def test_sources(spark, tmp_path):
    (tmp_path / "f.csv").write_text("note\n,Mkt-RF,SMB,HML,RMW,CMA,RF\n20200102,1.0,2,3,4,5,0.1\n20200103,2.0,2,3,4,5,0.1\n\nannual\n20200104,9,9,9,9,9,9\n")
    got = io.read_market_factors(spark, str(tmp_path / "f.csv")).orderBy("date").collect()
    assert [round(r.mkt_rf, 6) for r in got] == [0.01, 0.02]  # the blank line is skipped, the short one ends the data
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    for version, batch in (("v1", old), ("v2", new), ("v3", new)):
        out = io.write_upsert(spark, str(tmp_path / "t"), batch, ["k"], version)
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    again = io.write_upsert(spark, str(tmp_path / "t"), new, ["k"], "v3")  # a replay
    assert sorted(map(tuple, again.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    (tmp_path / "t" / "v4").mkdir()  # a version that wasn't finished
    assert io.versions(spark, str(tmp_path / "t")) == ["v1", "v2", "v3"]
    assert io.read_newest(spark, str(tmp_path / "t")).count() == 3


def test_statements_and_prices(spark):
    d = dt.date(2020, 3, 31)
    rows = [(d, "A", " Total Stockholders Equity", 5.0), (d, "A", "Common Stock Equity", 4.0), (d, "A", "Normalized EBITDA", 3.0), (d, "A", "Purchase of PPE", -2.0), (d, "A", "Net Income", 1.0), (d, "A", "other", 9.0)]
    got = io.statement_fields(spark.createDataFrame(rows, "date date, ticker string, label string, value double")).collect()
    assert [(r.book_value, r.ebitda, r.capital_expenditures, r.net_income, r.eps, r.total_debt) for r in got] == [(5.0, 3.0, 2.0, 1.0, 1.0, None)]
    raw = spark.createDataFrame([("2020-01-02", "A", 1.0, float("nan"), None), ("2020-01-03", "A", None, None, 5)], "Date string, ticker string, Open double, Close double, Volume long")
    assert [(r.open, r.close, r.high, r.volume) for r in io.normalize_prices(raw).collect()] == [(1.0, None, None, 0)]


def test_sortino_leaves_the_first_period_out(spark):
    nets = [-0.001, 0.02, -0.01, 0.03, -0.02]
    rows = [("b", day(i), 0.0, x, 0.1) for i, x in enumerate(nets)]
    got = {r.metric_name: r.value for r in backtest.backtest_metrics(spark.createDataFrame(rows, "backtest_name string, date date, gross_return double, net_return double, turnover double")).collect()}
    own = np.array(nets[1:])
    assert abs(got["sortino_ratio"] - own.mean() / np.sqrt(np.mean(own[own < 0] ** 2)) * np.sqrt(12)) < 1e-9


def test_month_ends_and_daily_returns_skip_gaps(spark):
    rows = [(dt.date(2020, 1, 30), "A", 1.0), (dt.date(2020, 1, 31), "B", 2.0), (dt.date(2020, 2, 3), "A", 3.0), (dt.date(2020, 2, 3), "B", 3.0), (dt.date(2020, 4, 1), "A", 6.0)]
    prices = spark.createDataFrame(rows, "date date, ticker string, adj_close double")
    got = {(r.ticker, r.date.month): r.px for r in returns.month_ends(prices).collect()}
    assert got == {("A", 1): 1.0, ("A", 2): 3.0, ("A", 3): None, ("A", 4): 6.0, ("B", 1): 2.0, ("B", 2): 3.0, ("B", 3): None, ("B", 4): 3.0}
    assert [(r.ticker, r.simple_return) for r in returns.daily_returns(prices).orderBy("date", "ticker").collect()] == [("B", 0.5), ("A", 1.0)]


def test_config():
    assert Config.of({"stock_universe": ["aapl"], "universe": {"min_market_cap_bn": 2}}).stock_universe == ["AAPL"]
    with pytest.raises(ValueError):
        Universe(min_dollar_vol_percentile=101)


@pytest.mark.parametrize("name", ["monthly_returns", "xs_stats", "factor_PriceMomentum", "factor_Accruals", "universe_size", "regime_spans", "upsert_merge", "event_windows"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "region", "supplier", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS FROM '{PATH}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, PATH)
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    rows = got.toPandas()
    assert len(rows) == len(want) and sorted(rows.columns) == sorted(want.columns)
    for c, t in got.dtypes:
        if t == "double":
            assert np.allclose(np.sort(rows[c].to_numpy(float)), np.sort(want[c].to_numpy(float)), atol=2e-6, equal_nan=True)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["factor_name", "date", "return_q1", "return_q5", "return_ls"]
