"""Odd inputs: repeated cells, absent shares, sizes by proxy, the logger."""

import datetime as dt

import pytest

from panelforge.log import logger
from panelforge.operators import factors, returns
from panelforge.sources import io

D = dt.date(2020, 1, 31)


def test_a_cell_has_one_row(spark):
    rows = spark.createDataFrame([(D, "A", 1.0), (D, "B", None)], "date date, ticker string, simple_return double")
    assert sorted((r.ticker, r.value) for r in returns.panel(rows).collect()) == [("A", 1.0), ("B", None)]
    with pytest.raises(Exception, match="two rows of B on 2020-01-31"):
        returns.panel(rows.unionByName(rows.where("ticker = 'B'"))).collect()
    with pytest.raises(ValueError):
        returns.panel(rows, "log_return")
    with pytest.raises(ValueError):
        returns.panel(rows.drop("date"))


def test_shares(spark):
    raw = spark.createDataFrame([("A", "x", 5, 7), ("B", None, 0, 7), ("C", None, None, None)], "ticker string, sector string, sharesOutstanding long, impliedSharesOutstanding long")
    assert {r.ticker: (r.sector, r.industry, r.shares_outstanding) for r in io.ticker_info(raw).collect()} == {"A": ("x", None, 5.0), "B": (None, None, 7.0), "C": (None, None, None)}
    assert io.ticker_info(raw.select("ticker")).first().shares_outstanding is None


def test_sizes_and_members(spark):
    raw = spark.createDataFrame([(D, t, "f", v) for t, v in zip("ABCDE", (1.0, 2.0, 3.0, 4.0, 5.0))], "date date, ticker string, factor_name string, raw_score double")
    months = spark.createDataFrame([(D, t, 2.0 if t != "B" else None) for t in "ABCDE"], "date date, ticker string, px double")
    meta = spark.createDataFrame([(t, "s", 10.0) for t in "ABDE"], "ticker string, sector string, shares_outstanding double")
    active = spark.createDataFrame([(D, t, t != "E", 3.0 if t == "B" else None) for t in "ABCDE"], "date date, ticker string, in_universe boolean, market_cap_proxy double")
    sizes = {r.ticker: r.size for r in factors.sized(raw.join(active, ["date", "ticker"]), months, meta).collect()}
    assert sizes == {"A": 20.0, "B": 3e9, "C": 1.0, "D": 20.0, "E": 20.0}
    got = {r.ticker: r.winsorized_score for r in factors.factor_scores(raw, months, meta, active).collect()}
    assert set(got) == set("ABCD") and got["D"] < 4


def test_logger(tmp_path):
    log = logger("panelforge.test", "debug", str(tmp_path / "a" / "log.txt"))
    assert logger("panelforge.test") is log and len(log.handlers) == 2
    log.debug("said")
    assert (tmp_path / "a" / "log.txt").read_text().rstrip().endswith("| DEBUG | panelforge.test | said")
