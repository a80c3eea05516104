"""The dense grid equals the product of dates and tickers joined with the rows, and does not shuffle that product."""

import datetime as dt

from panelforge.operators import returns

DAYS = [dt.date(2020, 1, d) for d in (2, 3, 7, 8, 9)]


def by_product(rows, cols):
    grid = rows.select("date").distinct().crossJoin(rows.select("ticker").distinct())
    return grid.join(rows.select("date", "ticker", *cols), ["date", "ticker"], "left").select("date", "ticker", *cols)


def told(df):
    return sorted(map(str, df.collect()))


def test_dense_grid_equals_product(spark):
    cells = [(DAYS[0], "A", 1.0), (DAYS[3], "A", None), (DAYS[1], "B", 2.0), (DAYS[1], "B", 3.0), (DAYS[4], "C", 4.0), (DAYS[2], None, 5.0), (None, "A", 6.0), (None, "D", 7.0)]
    for some in (cells, cells[:5], cells[:1], []):
        rows = spark.createDataFrame(some, "date date, ticker string, value double")
        assert told(returns.dense_grid(rows, ("value",))) == told(by_product(rows, ("value",)))


def test_dense_grid_does_not_shuffle_the_product(spark):
    rows = spark.createDataFrame([(DAYS[0], "A", 1.0)], "date date, ticker string, value double")
    plan = returns.dense_grid(rows, ("value",))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin Cross" not in plan and "CartesianProduct" not in plan
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert joins and all("Broadcast" in x for x in joins)
