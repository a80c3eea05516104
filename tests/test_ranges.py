"""Results over a range against whole results cut to it, on histories with gaps, late listings and later changes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import factors, returns
from panelforge.sources import io, ranges
from panelforge.sources.ledger import Ledger


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    rng, rows = random.Random(2), []
    for t, (first, last, often) in {"A": (0, 1100, 0.9), "B": (300, 1100, 0.5), "C": (0, 480, 0.9), "D": (0, 1100, 0.1), "E": (700, 1100, 1.0)}.items():
        for i in range(first, last):
            if rng.random() < often and not 520 <= i < 590:  # two months without any trade
                rows.append((dt.date(2018, 1, 1) + dt.timedelta(days=i), t, rng.uniform(1, 9), rng.randint(1, 99)))
    prices = spark.createDataFrame(rows, "date date, ticker string, adj_close double, volume long").withColumn("close", F.col("adj_close"))
    macro = spark.createDataFrame([(dt.date(2018, 1, 1) + dt.timedelta(days=i), s, float(i) if i % 50 else None) for i in range(0, 1000, 7) for s in "xy" if s == "x" or i < 300], "date date, series_name string, value double")
    ledger = Ledger(spark, f"file://{tmp_path_factory.mktemp('ranges')}/h", ranges.SPECS)
    ranges.save(ledger, "prices", prices.where("month(date) <> 3"))
    ranges.save(ledger, "prices", prices.where("month(date) = 3"))  # comes later: its months' states are renewed
    ranges.save(ledger, "macro", macro)
    return ledger, prices, macro


def same(got, want, span):
    cut = want.where(F.col("date").between(F.lit(span[0]), F.lit(span[1])))
    tidy = lambda rows: sorted(str([round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in sorted(rows.columns))]) for r in rows.collect())
    assert tidy(got) == tidy(cut.select(*got.columns))


@pytest.mark.parametrize("span", [("2019-07-10", "2020-02-20"), ("2018-01-01", "2018-06-30"), ("2020-03-01", "2020-03-31"), ("2017-01-01", "2025-01-01"), ("2019-08-05", "2019-08-06")])
def test_ranges_equal_whole_results_cut(history, span):
    ledger, prices, macro = history
    span = tuple(map(dt.date.fromisoformat, span))
    r = ranges.Range(ledger, *span)
    same(r.daily_returns(), returns.daily_returns(prices), span)
    same(r.monthly_returns(), returns.monthly_returns(prices), span)
    same(r.universe_membership(lookback=20), returns.universe_membership(prices, lookback=20), span)
    months = returns.month_ends(prices).where(F.col("date") <= F.last_day(F.lit(span[1])))
    known = factors.price_factors(months).join(prices.where(F.col("date") <= F.lit(span[1])).select("ticker").distinct(), "ticker", "left_semi")
    same(r.price_factors().dropna("all", subset=factors.PRICE), known.dropna("all", subset=factors.PRICE), span)
    same(r.macro_filled().where("value is not null"), io.macro_filled(macro).where("value is not null"), span)


def test_only_the_range_and_summaries_are_read(history):
    ledger, _, _ = history
    rows = ranges.Range(ledger, dt.date(2020, 3, 1), dt.date(2020, 4, 15)).daily_returns()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2020-02" in plan
    months = {f.split("part=")[1][:7] for f in rows.inputFiles()}
    assert months == {"2020-02", "2020-03", "2020-04"}
