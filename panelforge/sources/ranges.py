"""A range of dates out of long histories: the months asked for, and the state that what comes before leaves.

A history keeps two small tables beside its rows, by month as well: the dates it has, and for each key the last values
and the first date of the month. An as-of fill takes from these what was last known before the range, a window over n
rows of the calendar the date it has to start at. So a result over a range reads the range, some months before it, and
summaries; it equals the result over everything, cut to the range.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import factors, returns
from . import io
from .ledger import Ledger, Spec


@dataclass(frozen=True)
class History:
    """Columns of a table with a date, its key beside the date, and the fields that are carried forward."""

    columns: str
    key: str
    fields: tuple[str, ...]


HISTORIES = {
    "prices": History("date date, ticker string, adj_close double, close double, volume long", "ticker", ("adj_close",)),
    "macro": History("date date, series_name string, value double", "series_name", ("value",)),
}
SPECS = {name: Spec(h.columns, ("date", h.key)) for name, h in HISTORIES.items()}
SPECS |= {f"{name}_dates": Spec("date date", ("date",)) for name in HISTORIES}
SPECS |= {f"{name}_state": Spec(f"month date, {h.key} string, first date, " + ", ".join(f"{f} double" for f in h.fields), ("month", h.key), "month") for name, h in HISTORIES.items()}


def save(ledger: Ledger, name: str, rows: DataFrame) -> None:
    """Upserts rows of a history and renews dates and state of the months they fall into, in one commit."""
    history, parts = HISTORIES[name], ledger.parts(name)
    months = {r[0] for r in rows.select(F.date_format("date", "yyyy-MM")).distinct().collect()}  # a row a month
    old = ledger.read_parts(name, [m for m in months if m in parts])
    both = io.upsert(old, rows.select(*old.columns), ["date", history.key])
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("date"))).alias(f) for f in history.fields]
    state = both.groupBy(F.trunc("date", "month").alias("month"), history.key).agg(F.min(F.when(F.col(history.fields[0]).isNotNull(), F.col("date"))).alias("first"), *last)
    ledger.commit({name: rows, f"{name}_dates": both.select("date").distinct(), f"{name}_state": state})


def build(spark: SparkSession, path: str, prices: DataFrame, macro: DataFrame) -> None:
    """Histories of prices and macro series below ``path``."""
    ledger = Ledger(spark, path, SPECS)
    save(ledger, "prices", prices)
    save(ledger, "macro", macro)


@dataclass(frozen=True)
class Range:
    """Results from ``start`` to ``end``."""

    ledger: Ledger
    start: dt.date
    end: dt.date

    def first(self, name: str, rows: int = 0, months: int = 0) -> dt.date:
        """The first of the month that reading has to begin with: ``rows`` dates of the calendar and ``months`` before."""
        at = self.start
        if rows:
            before = self.ledger.read(f"{name}_dates", end=self.start - dt.timedelta(days=1))
            at = before.orderBy(F.desc("date")).limit(rows).agg(F.min("date")).first()[0] or at
        for _ in range(months):
            at = at.replace(day=1) - dt.timedelta(days=1)
        return at.replace(day=1)

    def carried(self, name: str, first: dt.date) -> DataFrame:
        """``key, fields, first`` as known before ``first``: last values and first date, of the months' states."""
        history = HISTORIES[name]
        state = self.ledger.read(f"{name}_state", end=first - dt.timedelta(days=1))
        last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("month"))).alias(f) for f in history.fields]
        return state.groupBy(history.key).agg(F.min("first").alias("first"), *last)

    def rows(self, name: str, first: dt.date, carry: bool = False) -> DataFrame:
        """Rows from ``first`` on; with ``carry``, what was known before stands on the day before."""
        rows = self.ledger.read(name, first, self.end)
        if not carry:
            return rows
        before = self.carried(name, first).drop("first").withColumn("date", F.lit(first - dt.timedelta(days=1)))
        return rows.unionByName(before, allowMissingColumns=True)

    def cut(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("date").between(F.lit(self.start), F.lit(self.end)))

    def daily_returns(self) -> DataFrame:
        return self.cut(returns.daily_returns(self.rows("prices", self.first("prices", rows=1))))

    def monthly_returns(self) -> DataFrame:
        return self.cut(returns.monthly_returns(self.rows("prices", self.first("prices", months=1), carry=True)))

    def universe_membership(self, lookback: int = 60, **more) -> DataFrame:
        first = self.first("prices", rows=lookback - 1)
        return self.cut(returns.universe_membership(self.rows("prices", first), lookback=lookback, listed=self.carried("prices", first), **more))

    def price_factors(self, long: int = 12, short: int = 3) -> DataFrame:
        months = returns.month_ends(self.rows("prices", self.first("prices", months=max(long, short, 12) + 1), carry=True))
        return self.cut(factors.price_factors(months, long, short))

    def macro_filled(self) -> DataFrame:
        return self.cut(io.macro_filled(self.rows("macro", self.first("macro"), carry=True)))
