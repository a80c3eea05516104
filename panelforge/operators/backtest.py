"""Portfolios and backtests: every backtest of a table of scores in one plan, keyed by its name.

Target weights depend on scores alone, so drift, turnover, costs and returns are a lag and grouped sums, and the
portfolio's value is a running product.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio

B = "backtest_name"


def rebalance_schedule(dates: DataFrame, frequency: str = "monthly") -> DataFrame:
    """The last date of each month, or all dates."""
    dates = dates.select("date").distinct()
    if frequency == "daily":
        return dates
    if frequency != "monthly":
        raise ValueError(f"unknown frequency {frequency}")
    return dates.groupBy(F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date")).select("date")


def ranked(scores: DataFrame, share: float = 0.2) -> DataFrame:
    rows = scores.where("score is not null")
    w = Window.partitionBy(B, "date")
    rows = rows.withColumns({"top": F.row_number().over(w.orderBy(F.desc("score"), "ticker")), "low": F.row_number().over(w.orderBy("score", F.desc("ticker"))), "n": F.count("*").over(w)})
    return rows.withColumn("k", F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * share, 9))).cast("int"))


def topk_weights(scores: DataFrame, net: float = 1.0) -> DataFrame:
    """``backtest_name, date, ticker, weight``: equal weights of the best fifth (ties by ticker)."""
    return ranked(scores).where("top <= k").select(B, "date", "ticker", (F.lit(net) / F.col("k")).alias("weight"))


def rank_weights(scores: DataFrame) -> DataFrame:
    """``backtest_name, date, ticker, weight``: the best fifth, weighted by place: the best of k names has k parts, the last one."""
    parts = F.col("k") * (F.col("k") + 1) / 2
    return ranked(scores).where("top <= k").select(B, "date", "ticker", ((F.col("k") - F.col("top") + 1) / parts).alias("weight"))


def long_short_weights(scores: DataFrame, net: float = 0.0, gross: float = 1.0) -> DataFrame:
    """The best fifth long and the worst short; a ticker in both is in neither."""
    rows = ranked(scores).withColumns({"l": F.col("top") <= F.col("k"), "s": F.col("low") <= F.col("k")})
    rows = rows.withColumns({"l": F.col("l") & ~F.col("s"), "s": F.col("s") & ~F.col("l")}).where("l or s")
    w = Window.partitionBy(B, "date")
    long, short = (gross + net) / 2, (gross - net) / 2
    weight = F.when(F.col("l"), long / F.count_if("l").over(w)).otherwise(-short / F.greatest(F.lit(1), F.count_if("s").over(w)))
    return rows.select(B, "date", "ticker", weight.alias("weight"))


def cap_weights(weights: DataFrame, most: float = 0.05) -> DataFrame:
    """Position limit: what a leg has over the limit flows to its names under it, in proportion, as far as it fits.

    The limit is at least the leg's mean weight. Of a leg sorted by size, the first j names are cut where the rest,
    scaled up, stays under the limit: one running sum finds the least such j.
    """
    rows = weights.withColumns({"leg": F.signum("weight"), "a": F.abs("weight")})
    w = Window.partitionBy(B, "date", "leg")
    by = w.orderBy(F.desc("a"), "ticker")
    rows = rows.withColumns({"total": F.sum("a").over(w), "n": F.count("*").over(w), "j": F.row_number().over(by) - 1, "above": F.coalesce(F.sum("a").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    rows = rows.withColumn("cap", F.greatest(F.lit(most), F.col("total") / F.col("n")))
    rows = rows.withColumn("scale", ratio(F.col("total") - F.col("j") * F.col("cap"), F.col("total") - F.col("above")))
    fits = F.col("a") * F.col("scale") <= F.col("cap") + 1e-12
    rows = rows.withColumn("cut", F.coalesce(F.min(F.when(fits, F.struct("j", "scale"))).over(w), F.struct(F.col("n").cast("int").alias("j"), F.lit(1.0).alias("scale"))))
    return rows.select(B, "date", "ticker", (F.col("leg") * F.when(F.col("j") < F.col("cut.j"), F.col("cap")).otherwise(F.col("a") * F.col("cut.scale"))).alias("weight"))


def active_scores(scores: DataFrame, membership: DataFrame) -> DataFrame:
    """Scores of members; a date that ``membership`` doesn't have takes all."""
    dates = membership.select("date").distinct().withColumn("known", F.lit(True))
    rows = scores.join(dates, "date", "left").join(membership.select("date", "ticker", "in_universe"), ["date", "ticker"], "left")
    return rows.where(F.col("known").isNull() | F.coalesce("in_universe", F.lit(False))).drop("known", "in_universe")


def drifted(weights: DataFrame, returns: DataFrame, schedule: DataFrame, double_drift: bool = True) -> DataFrame:
    """``backtest_name, date, ticker, target, drifted, g``: old weights after the period's returns beside the new.

    With ``double_drift`` the old weights drift twice, as in the turnover this reproduces.
    """
    index = schedule.withColumn("i", F.row_number().over(Window.orderBy("date")))  # one row for each rebalance date
    rows = weights.join(F.broadcast(index), "date")
    moved = rows.select(B, "ticker", (F.col("i") + 1).alias("i"), F.col("weight").alias("old"))
    now = rows.select(B, "ticker", "i", F.col("weight").alias("target"))
    names = rows.groupBy(B).agg(F.min("i").alias("first"), F.max("i").alias("last"))
    both = now.join(moved, [B, "ticker", "i"], "full").join(F.broadcast(names), B).where("i between first and last").join(F.broadcast(index), "i")
    both = both.join(returns.select("date", "ticker", F.col("simple_return").alias("r")), ["date", "ticker"], "left").fillna(0.0, ["old", "target", "r"])
    w = Window.partitionBy(B, "i")
    both = both.withColumn("g", F.sum(F.col("old") * F.col("r")).over(w))
    d1 = F.when(F.col("g") > -0.999, F.col("old") * (1 + F.col("r")) / (1 + F.col("g"))).otherwise(F.col("old"))
    both = both.withColumn("d1", d1)
    if double_drift:
        both = both.withColumn("g2", F.sum(F.col("d1") * F.col("r")).over(w)).withColumn("d1", F.when(F.col("g2") > -0.999, F.col("d1") * (1 + F.col("r")) / (1 + F.col("g2"))).otherwise(F.col("d1")))
    return both.select(B, "date", "i", "first", "ticker", "target", F.col("d1").alias("drifted"), "g")


def trades(moves: DataFrame) -> DataFrame:
    """``backtest_name, date, ticker, trade_type, weight_change, turnover_contribution``; none on the first date."""
    rows = moves.withColumn("c", F.round(F.col("target") - F.col("drifted"), 9)).where("c <> 0 and i > first")
    return rows.select(B, "date", "ticker", F.when(F.col("c") > 0, "buy").otherwise("sell").alias("trade_type"), F.col("c").alias("weight_change"), F.abs("c").alias("turnover_contribution"))


class CostModel(ABC):
    """What trading costs, as a share of the portfolio; one's own model overrides either part, as columns."""

    def of_trade(self, change: F.Column) -> F.Column:
        """Of one name's change of weight; summed over a date's trades."""
        return F.lit(0.0)

    @abstractmethod
    def of_turnover(self, turnover: F.Column) -> F.Column:
        """Of the sum of a date's absolute changes."""


@dataclass(frozen=True)
class LinearCost(CostModel):
    commission_bps: float = 5.0
    spread_bps: float = 10.0

    def of_turnover(self, turnover: F.Column) -> F.Column:
        return turnover * (self.commission_bps + self.spread_bps / 2) / 1e4


def backtest_results(moves: DataFrame, capital: float = 1e7, costs: CostModel = LinearCost()) -> DataFrame:
    """``backtest_name, date, gross_return, net_return, portfolio_value, drawdown, turnover, transaction_costs``.

    The first period's cost counts in the value at the start and again in the next period.
    """
    change = F.col("target") - F.col("drifted")
    rows = moves.groupBy(B, "date", "i", "first").agg(F.max("g").alias("g"), F.sum(F.abs(change)).alias("turnover"), F.sum(costs.of_trade(change)).alias("traded"))
    first = F.col("i") == F.col("first")
    w = Window.partitionBy(B).orderBy("date")
    rows = rows.withColumn("tc", costs.of_turnover(F.col("turnover")) + F.col("traded"))
    net = F.when(first, -F.col("tc")).otherwise((1 + F.col("g")) * (1 - F.lag("tc").over(w)) - 1)
    rows = rows.withColumn("net", net).withColumn("value", capital * F.product(1 + F.col("net")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    peak = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(B, "date", F.when(first, 0.0).otherwise(F.col("g")).alias("gross_return"), F.col("net").alias("net_return"), F.col("value").alias("portfolio_value"), (F.col("value") / peak - 1).alias("drawdown"), "turnover", F.col("tc").alias("transaction_costs"))


def backtest_metrics(results: DataFrame, per_year: int = 12) -> DataFrame:
    """Tall ``backtest_name, metric_name, value``; the first period counts in turnover only."""
    w = Window.partitionBy(B).orderBy("date")
    rows = results.withColumn("k", F.row_number().over(w)).withColumns({"net": F.when(F.col("k") > 1, F.col("net_return")), "gross": F.when(F.col("k") > 1, F.col("gross_return"))})
    rows = rows.withColumn("eq", F.product(1 + F.col("net")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("dd", F.col("eq") / F.max("eq").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    a = rows.groupBy(B).agg(F.count("net").alias("n"), (F.product(1 + F.col("net")) - 1).alias("cumulative_return_net"), (F.product(1 + F.col("gross")) - 1).alias("cumulative_return_gross"), F.avg("net").alias("mean"), F.coalesce(F.stddev_samp("net"), F.lit(0.0)).alias("sd"), F.sqrt(F.avg(F.when(F.col("net") < 0, F.col("net") * F.col("net")))).alias("down"), F.coalesce(F.min("dd"), F.lit(0.0)).alias("max_drawdown"), F.avg(F.when(F.col("net").isNotNull(), (F.col("net") > 0).cast("double"))).alias("win_rate"), F.avg("turnover").alias("average_turnover"))
    year = F.lit(float(per_year))
    a = a.withColumn("cagr_net", F.when(F.col("n") > 0, F.pow(1 + F.col("cumulative_return_net"), year / F.col("n")) - 1))
    m = {"annualized_volatility": F.col("sd") * F.sqrt(year), "sharpe_ratio": F.when(F.col("sd") <= 1e-12, 0.0).otherwise(F.col("mean") / F.col("sd") * F.sqrt(year)), "sortino_ratio": F.coalesce(ratio(F.col("mean"), F.col("down")) * F.sqrt(year), F.lit(0.0)), "calmar_ratio": F.when(F.abs("max_drawdown") > 1e-12, F.col("cagr_net") / F.abs("max_drawdown")), "annualized_turnover": F.col("average_turnover") * year}
    names = ["cumulative_return_net", "cumulative_return_gross", "cagr_net", "max_drawdown", "win_rate", "average_turnover", *m]
    return a.withColumns(m).unpivot([B], names, "metric_name", "value")


def annual_perf(results: DataFrame) -> DataFrame:
    """``backtest_name, year, annual_return, volatility, sharpe, max_drawdown``; a single set-up row is skipped."""
    w = Window.partitionBy(B, F.year("date")).orderBy("date")
    rows = results.withColumn("eq", F.product(1 + F.col("net_return")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"dd": F.col("eq") / F.max("eq").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1, "gap": F.datediff("date", F.lag("date").over(Window.partitionBy(B).orderBy("date"))), "k": F.row_number().over(Window.partitionBy(B).orderBy("date"))})
    span = rows.groupBy(B).agg(F.when(F.avg("gap") >= 5, 12.0).otherwise(252.0).alias("per"))
    rows = rows.groupBy(B, F.year("date").alias("year")).agg(F.count("*").alias("n"), F.min("k").alias("k"), (F.product(1 + F.col("net_return")) - 1).alias("annual_return"), F.coalesce(F.stddev_samp("net_return"), F.lit(0.0)).alias("sd"), F.avg("net_return").alias("mean"), F.min("dd").alias("max_drawdown"))
    rows = rows.join(span, B).where(~((F.col("n") == 1) & (F.col("k") == 1)))
    return rows.select(B, "year", "annual_return", (F.col("sd") * F.sqrt("per")).alias("volatility"), F.when(F.col("sd") > 1e-12, F.col("mean") / F.col("sd") * F.sqrt("per")).otherwise(0.0).alias("sharpe"), "max_drawdown")


def monthly_grid(results: DataFrame) -> DataFrame:
    """A row for each year: compounded net return by month (0 where absent) and of the year."""
    rows = results.withColumns({"year": F.year("date"), "m": F.month("date")})
    grid = rows.groupBy(B, "year").pivot("m", list(range(1, 13))).agg(F.product(1 + F.col("net_return")) - 1).fillna(0.0)
    total = rows.groupBy(B, "year").agg((F.product(1 + F.col("net_return")) - 1).alias("total"))
    return grid.select(B, "year", *[F.col(str(i)).alias(f"m{i:02}") for i in range(1, 13)]).join(total, [B, "year"])


def run(scores: DataFrame, returns: DataFrame, membership: DataFrame | None = None, frequency: str = "monthly", long_short: bool = False) -> DataFrame:
    """The moves (see :func:`drifted`) of all backtests in ``scores`` (backtest_name, date, ticker, score)."""
    common = scores.select("date").distinct().join(returns.select("date").distinct(), "date", "left_semi")
    schedule = rebalance_schedule(common, frequency)
    rows = scores.join(F.broadcast(schedule), "date", "left_semi")
    if membership is not None:
        rows = active_scores(rows, membership)
    return drifted((long_short_weights if long_short else topk_weights)(rows), returns, schedule)
