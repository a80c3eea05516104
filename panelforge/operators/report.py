"""Comparison of methods, and the numbers behind charts: histograms, quantile pairs, drawdown spans, activity by month."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import pooled_quantiles, ratio, union
from ..sources.scratch import Scratch

B = "backtest_name"


def comparison(results: DataFrame, start: str, per_year: int = 12) -> DataFrame:
    """``backtest_name, full_sharpe, full_max_dd, oos_sharpe, oos_max_dd`` of backtests' results.

    The first period is a set-up and doesn't count; out of sample is from date ``start`` on, null where nothing is.
    """
    k = F.row_number().over(Window.partitionBy(B).orderBy("date"))
    rows = results.withColumn("k", k).where("k > 1").select(B, "date", F.col("net_return").alias("net"))
    rows = union([rows.withColumn("scope", F.lit("full")), rows.where(F.col("date") >= F.lit(start)).withColumn("scope", F.lit("oos"))])
    w = Window.partitionBy(B, "scope").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("eq", F.product(1 + F.col("net")).over(w))
    rows = rows.withColumn("dd", F.col("eq") / F.max("eq").over(w) - 1)
    sd = F.coalesce(F.stddev_samp("net"), F.lit(0.0))
    sharpe = F.when(sd <= 1e-12, 0.0).otherwise(F.avg("net") / sd * F.sqrt(F.lit(float(per_year))))
    wide = rows.groupBy(B).pivot("scope", ["full", "oos"]).agg(sharpe.alias("sharpe"), F.min("dd").alias("max_dd"))
    return wide.select(B, "full_sharpe", "full_max_dd", "oos_sharpe", "oos_max_dd")


def histogram(panel: DataFrame, bins: int = 50) -> DataFrame:
    """``bin, low, high, n`` of the panel's ``value``: bins of one width from the least to the largest."""
    span = panel.agg(F.min("value").alias("a"), F.max("value").alias("b"))
    rows = panel.where("value is not null").crossJoin(F.broadcast(span))  # one row
    place = F.floor(ratio(F.col("value") - F.col("a"), F.col("b") - F.col("a")) * bins)
    rows = rows.withColumn("bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int"))
    width = (F.col("b") - F.col("a")) / bins
    counts = rows.groupBy("bin", "a", "b").agg(F.count("*").alias("n"))
    return counts.select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), "n")


def normal_quantiles(panel: DataFrame, points: int = 19) -> DataFrame:
    """``p, theoretical, observed``: quantiles of the panel's ``value`` against the normal of its mean and deviation."""
    ps = [(i + 1) / (points + 1) for i in range(points)]
    z = panel.sparkSession.createDataFrame([(i, p, NormalDist().inv_cdf(p)) for i, p in enumerate(ps)], "i int, p double, z double")
    one = panel.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    rows = z.crossJoin(F.broadcast(one)).join(F.broadcast(pooled_quantiles(panel, "value", ps, Scratch(panel.sparkSession))), "i", "left")  # a row for each point
    return rows.select("p", (F.col("m") + F.col("s") * F.col("z")).alias("theoretical"), F.col("quantile").alias("observed"))


def drawdown_spans(results: DataFrame) -> DataFrame:
    """``backtest_name, start_date, end_date, n_dates, depth``: runs of dates below the last peak."""
    w = Window.partitionBy(B).orderBy("date")
    rows = results.withColumn("under", F.col("drawdown") < -1e-12)
    rows = rows.withColumn("g", F.count_if(~F.col("under")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("under")
    spans = rows.groupBy(B, "g").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("n_dates"), F.min("drawdown").alias("depth"))
    return spans.drop("g")


def any_by_month(flags: DataFrame, flag: str) -> DataFrame:
    """``month, ticker, any_true`` of a boolean by date and ticker: whether it held on any date of the month; null is false."""
    rows = flags.groupBy(F.last_day("date").alias("month"), "ticker")
    return rows.agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("any_true"))


def markdown(rows: DataFrame, title: str, digits: int = 4) -> str:
    """A small result as a Markdown table."""
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    head = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join(head + ["| " + " | ".join(map(cell, r)) + " |" for r in rows.collect()]) + "\n"
