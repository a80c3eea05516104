"""Factor evaluation: rank correlations, quintile returns, decay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio, spearman, union
from .returns import calendar

KEYS = ["factor_name", "date"]


def forward_returns(returns: DataFrame) -> DataFrame:
    """``date, ticker, fwd``: returns, put on the panel's date before."""
    dates = calendar(returns)
    then = returns.join(dates, "date").select("ticker", (F.col("i") - 1).alias("i"), F.col("simple_return").alias("fwd"))
    return then.join(dates, "i").select("date", "ticker", "fwd")


def paired(scores: DataFrame, returns: DataFrame, score: str = "final_score") -> DataFrame:
    """``factor_name, date, ticker, score, fwd`` of the dates and tickers that have returns; fwd may be null."""
    rows = scores.select("factor_name", "date", "ticker", F.col(score).alias("score"))
    for key in ("date", "ticker"):
        rows = rows.join(returns.select(key).distinct(), key, "left_semi")
    return rows.join(forward_returns(returns), ["date", "ticker"], "left")


def ic_series(scores: DataFrame, returns: DataFrame, score: str = "final_score", least: int = 3) -> DataFrame:
    """``factor_name, date, ic, n``: rank correlation of scores with the next date's returns."""
    return spearman(paired(scores, returns, score), "score", "fwd", KEYS, least).select(*KEYS, "n", "ic")


def ic_summary(ics: DataFrame) -> DataFrame:
    sd = F.stddev_samp("ic")
    return ics.groupBy("factor_name").agg(F.avg("ic").alias("mean_ic"), sd.alias("std_ic"), F.when(sd == 0, 0.0).otherwise(ratio(F.avg("ic"), sd)).alias("icir"), F.count("ic").alias("n_dates"))


def buckets(scores: DataFrame, n: int = 5) -> DataFrame:
    """``scores`` with ``q`` from 0 to n - 1 by ranks (ties by ticker); dates under ``n`` scores are left out."""
    rows = scores.where("score is not null")
    rows = rows.withColumns({"r": F.row_number().over(Window.partitionBy(*KEYS).orderBy("score", "ticker")), "m": F.count("*").over(Window.partitionBy(*KEYS))})
    return rows.where(F.col("m") >= n).withColumn("q", F.greatest(F.expr(f"({n} * (r - 1) + (m - 2)) div (m - 1)"), F.lit(1)) - 1).drop("r", "m")


def quintile_returns(scores: DataFrame, returns: DataFrame, score: str = "final_score") -> DataFrame:
    """``factor_name, date, return_q1, return_q5, return_ls``, dated with the next month-end."""
    rows = buckets(paired(scores, returns, score))
    rows = rows.groupBy(*KEYS).agg(F.avg(F.when(F.col("q") == 0, F.col("fwd"))).alias("return_q1"), F.avg(F.when(F.col("q") == 4, F.col("fwd"))).alias("return_q5"))
    return rows.select("factor_name", F.last_day(F.date_add("date", 1)).alias("date"), "return_q1", "return_q5", (F.col("return_q5") - F.col("return_q1")).alias("return_ls"))


def quintile_sharpe(quintiles: DataFrame) -> DataFrame:
    """Annualised ratio of mean to population deviation; 0 without spread or with a null in the series."""
    def of(c):
        sd = F.stddev_pop(c)
        return F.when((F.count(c) == F.count("*")) & (sd > 0), F.sqrt(F.lit(12.0)) * F.avg(c) / sd).otherwise(0.0).alias(c.replace("return", "sharpe"))

    return quintiles.groupBy("factor_name").agg(*map(of, ("return_q1", "return_q5", "return_ls")))


def score_autocorr(scores: DataFrame, lags: int = 6, score: str = "final_score") -> DataFrame:
    """``factor_name, lag, autocorr``: mean rank correlation of scores with those some score dates before; else 0."""
    rows = scores.select("factor_name", "date", "ticker", F.col(score).alias("s"))
    index = rows.select("factor_name", "date").distinct().withColumn("i", F.row_number().over(Window.partitionBy("factor_name").orderBy("date")))
    rows = rows.join(index, ["factor_name", "date"]).select("factor_name", "i", "ticker", "s")
    later = rows.select("factor_name", "ticker", F.col("s").alias("s2"), "i", F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"))
    pairs = rows.join(later.withColumn("i", F.col("i") - F.col("lag")), ["factor_name", "ticker", "i"])
    each = spearman(pairs, "s", "s2", ["factor_name", "i", "lag"], 3, "ac")
    grid = rows.select("factor_name").distinct().withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags))))
    return grid.join(each.groupBy("factor_name", "lag").agg(F.avg("ac").alias("autocorr")), ["factor_name", "lag"], "left").fillna(0.0, ["autocorr"])


def half_life(autocorr: DataFrame) -> DataFrame:
    """Half-life in months of an exponential decay fitted through the positive autocorrelations; 0 if there is none."""
    x, y = -F.col("lag"), F.ln("autocorr")
    rows = autocorr.groupBy("factor_name").agg(F.count_if(F.col("autocorr") > 0).alias("n"), F.sum(F.when(F.col("autocorr") > 0, x * y)).alias("xy"), F.sum(F.when(F.col("autocorr") > 0, x * x)).alias("xx"))
    rate = ratio(F.col("xy"), F.col("xx"))
    return rows.select("factor_name", F.when((F.col("n") >= 2) & (rate > 0), F.ln(F.lit(2.0)) / rate).otherwise(0.0).alias("half_life"))


def stage_metrics(scores: DataFrame, returns: DataFrame, score: str) -> DataFrame:
    """``factor_name, date, metric_name, value``: the dated series ic and return_q1, _q5, _ls, and at the last date with
    scores and returns ic_mean, ic_std, icir, sharpe_q1, _q5, _ls, half_life and autocorr_lag1 to 6."""
    key = ["factor_name", "date"]
    ics, quintiles, decay = ic_series(scores, returns, score), quintile_returns(scores, returns, score), score_autocorr(scores, score=score)
    series = [ics.select(*key, F.lit("ic").alias("metric_name"), F.col("ic").alias("value")), quintiles.unpivot(key, ["return_q1", "return_q5", "return_ls"], "metric_name", "value")]
    summaries = [
        ic_summary(ics).select("factor_name", F.col("mean_ic").alias("ic_mean"), F.col("std_ic").alias("ic_std"), "icir"),
        quintile_sharpe(quintiles.where("return_ls is not null")), half_life(decay),
        decay.groupBy("factor_name").pivot("lag", list(range(1, 7))).agg(F.first("autocorr")).withColumnsRenamed({str(k): f"autocorr_lag{k}" for k in range(1, 7)})]
    tall = union([t.unpivot(["factor_name"], t.columns[1:], "metric_name", "value") for t in summaries])
    end = paired(scores, returns, score).groupBy("factor_name").agg(F.max("date").alias("date"))
    return union([*series, tall.join(end, "factor_name").select(*key, "metric_name", "value")])


def factor_metrics(scores: DataFrame, returns: DataFrame) -> DataFrame:
    """Tall ``factor_name, date, stage, metric_name, value`` of the raw and the final scores (see stage_metrics)."""
    return union([stage_metrics(scores, returns, f"{stage}_score").withColumn("stage", F.lit(stage)) for stage in ("raw", "final")])
