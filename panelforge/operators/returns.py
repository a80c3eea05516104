"""Dense panels, returns, the investable universe and panel statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import asof_fill, by_ticker, corr, kurt, pooled_quantiles, ratio, recent, skew, with_gaps
from ..sources.scratch import Scratch


def dense_grid(prices: DataFrame, cols=("adj_close", "volume")) -> DataFrame:
    """Every date of the panel with every ticker; absent cells are null. Shifts then count calendar rows.

    A ticker's rows lie in the order of the calendar, and each also makes the empty cells up to the next one (the first
    those before it too). So only the rows there are get shuffled and sorted, not the product of dates and tickers.
    """
    dates = calendar(prices)
    rows = prices.select(F.col("date").alias("day"), "ticker", *cols).join(F.broadcast(dates), F.col("day").eqNullSafe(F.col("date")))  # one row for each date
    own = Window.partitionBy("ticker").orderBy("i")
    last = dates.agg(F.max("i").alias("last"))
    rows = rows.crossJoin(F.broadcast(last)).withColumns({"from": F.when(F.row_number().over(own) == 1, F.lit(1)).otherwise(F.col("i")), "to": F.greatest(F.coalesce(F.lead("i").over(own) - 1, F.col("last")), "i")})
    cells = rows.select("ticker", "i", "day", *cols, F.explode(F.sequence("from", "to")).alias("at"))
    there = (F.col("at") == F.col("i")) & F.col("day").isNotNull() & F.col("ticker").isNotNull()  # a null key has no cells of its own
    cells = cells.select("at", "ticker", *[F.when(there, F.col(c)).alias(c) for c in cols])
    return cells.join(F.broadcast(dates.withColumnRenamed("i", "at")), "at").select("date", "ticker", *cols)


def with_returns(rows: DataFrame, price: str = "adj_close") -> DataFrame:
    before = F.lag(price).over(by_ticker())
    change = ratio(F.col(price), before)
    return rows.withColumns({"log_return": F.when(change > 0, F.ln(change)), "simple_return": change - 1})


def calendar(prices: DataFrame) -> DataFrame:
    """``date, i``: the panel's dates, numbered."""
    return prices.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))  # one row for each date


def changes(prices: DataFrame, dates: DataFrame) -> DataFrame:
    """``date, ticker, i, adj_close, change``: the price over that of the calendar's date before; null where either is absent.

    The rows there are suffice: the one before counts if its date is the one before.
    """
    rows = prices.select("date", "ticker", "adj_close").join(dates, "date")
    before = F.when(F.lag("i").over(by_ticker()) == F.col("i") - 1, F.lag("adj_close").over(by_ticker()))
    return rows.withColumn("change", ratio(F.col("adj_close"), before))


def daily_returns(prices: DataFrame) -> DataFrame:
    """``date, ticker, log_return, simple_return`` against the previous calendar row; a return needs both prices."""
    rows = changes(prices, calendar(prices)).where("change is not null")
    return rows.select("date", "ticker", F.when(F.col("change") > 0, F.ln("change")).alias("log_return"), (F.col("change") - 1).alias("simple_return"))


def month_ends(prices: DataFrame) -> DataFrame:
    """``date`` (calendar month-end), ``ticker``, ``px``: the last price carried forward; an empty month is null."""
    span = prices.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null")
    months = span.select(F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m")).select(F.last_day("m").alias("date"))
    months = months.join(prices.select(F.last_day("date").alias("date"), F.lit(True).alias("traded")).distinct(), "date", "left")
    rows = asof_fill(months.crossJoin(prices.select("ticker").distinct()), prices, ["adj_close"])
    return rows.select("date", "ticker", F.when(F.col("traded"), F.col("adj_close")).alias("px"))


def returns_of_months(months: DataFrame) -> DataFrame:
    """``date, ticker, log_return, simple_return`` of rows of :func:`month_ends`."""
    return with_returns(months, "px").select("date", "ticker", "log_return", "simple_return").dropna("all", subset=["log_return", "simple_return"])


def monthly_returns(prices: DataFrame) -> DataFrame:
    return returns_of_months(month_ends(prices))


def stored_returns(prices: DataFrame) -> DataFrame:
    """Both frequencies in one table with ``freq``."""
    return daily_returns(prices).withColumn("freq", F.lit("daily")).unionByName(monthly_returns(prices).withColumn("freq", F.lit("monthly")))


def validate_index(returns: DataFrame, index: str = "^GSPC", least: float = 0.3) -> DataFrame:
    """``index_ticker, correlation, valid``: of the mean return with the index's.

    Without the index the first ticker stands in, and then the mean holds it too.
    """
    pick = returns.agg(F.coalesce(F.max(F.when(F.col("ticker") == index, F.lit(index))), F.min("ticker")).alias("pick"), F.max(F.col("ticker") == index).alias("there"))
    rows = returns.crossJoin(F.broadcast(pick))  # one row
    day = rows.groupBy("date").agg(F.avg(F.when(~(F.col("there") & (F.col("ticker") == F.col("pick"))), F.col("simple_return"))).alias("mean"), F.max(F.when(F.col("ticker") == F.col("pick"), F.col("simple_return"))).alias("own"), F.first("pick").alias("pick"))
    return day.groupBy(F.col("pick").alias("index_ticker")).agg(corr("mean", "own").alias("correlation")).withColumn("valid", F.coalesce(F.col("correlation") >= least, F.lit(False)))


def universe_membership(prices: DataFrame, min_cap_bn: float = 0.0, percentile: float = 50.0, ipo_months: float = 12, lookback: int = 60, listed: DataFrame | None = None) -> DataFrame:
    """``date, ticker, in_universe, market_cap_proxy, avg_dollar_vol, days_since_first_price`` of priced rows.

    The threshold is the percentile over all average dollar volumes of the date, unpriced tickers included. ``listed``
    (ticker, first) tells of first prices that ``prices`` doesn't reach back to.
    """
    dates = calendar(prices)
    rows = prices.join(dates, "date").select("ticker", "i", "date", "adj_close", (F.col("adj_close") * F.col("volume")).alias("dv"))
    first = F.min(F.when(F.col("adj_close").isNotNull(), F.col("date"))).over(Window.partitionBy("ticker"))
    rows = rows.withColumn("first", first)
    if listed is not None:
        known = listed.select("ticker", F.col("first").alias("known"))
        rows = rows.join(known, "ticker", "left").withColumn("first", F.least("first", "known")).drop("known")
    least, w = lookback // 2, recent(lookback)
    rows = with_gaps(rows, "dv", lookback, least, dates.agg(F.max("i").alias("last")))
    rows = rows.withColumn("adv", F.when(F.count("dv").over(w) >= least, F.avg("dv").over(w)))
    bar = rows.groupBy("i").agg(F.percentile("adv", percentile / 100).alias("bar"))
    rows = rows.where("adj_close is not null").join(bar, "i", "left")
    days, cap = F.datediff("date", "first"), F.col("adv") / 1e9
    inside = (cap >= min_cap_bn) & (F.col("adv") >= F.col("bar")) & (days >= ipo_months * 30.44)
    return rows.select("date", "ticker", F.coalesce(inside, F.lit(False)).alias("in_universe"), cap.alias("market_cap_proxy"), F.col("adv").alias("avg_dollar_vol"), days.alias("days_since_first_price"))


def inclusion(membership: DataFrame) -> DataFrame:
    """``date, n_members, n_total, inclusion_rate``."""
    rows = membership.groupBy("date").agg(F.count_if("in_universe").alias("n_members"), F.count("*").alias("n_total"))
    return rows.withColumn("inclusion_rate", ratio(F.col("n_members"), F.col("n_total")))


def asof_membership(dates: DataFrame, membership: DataFrame) -> DataFrame:
    """Membership at ``dates`` (date, ticker): the last known one; pairs before the first are dropped."""
    flags = membership.select("date", "ticker", "in_universe")
    return asof_fill(dates.select("date", "ticker"), flags, ["in_universe"]).where("in_universe is not null")


def panel(returns: DataFrame, value: str = "simple_return") -> DataFrame:
    """Dense ``date, ticker, value``; raises ValueError for an absent column, and fails when it runs if a cell has two rows."""
    absent = {"date", "ticker", value} - set(returns.columns)
    if absent:
        raise ValueError(f"no column {', '.join(sorted(absent))}")
    twice = F.raise_error(F.concat(F.lit("two rows of "), F.col("ticker"), F.lit(" on "), F.col("date").cast("string")))
    rows = returns.groupBy("date", "ticker").agg(F.when(F.count("*") == 1, F.max(value)).otherwise(twice).alias("value"))
    return dense_grid(rows, ("value",))


def fill_gaps(rows: DataFrame, method: str = "none", most: int = 5) -> DataFrame:
    """none: as is; zero: nulls become 0; drop_cols: tickers with over ``most`` nulls in a row go."""
    if method == "none":
        return rows
    if method == "zero":
        return rows.fillna(0.0, ["value"])
    if method != "drop_cols":
        raise ValueError(f"unknown method {method}")
    island = F.row_number().over(by_ticker()) - F.row_number().over(Window.partitionBy("ticker", F.col("value").isNull()).orderBy("date"))
    bad = rows.withColumn("island", island).where("value is null").groupBy("ticker", "island").count().where(F.col("count") > most).select("ticker").distinct()
    return rows.join(bad, "ticker", "left_anti")


def trim_by_universe(rows: DataFrame, membership: DataFrame) -> DataFrame:
    """Values of non-members become null; no row in ``membership`` counts as no member."""
    rows = rows.join(membership.select("date", "ticker", "in_universe"), ["date", "ticker"], "left")
    return rows.withColumn("value", F.when(F.col("in_universe"), F.col("value"))).drop("in_universe")


def xs_stats(rows: DataFrame) -> DataFrame:
    """Cross-sectional statistics by date; a date without values has nulls only."""
    n = F.count("value")
    out = rows.groupBy("date").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.median("value").alias("median"), skew("value").alias("skewness"), kurt("value").alias("excess_kurtosis"), F.avg(F.when(F.col("value").isNotNull(), (F.col("value") > 0).cast("double"))).alias("pct_positive"), F.when(n > 0, n).alias("n_stocks"))
    return out


def annual_stats(rows: DataFrame, least: int = 10) -> DataFrame:
    """Pooled moments by year; years with fewer than ``least`` values are skipped."""
    rows = rows.where("value is not null").groupBy(F.year("date").alias("year"))
    rows = rows.agg(F.count("*").alias("n_obs"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), skew("value").alias("skewness"), kurt("value").alias("excess_kurtosis"), F.min("value").alias("min"), F.max("value").alias("max"))
    return rows.where(F.col("n_obs") >= least)


def distribution_tests(rows: DataFrame) -> DataFrame:
    """Jarque-Bera statistic with its p-value, and pooled percentiles."""
    rows = rows.where("value is not null")
    jb = F.count("*") / 6 * (F.pow(F.skewness("value"), 2) + F.pow(F.kurtosis("value"), 2) / 4)
    shares = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    points = pooled_quantiles(rows, "value", list(shares.values()), Scratch(rows.sparkSession))
    points = points.agg(*[F.max(F.when(F.col("i") == i, F.col("quantile"))).alias(c) for i, c in enumerate(shares)])
    out = rows.agg(F.count("*").alias("n"), jb.alias("jarque_bera")).crossJoin(F.broadcast(points))  # one row each
    return out.select("n", "jarque_bera", F.exp(-F.col("jarque_bera") / 2).alias("p_value"), *shares)


def panel_summary(rows: DataFrame) -> DataFrame:
    """Shape of a panel: dates, tickers, values, years."""
    return rows.agg(F.countDistinct("date").alias("n_dates"), F.countDistinct("ticker").alias("n_tickers"), F.count("value").alias("n_values"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct(F.year("date")).alias("n_years"))
