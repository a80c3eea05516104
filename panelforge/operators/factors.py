"""The eighteen factors: families of columns over one month-end or daily panel, and their processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import asof_fill, by_ticker, ratio, recent, with_gaps
from .returns import calendar, changes

YEAR = 252
PRICE = ["PriceMomentum", "ThreeMonthMomentum", "OneMonthReversal"]
VALUE = ["BookToPrice", "GrossProfitability", "EVtoEBITDA", "FCFYield", "DebtToEquityChange", "Accruals"]
RISK = ["LowVolatility", "MarketBeta", "IdiosyncraticVolatility", "YieldCurveSlopeBeta", "CreditSpreadBeta", "PMIMomentumBeta"]
EVENT = ["EarningsSurpriseSUE", "EarningsRevision", "InsiderBuyingRatio"]
FACTORS = sorted(PRICE + VALUE + RISK + EVENT)
STATEMENT = ["book_value", "gross_profit", "total_assets", "total_debt", "ebitda", "operating_cash_flow", "capital_expenditures", "net_income"]


def price_factors(months: DataFrame, long: int = 12, short: int = 3) -> DataFrame:
    """Momentum from the month before ``date`` back to 12 and 3 months, and last month's reversal."""
    back = lambda n: F.lag("px", n).over(by_ticker())
    long, short = (12 if long < 2 else long), (3 if short < 2 else short)
    return months.select("date", "ticker", (ratio(back(1), back(long)) - 1).alias("PriceMomentum"), (ratio(back(1), back(short)) - 1).alias("ThreeMonthMomentum"), (-(ratio(F.col("px"), back(1)) - 1)).alias("OneMonthReversal"))


def change_on_union(rows: DataFrame, value: str) -> DataFrame:
    """``date, ticker, value`` less the ticker's value on the previous of all dates in ``rows``."""
    rows = rows.select("date", "ticker", value).join(calendar(rows), "date")
    before = F.when(F.lag("i").over(by_ticker()) == F.col("i") - 1, F.lag(value).over(by_ticker()))
    return rows.select("date", "ticker", (F.col(value) - before).alias(value))


def value_factors(months: DataFrame, statements: DataFrame, metadata: DataFrame) -> DataFrame:
    """Factors of the last known statement fields, each field as of its own last report."""
    equity = F.when(F.col("book_value") != 0, F.col("book_value"))
    assets = F.when(F.col("total_assets") != 0, F.col("total_assets"))
    leverage = change_on_union(statements.select("date", "ticker", (F.col("total_debt") / equity).alias("leverage")), "leverage")
    reports = statements.withColumn("accruals", -(F.col("net_income") - F.col("operating_cash_flow")) / assets).join(leverage, ["date", "ticker"], "full")
    known = asof_fill(months, reports, [*STATEMENT, "accruals", "leverage"]).join(metadata.select("ticker", "shares_outstanding"), "ticker", "left")
    cap = F.col("px") * F.col("shares_outstanding")
    return known.select(
        "date", "ticker", ratio(F.col("book_value"), cap).alias("BookToPrice"), ratio(F.col("gross_profit"), F.col("total_assets")).alias("GrossProfitability"),
        ratio(F.col("ebitda"), cap + F.coalesce("total_debt", F.lit(0.0))).alias("EVtoEBITDA"),
        ratio(F.col("operating_cash_flow") - F.coalesce("capital_expenditures", F.lit(0.0)), cap).alias("FCFYield"),
        (-F.col("leverage")).alias("DebtToEquityChange"), F.col("accruals").alias("Accruals"))


def macro_wide(macro: DataFrame, dates: DataFrame, names: list[str]) -> DataFrame:
    """``date`` and one column per series on the calendar ``dates``, each carried forward."""
    wide = macro.groupBy("date").pivot("series_name", names).agg(F.first("value"))
    rows = dates.join(wide, "date", "left")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row for each date
    return rows.select("date", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in names])


def exposures(prices: DataFrame, market: DataFrame, macro: DataFrame) -> DataFrame:
    """Daily ``date, m, slope, spread, pmi``: the market's return and changes of macro series.

    The market is (mkt_rf + rf), or the mean return of all tickers where that table is empty.
    """
    dates = prices.select("date").distinct()
    wide, w = macro_wide(macro, dates, ["DGS10", "DGS2", "BAMLH0A0HYM2", "NAPM"]), Window.orderBy("date")
    span = dates.agg(F.least(F.lit(60), F.greatest(F.lit(1), F.expr("count(*) div 5"))).alias("k"))
    curve = F.col("DGS10") - F.col("DGS2")
    # the shift is a number of rows known only from the data: a self-join on the row number, one row for each date
    rows = wide.withColumn("i", F.row_number().over(w)).crossJoin(F.broadcast(span))
    then = rows.select((F.col("i") + F.col("k")).alias("i"), F.col("NAPM").alias("was"))
    rows = rows.withColumns({"s": curve, "h": F.col("BAMLH0A0HYM2")}).join(then, "i", "left").withColumn("mom", F.col("NAPM") - F.col("was"))
    rows = rows.select("date", *[(F.col(c) - F.lag(c).over(w)).alias(n) for c, n in (("s", "slope"), ("h", "spread"), ("mom", "pmi"))])
    own = market.select("date", (F.col("mkt_rf") + F.col("rf")).alias("m0"))
    mean = changes(prices, calendar(prices)).groupBy("date").agg(F.avg(F.col("change") - 1).alias("mean"))
    there = market.agg((F.count("mkt_rf") > 0).alias("there"))
    rows = rows.join(own, "date", "left").join(mean, "date", "left").crossJoin(F.broadcast(there))
    return rows.select("date", F.last(F.when(F.col("there"), F.col("m0")).otherwise(F.col("mean")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"), "slope", "spread", "pmi")


def risk_factors(prices: DataFrame, exposed: DataFrame) -> DataFrame:
    """Volatility and betas over the last 252 calendar rows, at month-ends.

    Covariances take the days on which both sides are known, variances all days of the other side.
    """
    dates, sides = calendar(prices), ("m", "slope", "spread", "pmi")
    span = Window.orderBy("i").rowsBetween(-YEAR + 1, 0)  # one row for each date
    market = exposed.join(dates, "date").withColumns({f"var_{x}": F.var_samp(x).over(span) for x in sides})
    rows = changes(prices, dates).select("ticker", "i", (F.col("change") - 1).alias("r"))
    ends = dates.groupBy(F.last_day("date").alias("date")).agg(F.max("i").alias("i"))
    asked = ends.crossJoin(prices.select("ticker").distinct()).withColumn("asked", F.lit(True))  # the result's rows
    rows = with_gaps(rows, "r", YEAR, YEAR // 2, dates.agg(F.max("i").alias("last"))).unionByName(asked, allowMissingColumns=True)
    rows = rows.join(F.broadcast(market.drop("date")), "i")  # one row for each date
    w = recent(YEAR)
    vol = F.when(F.count("r").over(w) >= YEAR // 2, F.stddev_samp("r").over(w))
    both = lambda x: F.covar_samp(F.when(F.col(x).isNotNull(), F.col("r")), F.when(F.col("r").isNotNull(), F.col(x))).over(w)
    beta = lambda x: ratio(both(x), F.nullif(F.col(f"var_{x}"), F.lit(0.0)))
    rows = rows.withColumns({"vol": vol, "var": F.var_samp("r").over(w), **{f"b_{x}": beta(x) for x in sides}})
    known = Window.partitionBy("ticker").orderBy("i").rangeBetween(Window.unboundedPreceding, 0)
    last = rows.withColumn("vol", F.last("vol", ignorenulls=True).over(known)).where("asked")
    idio = -F.sqrt(F.greatest(F.lit(0.0), F.col("var") - F.col("b_m") * F.col("b_m") * F.col("var_m")))
    return last.select("date", "ticker", (-F.col("vol")).alias("LowVolatility"), F.col("b_m").alias("MarketBeta"), F.when(F.col("b_m").isNotNull() & F.col("var").isNotNull(), idio).alias("IdiosyncraticVolatility"), F.col("b_slope").alias("YieldCurveSlopeBeta"), F.col("b_spread").alias("CreditSpreadBeta"), F.col("b_pmi").alias("PMIMomentumBeta"))


def insider_ratio(months: DataFrame, insiders: DataFrame, days: int = 60) -> DataFrame:
    """(bought - sold) / (bought + sold + 1e-5) over the days before each month-end; 0 without trades.

    A running range of days over daily sums replaces the range join.
    """
    text = F.lower("text")
    buy = text.contains("buy") | text.contains("purchase")
    sell = ~buy & (text.contains("sale") | text.contains("sell"))
    shares = F.coalesce("shares", F.lit(0.0))
    daily = insiders.groupBy("ticker", "date").agg(F.sum(F.when(buy, shares)).alias("b"), F.sum(F.when(sell, shares)).alias("s"))
    rows = months.select("ticker", "date").withColumn("t", F.lit(1)).unionByName(daily.withColumn("t", F.lit(0)), allowMissingColumns=True).withColumn("day", F.datediff("date", F.lit("1970-01-01")))
    w = Window.partitionBy("ticker").orderBy("day").rangeBetween(-days, 0)
    b, s = (F.coalesce(F.sum(c).over(w), F.lit(0.0)) for c in "bs")
    return rows.select("date", "ticker", "t", ((b - s) / (b + s + 1e-5)).alias("InsiderBuyingRatio")).where("t = 1").drop("t")


def event_factors(months: DataFrame, earnings: DataFrame, insiders: DataFrame) -> DataFrame:
    revision = change_on_union(earnings.select("date", "ticker", "eps_estimate"), "eps_estimate").withColumnRenamed("eps_estimate", "EarningsRevision")
    known = asof_fill(months.select("date", "ticker"), earnings.select("date", "ticker", F.col("surprise_pct").alias("EarningsSurpriseSUE")).join(revision, ["date", "ticker"], "full"), ["EarningsSurpriseSUE", "EarningsRevision"])
    return known.join(insider_ratio(months, insiders), ["date", "ticker"])


def raw_scores(families: list[DataFrame], names: list[str]) -> DataFrame:
    """``date, ticker, factor_name, raw_score`` of the columns ``names`` of all families, by one unpivot.

    Scores are rounded to 9 digits, so that equal ones tie.
    """
    wide = None
    for rows in families:
        rows = rows.select("date", "ticker", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in names if c in rows.columns])
        wide = rows if wide is None else wide.join(rows, ["date", "ticker"], "full")
    return wide.unpivot(["date", "ticker"], list(names), "factor_name", "raw_score")


KEYS = ["date", "factor_name"]


def winsorize(rows: DataFrame, value: str = "raw_score", low: float = 0.01, high: float = 0.01, keys=KEYS) -> DataFrame:
    """``winsorized_score``: ``value`` clipped to its cross-section's percentiles.

    By a window, as the scores after it: a join with the percentiles would make ``rows`` twice.
    """
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"_lo": F.percentile(value, low).over(w), "_hi": F.percentile(value, 1 - high).over(w)})
    return rows.withColumn("winsorized_score", F.when(F.col(value).isNotNull(), F.greatest(F.least(value, "_hi"), "_lo"))).drop("_lo", "_hi")


def zscore(rows: DataFrame, value: str = "winsorized_score", keys=KEYS) -> DataFrame:
    """``z_score``; 0 where the cross-section has no spread."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_samp(value).over(w)
    return rows.withColumn("z_score", F.when(F.col(value).isNotNull(), F.coalesce(ratio(F.col(value) - F.avg(value).over(w), F.when(sd > 1e-12, sd)), F.lit(0.0))))


def neutralize(rows: DataFrame, value: str = "z_score", keys=KEYS, size: bool = True, sector: bool = True) -> DataFrame:
    """``final_score``: what an intercept, log size and sector dummies don't explain of ``value``.

    Demeaning by sector and one slope (Frisch, Waugh and Lovell) equal the regression. Rows without a value or a
    positive size have none; a cross-section with no more rows than columns keeps its values.
    """
    rows = rows.withColumn("_x", F.when(F.col("size") > 0, F.ln("size")) if size else F.lit(0.0)).withColumn("_s", F.coalesce("sector", F.lit("Unknown")) if sector else F.lit(""))
    ok = F.col(value).isNotNull() & F.col("_x").isNotNull()
    rows = rows.withColumns({"_y": F.when(ok, F.col(value)), "_x": F.when(ok, F.col("_x")), "_s2": F.when(ok, F.col("_s"))})
    w, s = Window.partitionBy(*keys), Window.partitionBy(*keys, "_s")
    rows = rows.withColumns({"_xd": F.col("_x") - F.avg("_x").over(s), "_yd": F.col("_y") - F.avg("_y").over(s), "_n": F.count("_y").over(w), "_k": F.size(F.collect_set("_s2").over(w))})
    slope = ratio(F.sum(F.col("_xd") * F.col("_yd")).over(w), F.nullif(F.sum(F.round(F.col("_xd") * F.col("_xd"), 12)).over(w), F.lit(0.0)))
    few = F.col("_n") <= 1 + int(size) + F.col("_k") - 1
    rows = rows.withColumn("final_score", F.when(few, F.col("_y")).otherwise(F.col("_yd") - F.coalesce(slope, F.lit(0.0)) * F.col("_xd")))
    return rows.drop("_x", "_s", "_s2", "_y", "_xd", "_yd", "_n", "_k")


def sized(scores: DataFrame, months: DataFrame, metadata: DataFrame) -> DataFrame:
    """``scores`` with ``size`` (price times shares, else the column market_cap_proxy in billions, if there is one, else 1)
    and ``sector``."""
    rows = scores.join(months.select("date", "ticker", "px"), ["date", "ticker"], "left").join(metadata.select("ticker", "sector", "shares_outstanding"), "ticker", "left")
    proxy = [F.col("market_cap_proxy") * 1e9] if "market_cap_proxy" in scores.columns else []
    return rows.withColumn("size", F.coalesce(F.col("px") * F.col("shares_outstanding"), *proxy, F.lit(1.0))).drop("px", "shares_outstanding")


def factor_scores(raw: DataFrame, months: DataFrame, metadata: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """``date, ticker, factor_name, raw_score, winsorized_score, z_score, final_score`` of :func:`raw_scores`.

    ``active`` (date, ticker, in_universe, perhaps market_cap_proxy) limits the cross-sections to its members, and its proxy
    stands in for an unknown size; a cross-section without a score is left out.
    """
    rows = raw
    if active is not None:
        proxy = [c for c in active.columns if c == "market_cap_proxy"]
        rows = rows.join(active.where("in_universe").select("date", "ticker", *proxy), ["date", "ticker"])
    rows = rows.withColumn("_n", F.count("raw_score").over(Window.partitionBy(*KEYS))).where("_n > 0").drop("_n")
    rows = neutralize(zscore(winsorize(sized(rows, months, metadata))))
    out = ["raw_score", "winsorized_score", "z_score", "final_score"]
    return rows.select("date", "ticker", "factor_name", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in out])
