"""Column and frame helpers: as-of fill, guarded moments and correlations, ranks and quantiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def by_ticker(*more: str):
    return Window.partitionBy("ticker", *more).orderBy("date")


def ratio(a, b) -> Column:
    """a / b; null where b is 0 or either is null."""
    return F.try_divide(a, b)


def with_gaps(rows: DataFrame, value: str, n: int, least: int, last: DataFrame) -> DataFrame:
    """``rows`` (ticker, i, ...) and a row for each place of the calendar without one where still ``least`` of the last
    ``n`` places have a ``value``; what else the added rows have is null. ``last`` (last) is the calendar's last place.

    A window over the last n places needs no other rows than these: where fewer have values its result is null. There
    are at most n / least of them for each value, however long and sparse the calendar is.
    """
    w = Window.partitionBy("ticker").orderBy("i")
    full = F.count(value).over(w.rangeBetween(-n + 1, 0)) >= least
    marked = rows.select("ticker", "i", full.alias("full"), F.lead("i").over(w).alias("next")).crossJoin(F.broadcast(last))  # one row
    end = F.least(F.coalesce(F.col("next") - 1, F.col("last")), F.col("i") + n - least)
    gaps = marked.where(F.col("full") & (end > F.col("i"))).select("ticker", F.explode(F.sequence(F.col("i") + 1, end)).alias("i"))
    return rows.unionByName(gaps, allowMissingColumns=True)


def recent(n: int):
    """The window of a ticker's last ``n`` places of the calendar, by the places' numbers ``i``."""
    return Window.partitionBy("ticker").orderBy("i").rangeBetween(-n + 1, 0)


def asof_fill(target: DataFrame, source: DataFrame, cols: list[str], key: str = "ticker") -> DataFrame:
    """``target`` (key, date, ...) with each field's last non-null value of ``source`` at or before its date.

    One union and one window: the rows of a source sort before the targets of the same date.
    """
    own = [c for c in target.columns if c not in cols]
    rows = target.select(*own).withColumn("_t", F.lit(1)).unionByName(source.select(key, "date", *cols).withColumn("_t", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("date", "_t").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*own, "_t", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols]).where("_t = 1").drop("_t")


def corr(x, y) -> Column:
    """Pearson correlation of pairs without nulls; null where either is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull() if isinstance(x, str) else x.isNotNull() & y.isNotNull()
    a, b = F.when(both, F.col(x) if isinstance(x, str) else x), F.when(both, F.col(y) if isinstance(y, str) else y)
    return ratio(F.covar_samp(a, b), F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))


def average_rank(col: str, keys: list[str]) -> Column:
    """Rank within ``keys``; ties get the mean of their places."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(col)) + (F.count("*").over(Window.partitionBy(*keys, col)) - 1) / 2


def spearman(rows: DataFrame, x: str, y: str, keys: list[str], least: int = 3, name: str = "ic") -> DataFrame:
    """Rank correlation by ``keys`` over pairs without nulls; groups under ``least`` pairs are left out."""
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumns({"_x": average_rank(x, keys), "_y": average_rank(y, keys)})
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), corr("_x", "_y").alias(name)).where(F.col("n") >= least)


def ordered_counts(rows: DataFrame, value: str, keys: list[str], scratch: Scratch) -> DataFrame:
    """``keys, value, c, before, n``: each distinct non-null value of a group, how often it occurs, how many values of the
    group are less, and how many there are; written.

    Distinct values are sorted by ranges, so no task orders a whole group; sums of the ranges (a row for each range and
    group) give each its offset.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    parts = scratch.write(counts.repartitionByRange(*keys, value).withColumn("part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy(*keys, "part").agg(F.sum("c").alias("own"))
    w = Window.partitionBy(*keys)
    earlier = w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "part", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("offset"), F.sum("own").over(w).alias("n"))
    within = Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("less", F.coalesce(F.sum("c").over(within), F.lit(0))).join(sums, [*keys, "part"])
    return scratch.write(placed.select(*keys, value, "c", (F.col("offset") + F.col("less")).alias("before"), "n"), "placed")


def pooled_ranks(rows: DataFrame, value: str, keys: list[str], scratch: Scratch, name: str = "rank") -> DataFrame:
    """``rows`` with the average rank of ``value`` in its group of any size; rows without a value are left out."""
    ranks = ordered_counts(rows, value, keys, scratch)
    return rows.join(ranks.select(*keys, value, (F.col("before") + (F.col("c") + 1) / 2).alias(name)), [*keys, value])


def pooled_quantiles(rows: DataFrame, value: str, shares: list[float], scratch: Scratch) -> DataFrame:
    """``i, quantile`` of all values, exactly, for each of ``shares`` (i counts them); between values it lies in proportion."""
    place = F.transform(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)]), lambda a: F.struct(a["i"].alias("i"), (a["p"] * (F.col("n") - 1)).alias("at")))
    holds = lambda at: (at >= F.col("before")) & (at < F.col("before") + F.col("c"))
    found = ordered_counts(rows, value, [], scratch).withColumn("a", F.explode(F.filter(place, lambda a: holds(F.floor(a["at"])) | holds(F.ceil(a["at"])))))
    low, high = (F.max(F.when(holds(f("a.at")), F.col(value))) for f in (F.floor, F.ceil))
    return found.groupBy("a.i", "a.at").agg(low.alias("low"), high.alias("high")).select("i", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("quantile"))


def skew(col) -> Column:
    """Bias-corrected skewness; null under three values or without spread."""
    n = F.count(col)
    return F.when(n >= 3, F.skewness(col) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def kurt(col) -> Column:
    """Bias-corrected excess kurtosis; null under four values."""
    n = F.count(col).cast("double")
    return F.when(n >= 4, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col) + 6))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rounded(df: DataFrame, digits: dict[str, int] | None = None, default: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums doesn't show; minus zero becomes zero."""
    return df.select(*[(F.round(c, (digits or {}).get(c, default)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
