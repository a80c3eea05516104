"""Composite signals: feature panel, IC weights, cross-sectional regressions, boosted trees."""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
from abc import ABC, abstractmethod
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import corr, pooled_ranks, ratio, spearman, union
from ..sources.scratch import Scratch
from . import boost, boost_pieces
from .evaluate import forward_returns

def feature_panel(scores: DataFrame, returns: DataFrame, names: list[str], score: str = "final_score") -> DataFrame:
    """``date, ticker, fwd`` and a column for each factor in sorted order.

    Nulls become the date's median; rows that still have one, or no forward return, are dropped.
    """
    if not names:
        raise ValueError("no factors")
    names = sorted(names)
    wide = scores.groupBy("date", "ticker").pivot("factor_name", names).agg(F.first(score))
    medians = wide.groupBy("date").agg(*[F.median(c).alias(f"_{c}") for c in names])
    rows = wide.join(medians, "date").select("date", "ticker", *[F.coalesce(c, f"_{c}").alias(c) for c in names])
    return rows.join(forward_returns(returns), ["date", "ticker"]).dropna()


def long_panel(panel: DataFrame) -> DataFrame:
    names = [c for c in panel.columns if c not in ("date", "ticker", "fwd")]
    return panel.unpivot(["date", "ticker", "fwd"], names, "factor_name", "score")


def trailing(rows: DataFrame, value: str, lookback: int, lag: int, least: int) -> DataFrame:
    """``rows`` (date, factor_name, value) with ``mean`` over the last ``lookback`` dates; one row for each date and factor."""
    w = Window.partitionBy("factor_name").orderBy("date").rowsBetween(-lookback + 1 - lag, -lag)
    n = F.count(F.lit(1)).over(w)
    return rows.withColumn("mean", F.when(n >= least, F.avg(value).over(w)))


def ic_weights(panel: DataFrame, lookback: int = 36, lag: int = 0, least: int = 3) -> DataFrame:
    """``date, factor_name, weight``: trailing mean rank correlations, negative ones at 0, scaled to sum 1.

    If none is positive all weigh the same. ``lag`` 0 takes in the date's own forward return, as the method this
    reproduces does; 1 is free of look-ahead. Each date's correlation is computed once.
    """
    long = long_panel(panel)
    ics = spearman(long, "score", "fwd", ["date", "factor_name"], 5)
    grid = long.select("date", "factor_name").distinct().join(ics, ["date", "factor_name"], "left")
    rows = trailing(grid, "ic", lookback, lag, least).withColumn("m", F.greatest(F.col("mean"), F.lit(0.0)))
    w = Window.partitionBy("date")
    rows = rows.withColumns({"total": F.sum("m").over(w), "k": F.count("*").over(w), "some": F.max("mean").over(w)}).where("some is not null")
    return rows.select("date", "factor_name", F.when(F.col("total") > 0, F.coalesce("m", F.lit(0.0)) / F.col("total")).otherwise(1 / F.col("k")).alias("weight"))


def solved(system: F.Column, k: int, least: float = 1e-10) -> F.Column:
    """The unknowns of ``k`` linear equations: rows of k + 1 numbers, the last one the right side, of a symmetric positive
    semidefinite matrix with ones on its diagonal. An unknown whose pivot is ``least`` or less depends on others and is 0."""

    def eliminate(m, i):
        pivot = m[i][i]
        own = lambda r, j: F.when(j == i, F.transform(r, lambda x: x / pivot)).otherwise(F.zip_with(r, m[i], lambda x, y: x - y * r[i] / pivot))
        none = lambda r, j: F.when(j == i, F.transform(r, lambda x: x * 0)).otherwise(r)
        return F.when(pivot > least, F.transform(m, own)).otherwise(F.transform(m, none))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), system, eliminate)
    return F.transform(done, lambda r: r[k])


def regressions(panel: DataFrame) -> DataFrame:
    """``date, factor_name, beta`` of each date's regression of forward returns on all factors and an intercept.

    A date's correlations are one grouped sum, and elimination over them gives the coefficients; no date is gathered.
    Dates with fewer than K + 2 rows, or a factor without spread, are skipped; a factor that others determine gets 0.
    """
    names = [c for c in panel.columns if c not in ("date", "ticker", "fwd")]
    k, of = len(names), {n: f"s{i}" for i, n in enumerate([*names, "fwd"])}
    pairs = [(a, b) for i, a in enumerate(names) for b in [*names[i + 1 :], "fwd"]]
    name = lambda a, b: f"{of[a]}_{of[b]}" if (a, b) in pairs else f"{of[b]}_{of[a]}"
    flat = [F.bool_or(F.lit(False)), *[F.max(n) == F.min(n) for n in names]]
    sums = panel.groupBy("date").agg(F.count("*").alias("n"), F.greatest(*flat).alias("flat"), *[F.stddev_pop(n).alias(of[n]) for n in of], *[F.covar_pop(a, b).alias(name(a, b)) for a, b in pairs])
    sums = sums.where(~F.col("flat") & (F.col("n") >= k + 2)).withColumn("y", F.when(F.col(of["fwd"]) > 0, F.col(of["fwd"])).otherwise(1.0))
    scale = lambda n: F.col("y") if n == "fwd" else F.col(of[n])
    cell = lambda a, b: F.lit(1.0) if a == b else ratio(F.col(name(a, b)), scale(a) * scale(b))
    system = F.array(*[F.array(*[cell(a, b) for b in [*names, "fwd"]]) for a in names])
    beta = F.zip_with(solved(system, k), F.array(*[F.col(of[n]) for n in names]), lambda x, sd: ratio(x * F.col("y"), sd))
    rows = sums.select("date", F.arrays_zip(F.array(*map(F.lit, names)).alias("f"), beta.alias("b")).alias("z"))
    return rows.select("date", F.inline("z").alias("factor_name", "beta"))


def fama_macbeth_weights(betas: DataFrame, lookback: int = 36, lag: int = 0) -> DataFrame:
    """``date, factor_name, weight``: trailing mean coefficients, scaled so that their sizes sum to 1."""
    rows = trailing(betas, "beta", lookback, lag, 1)
    w = Window.partitionBy("date")
    total = F.sum(F.abs("mean")).over(w)
    return rows.withColumn("weight", F.coalesce(ratio(F.col("mean"), F.nullif(total, F.lit(0.0))), 1 / F.count("*").over(w))).select("date", "factor_name", "weight")


def composite(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """``date, ticker, composite_score``: weighted sum of scores."""
    rows = long_panel(panel).join(weights, ["date", "factor_name"])
    return rows.groupBy("date", "ticker").agg(F.sum(F.col("weight") * F.coalesce("score", F.lit(0.0))).alias("composite_score"))


def factor_corr(panel: DataFrame) -> DataFrame:
    """``factor_a, factor_b, correlation``: rank correlations of all pairs of factors, ranked over the whole panel."""
    names = [c for c in panel.columns if c not in ("date", "ticker", "fwd")]
    ranks = pooled_ranks(long_panel(panel).drop("fwd"), "score", ["factor_name"], Scratch(panel.sparkSession))
    rows = ranks.groupBy("date", "ticker").pivot("factor_name", names).agg(F.first("rank"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = rows.agg(F.count("*").alias("n"), *[corr(a, b).alias(f"{a}|{b}") for a, b in pairs]).where("n > 0")
    tall = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "correlation")
    return tall.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("factor_a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("factor_b"), "correlation")


@dataclass(frozen=True)
class TreeConfig:
    """A model learns from all rows of its window; one of more than ``task_rows`` is fitted in pieces, to the same trees."""

    trees: int = 200
    depth: int = 4
    step: float = 0.05
    subsample: float = 0.8
    least_dates: int = 36
    purge_months: int = 1
    stride: int = 1
    seed: int = 42
    task_rows: int = 200_000


def boosted_trees(panel: DataFrame, names: list[str], c: TreeConfig = TreeConfig()) -> list[tuple]:
    """One model of the whole panel, as nested tuples (see boost.Tree.nested), fitted on all of its rows."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        trees = boost.fit(pdf[names].to_numpy(float), pdf["fwd"].to_numpy(float), c, pdf["_key"].to_numpy())
        return pd.DataFrame({"tree": [json.dumps(t) for t in trees]})

    last, n, most = panel.agg(F.max("date"), F.count("*"), F.max(F.abs("fwd"))).first()
    if n > c.task_rows:
        return boost_pieces.fit(panel, [(last, n, most)], names, c)[0]
    rows = panel.select(boost.key(), "fwd", *names, F.lit(1).alias("one"))
    rows = rows.groupBy("one").applyInPandas(fit, "tree string").collect()  # a row for each tree
    tuples = lambda t: tuple(tuples(x) if isinstance(x, list) else x for x in t)
    return [tuples(json.loads(r.tree)) for r in rows]


def boosted_walk(panel: DataFrame, c: TreeConfig = TreeConfig()) -> DataFrame:
    """``date, ticker, composite_score`` by models refitted every ``stride`` dates on all dates before the purge.

    A date with too few dates before its purge has no scores; the next one that has enough is fitted. Windows are fitted
    side by side, on all of their rows (see boost_pieces.walk).
    """
    names = sorted(x for x in panel.columns if x not in ("date", "ticker", "fwd"))
    ends = panel.groupBy("date").agg(F.count("*").alias("n"), F.max(F.abs("fwd")).alias("most")).select("date", "n", "most", F.add_months("date", -c.purge_months).alias("end")).orderBy("date").collect()  # a row a date
    dates, blocks, i = [r.date for r in ends], [], c.least_dates
    while i < len(dates):
        known = bisect.bisect_right(dates, ends[i].end)
        if known < c.least_dates:
            i += 1
            continue
        blocks.append((dates[i], dates[min(i + c.stride, len(dates)) - 1], ends[i].end, sum(r.n for r in ends[:known]), max(r.most for r in ends[:known])))
        i += c.stride
    if not blocks:
        return panel.select("date", "ticker", F.lit(None).cast("double").alias("composite_score")).limit(0)
    return boost_pieces.walk(panel, blocks, names, c)


def run_id(method: str, config: dict) -> tuple[str, str]:
    """(run id, configuration hash) of a run: the hash depends on the configuration alone."""
    digest = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return f"{method}_{digest}_{uuid.uuid4().hex[:8]}", digest


class Composite(ABC):
    """A way to combine factors, to be named beside the library's own. ``fit`` learns from a feature panel (date, ticker, a
    column for each factor, fwd), ``predict`` scores one; a date may only use what was known by then."""

    method: str

    @abstractmethod
    def fit(self, panel: DataFrame):
        """What ``predict`` needs."""

    @abstractmethod
    def predict(self, panel: DataFrame, fitted) -> DataFrame:
        """``date, ticker, composite_score``"""


@dataclass(frozen=True)
class ICWeighted(Composite):
    lookback: int = 36
    lag: int = 0
    method = "ic_weighted"

    def fit(self, panel: DataFrame) -> DataFrame:
        return ic_weights(panel, self.lookback, self.lag)

    def predict(self, panel: DataFrame, fitted: DataFrame) -> DataFrame:
        return composite(panel, fitted)


@dataclass(frozen=True)
class FamaMacBeth(Composite):
    lookback: int = 36
    lag: int = 0
    method = "fama_macbeth"

    def fit(self, panel: DataFrame) -> DataFrame:
        return fama_macbeth_weights(regressions(panel), self.lookback, self.lag)

    def predict(self, panel: DataFrame, fitted: DataFrame) -> DataFrame:
        return composite(panel, fitted)


@dataclass(frozen=True)
class Boosted(Composite):
    """Refits on past dates as it goes, so there is nothing to fit before."""

    trees: TreeConfig = TreeConfig()
    method = "xgboost"

    def fit(self, panel: DataFrame) -> None:
        return None

    def predict(self, panel: DataFrame, fitted: None) -> DataFrame:
        return boosted_walk(panel, self.trees)


def composites(panel: DataFrame, methods: list[Composite]) -> DataFrame:
    """``date, ticker, method, composite_score`` of each of ``methods``."""
    if len({m.method for m in methods}) < len(methods):
        raise ValueError("two methods of one name")
    return union([m.predict(panel, m.fit(panel)).select("date", "ticker", F.lit(m.method).alias("method"), "composite_score") for m in methods])
