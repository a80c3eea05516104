"""Market regimes: features, a Gaussian hidden Markov model, labels and spans.

Everything here has one row for each date, so windows over the whole calendar are small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio
from .factors import YEAR, macro_wide

FEATURES = ["market_vol", "market_mom", "vix_level", "vix_change", "yield_slope", "credit_spread", "gdp_growth"]


def regime_features(prices: DataFrame, macro: DataFrame | None) -> DataFrame:
    """``date`` and seven features; series that are missing take defaults; gaps are filled forth, then back."""
    dates = prices.select("date").distinct()
    w = Window.orderBy("date")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    rows = prices.groupBy("date").agg(F.median("close").alias("px"))
    rows = rows.select("date", F.coalesce(F.last("px", True).over(up), F.first("px", True).over(down)).alias("px"))
    ret = ratio(F.col("px"), F.lag("px").over(w)) - 1
    rows = rows.withColumns({"ret": ret, "mom": ratio(F.col("px"), F.lag("px", YEAR).over(w)) - 1})
    month = w.rowsBetween(-20, 0)
    vol = F.when(F.count("ret").over(month) >= 5, F.stddev_samp("ret").over(month) * F.sqrt(F.lit(252.0)))
    names = ["VIXCLS", "DGS10", "DGS2", "BAMLH0A0HYM2", "GDP"]
    wide = macro_wide(macro, dates, names) if macro is not None else dates.select("date", *[F.lit(None).cast("double").alias(n) for n in names])
    rows = rows.withColumn("vol", vol).join(wide, "date")
    there = {n: F.max(n).over(Window.partitionBy()).isNotNull() for n in names}
    vix = F.when(there["VIXCLS"], F.col("VIXCLS")).otherwise(F.col("vol") * 100)
    rows = rows.withColumn("vix", vix)
    gdp = F.coalesce(ratio(F.col("GDP"), F.lag("GDP", YEAR).over(w)) - 1, F.lit(0.02))
    rows = rows.select("date", F.col("vol").alias("market_vol"), F.col("mom").alias("market_mom"), F.col("vix").alias("vix_level"), (F.col("vix") - F.lag("vix").over(w)).alias("vix_change"), F.when(there["DGS10"] & there["DGS2"], F.col("DGS10") - F.col("DGS2")).otherwise(1.5).alias("yield_slope"), F.when(there["BAMLH0A0HYM2"], F.col("BAMLH0A0HYM2")).otherwise(4.0).alias("credit_spread"), gdp.alias("gdp_growth"))
    return rows.select("date", *[F.coalesce(F.last(c, True).over(up), F.first(c, True).over(down)).alias(c) for c in FEATURES]).dropna()


def _density(x, mean, cov):
    d = x.shape[1]
    out = np.empty((len(x), len(mean)))
    for k in range(len(mean)):
        chol = np.linalg.cholesky(cov[k])
        z = np.linalg.solve(chol, (x - mean[k]).T)
        out[:, k] = -0.5 * (d * np.log(2 * np.pi) + (z * z).sum(0)) - np.log(np.diag(chol)).sum()
    return out


def hmm_fit(x: np.ndarray, k: int, rounds: int = 100, seed: int = 42, kind: str = "full") -> dict:
    """Baum-Welch for Gaussian states (Rabiner 1989): start, trans, mean, cov, posterior, states (Viterbi), ll."""
    rng, (n, d) = np.random.default_rng(seed), x.shape
    order = np.argsort(x[:, 0] + 1e-9 * rng.standard_normal(n))
    first = np.zeros((n, k))
    first[order, np.arange(n) * k // n] = 1
    gamma, trans, start, last = first, np.full((k, k), 0.1 / max(1, k - 1)), np.full(k, 1 / k), -np.inf
    np.fill_diagonal(trans, 0.9 if k > 1 else 1.0)
    for _ in range(rounds):
        weight = gamma.sum(0) + 1e-10
        mean = gamma.T @ x / weight[:, None]
        cov = np.stack([(gamma[:, j, None] * (x - mean[j])).T @ (x - mean[j]) / weight[j] for j in range(k)])
        if kind == "diag":
            cov = cov * np.eye(d)
        elif kind == "tied":
            cov = np.repeat((cov * weight[:, None, None]).sum(0)[None] / weight.sum(), k, 0)
        elif kind == "spherical":
            cov = np.eye(d) * (np.trace(cov, axis1=1, axis2=2) / d)[:, None, None]
        cov = cov + 1e-3 * np.eye(d)
        logb = _density(x, mean, cov)
        shift = logb.max(1)
        b = np.exp(logb - shift[:, None])
        alpha, scale = np.empty((n, k)), np.empty(n)
        for t in range(n):
            a = start * b[0] if t == 0 else (alpha[t - 1] @ trans) * b[t]
            scale[t] = a.sum()
            alpha[t] = a / scale[t]
        beta, joint = np.ones((n, k)), np.zeros((k, k))
        for t in range(n - 2, -1, -1):
            right = b[t + 1] * beta[t + 1] / scale[t + 1]
            joint += np.outer(alpha[t], right) * trans
            beta[t] = trans @ right
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        start = gamma[0]
        trans = (joint + 1e-8) / (joint + 1e-8).sum(1, keepdims=True)
        ll = float((np.log(scale) + shift).sum())
        if abs(ll - last) < 1e-4 * abs(last):
            break
        last = ll
    lt, path, back = np.log(trans), np.log(start + 1e-300) + logb[0], np.zeros((n, k), int)
    for t in range(1, n):
        step = path[:, None] + lt
        back[t] = step.argmax(0)
        path = step.max(0) + logb[t]
    states = np.empty(n, int)
    states[-1] = path.argmax()
    for t in range(n - 1, 0, -1):
        states[t - 1] = back[t, states[t]]
    return {"start": start, "trans": trans, "mean": mean, "cov": cov, "posterior": gamma, "states": states, "ll": ll}


def scaled(pdf: pd.DataFrame) -> np.ndarray:
    x = pdf[FEATURES].to_numpy(float)
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd > 0, sd, 1)


def hmm_states(features: DataFrame, k: int = 4, rounds: int = 100, seed: int = 42, kind: str = "full") -> DataFrame:
    """``date, regime_id, prob_0 .. prob_k-1``; one row for each date goes through one task."""
    cols = [f"prob_{i}" for i in range(k)]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        m = hmm_fit(scaled(pdf), k, rounds, seed, kind)
        return pd.DataFrame(m["posterior"], columns=cols).assign(date=pdf["date"].to_numpy(), regime_id=m["states"])[["date", "regime_id", *cols]]

    return features.withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(fit, "date date, regime_id int, " + ", ".join(f"{c} double" for c in cols))


def n_parameters(k: int, d: int, kind: str) -> int:
    cov = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[kind]
    return cov + k * (k - 1) + k * d + k - 1


def bic_by_states(features: DataFrame, most: int = 6, rounds: int = 30, seed: int = 42, kind: str = "full") -> DataFrame:
    """``k, log_likelihood, bic, best`` of models with 2 to ``most`` states, fitted in parallel."""
    rows = features.crossJoin(features.sparkSession.range(2, most + 1).withColumnRenamed("id", "k"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        k, pdf = int(pdf["k"].iloc[0]), pdf.sort_values("date")
        ll = hmm_fit(scaled(pdf), k, rounds, seed, kind)["ll"]
        return pd.DataFrame({"k": [k], "log_likelihood": [ll], "bic": [n_parameters(k, len(FEATURES), kind) * np.log(len(pdf)) - 2 * ll]})

    out = rows.groupBy("k").applyInPandas(fit, "k long, log_likelihood double, bic double")
    return out.withColumn("best", F.col("bic") == F.min("bic").over(Window.partitionBy()))


def regime_profile(features: DataFrame, states: DataFrame) -> DataFrame:
    """Mean of each feature by regime, with its z-score over the regimes."""
    rows = features.join(states.select("date", "regime_id"), "date").unpivot(["date", "regime_id"], FEATURES, "feature", "value")
    rows = rows.groupBy("regime_id", "feature").agg(F.avg("value").alias("mean"))
    w = Window.partitionBy("feature")
    return rows.withColumn("z", ratio(F.col("mean") - F.avg("mean").over(w), F.when(F.stddev_samp("mean").over(w) > 1e-12, F.stddev_samp("mean").over(w))))


#: Labels of four states (fixed values).
BEAR, BULL, SHOCK, NEUTRAL = "Bear / High-Vol", "Bull Market", "Rate Shock / Stagnation", "Neutral / Transition"


def regime_labels(features: DataFrame, states: DataFrame, k: int = 4) -> DataFrame:
    """``regime_id, regime_label``: with four states bear (most volatile), bull (best momentum of the rest), rate
    shock (lowest slope of the rest) and neutral; else numbered."""
    means = features.join(states.select("date", "regime_id"), "date").groupBy("regime_id").agg(*[F.avg(c).alias(c) for c in ("market_vol", "market_mom", "yield_slope")])
    all_ids = features.sparkSession.range(k).select(F.col("id").cast("int").alias("regime_id"))
    means = all_ids.join(means, "regime_id", "left").fillna(0.0)
    if k != 4:
        return means.select("regime_id", F.concat(F.lit("Regime "), F.col("regime_id").cast("string")).alias("regime_label"))
    rank = lambda keys: F.row_number().over(Window.orderBy(*keys))
    rows = means.withColumn("bear", rank([F.desc("market_vol"), F.col("regime_id")]) == 1)
    rows = rows.withColumn("bull", ~F.col("bear") & (rank([F.col("bear"), F.desc("market_mom"), F.col("regime_id")]) == 1))
    rows = rows.withColumn("shock", ~F.col("bear") & ~F.col("bull") & (rank([F.col("bear") | F.col("bull"), F.col("yield_slope"), F.col("regime_id")]) == 1))
    return rows.select("regime_id", F.when(F.col("bear"), BEAR).when(F.col("bull"), BULL).when(F.col("shock"), SHOCK).otherwise(NEUTRAL).alias("regime_label"))


def transitions(states: DataFrame) -> DataFrame:
    """``from_id, to_id, probability, expected_duration``; a state that is never left lasts for ever."""
    rows = states.select(F.col("regime_id").alias("from_id"), F.lead("regime_id").over(Window.orderBy("date")).alias("to_id")).where("to_id is not null")
    n = rows.groupBy("from_id", "to_id").count()
    n = n.withColumn("probability", F.col("count") / F.sum("count").over(Window.partitionBy("from_id")))
    stay = F.coalesce(F.max(F.when(F.col("from_id") == F.col("to_id"), F.col("probability"))).over(Window.partitionBy("from_id")), F.lit(0.0))
    return n.select("from_id", "to_id", "probability", F.when(stay < 1, 1 / F.nullif(1 - stay, F.lit(0.0))).otherwise(float("inf")).alias("expected_duration"))


def regime_spans(states: DataFrame) -> DataFrame:
    """``regime_id, start_date, end_date, n_dates`` of each run of one state."""
    w = Window.orderBy("date")
    rows = states.select("date", "regime_id").withColumn("new", F.coalesce((F.col("regime_id") != F.lag("regime_id").over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("span", "regime_id").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("n_dates")).drop("span")
