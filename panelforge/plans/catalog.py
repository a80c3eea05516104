"""The library's own panels: sources, month-ends, returns and the families of factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import combine, factors, returns
from ..sources import models, ranges, store
from ..sources.starschema import Star
from .panels import Catalog

#: Factors of the basic panel, for regressions by date: with all 18 a date needs 20 rows.
BASIC = sorted(factors.PRICE + factors.VALUE)


def build_model(spark: SparkSession, path: str, panel: DataFrame) -> None:
    """A store below ``path`` with one boosted model of the panel, under the id 'boosted'."""
    models.save_model(store.create(spark, path), "boosted", combine.boosted_trees(panel, factors.FACTORS), factors.FACTORS)


def standard() -> Catalog:
    """A new catalog with all of the library's panels; add factors or panels of one's own to it."""
    c = Catalog()
    for name in ("metadata", "insiders"):
        c.source(name, getattr(Star, name))
    for name in ("quarters", "macro", "market"):  # small sums of large tables, which many panels read
        c.source(name, getattr(Star, name), stored=True)
    c.panel("fundamentals", ["quarters"], Star.fundamentals)
    c.panel("earnings", ["quarters"], Star.earnings)
    c.source("prices", Star.prices, stored=True)
    c.panel("months", ["prices"], returns.month_ends, stored=True)
    c.panel("returns", ["months"], returns.returns_of_months, stored=True)
    c.panel("exposures", ["prices", "market", "macro"], factors.exposures)
    c.folder("history", ["prices", "macro"], ranges.build)
    c.family("price factors", ["months"], factors.price_factors, factors.PRICE)
    c.family("value factors", ["months", "fundamentals", "metadata"], factors.value_factors, factors.VALUE)
    c.family("risk factors", ["prices", "exposures"], factors.risk_factors, factors.RISK)
    c.family("event factors", ["months", "earnings", "insiders"], factors.event_factors, factors.EVENT)
    for name, names in (("feature panel", factors.FACTORS), ("basic panel", BASIC)):
        c.panel(name, [c.scores(factors.FACTORS), "returns"], lambda scores, rows, names=names: combine.feature_panel(scores, rows, names), stored=True)
    c.folder("model", ["feature panel"], build_model)
    return c
