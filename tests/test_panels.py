"""The graph of panels: written once, counted, usable in any order; factors of one's own."""

import threading

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from panelforge.plans import panels, queries
from panelforge.plans.catalog import standard
from panelforge.plans.panels import Catalog, Factor, Node, Panels
from panelforge.sources.starschema import Star

PATH = "/root/testdata/sf0.001"


class Size(Factor):
    """Small companies: the negative logarithm of price times shares."""

    name = "Size"
    needs = ("months", "metadata")

    def compute(self, months, metadata):
        rows = months.join(metadata.select("ticker", "shares_outstanding"), "ticker")
        return rows.select("date", "ticker", (-F.ln(F.col("px") * F.col("shares_outstanding"))).alias("raw_score"))


def counted(catalog, name):
    """``catalog`` with the panel ``name`` counting how often it is made."""
    made, node = [], catalog.nodes[name]

    def make(*panels):
        made.append(name)
        return node.make(*panels)

    catalog.nodes[name] = Node(name, node.needs, make, node.stored, node.source)
    return made


def there(spark, rows):
    path = spark._jvm.org.apache.hadoop.fs.Path(rows.inputFiles()[0])
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_shared_panels_are_written_once_and_live_as_long_as_they_are_read(spark):
    catalog = standard()
    made = counted(catalog, "months")
    graph = Panels(catalog, Star(spark, PATH))
    one, other = graph.lease(), graph.lease()
    months = one("months")
    assert other("returns").count() > 0 and other.family("PriceMomentum").count() > 0 and made == ["months"]
    assert graph.readers["months"] == 2
    one.release()
    assert there(spark, months)  # the other one reads it still
    other.release()
    other.release()  # once more does no harm
    assert not graph.tables and not there(spark, months)
    with graph.lease() as again:
        assert again("months").count() > 0 and made == ["months", "months"]
    assert not graph.tables


def test_factors_of_ones_own(spark):
    catalog = standard()
    catalog.factor(Size())
    with Panels(catalog, Star(spark, PATH)).lease() as lease:
        got = lease.scores(["Size", "PriceMomentum"])
        names = {r.factor_name for r in got.select("factor_name").distinct().collect()}
        raw = {(r.date, r.ticker): r.raw_score for r in got.where("factor_name = 'Size'").collect()}
        months = lease("months").join(lease("metadata"), "ticker").where("px is not null").collect()
        assert names == {"Size", "PriceMomentum"} and len(raw) >= len(months) > 0
        assert all(abs(raw[r.date, r.ticker] + np.log(r.px * r.shares_outstanding)) < 1e-8 for r in months)
    assert catalog.scores(["Size"]) == catalog.scores(["Size"]) and "Size" not in standard().families


def test_mistakes_are_told(spark):
    catalog = standard()
    for wrong in (lambda: catalog.scores(["Nothing"]), lambda: catalog.panel("x", ["nothing"], None), lambda: catalog.panel("months", [], None), lambda: Panels(catalog, Star(spark, PATH)).lease()("nothing")):
        with pytest.raises(ValueError):
            wrong()
    catalog.factor(Size())
    with pytest.raises(ValueError):
        catalog.factor(Size())
    own = Catalog()
    own.source("broken", lambda star: star.table("nation").select(F.raise_error(F.lit("no"))), stored=True)
    graph = Panels(own, Star(spark, PATH))
    with pytest.raises(Exception, match="no"):
        graph.lease()("broken")
    assert not graph.tables and not graph.readers


def test_planned_from_two_threads(spark):
    catalog = standard()
    made, graph, found = counted(catalog, "months"), Panels(catalog, Star(spark, PATH)), []

    def plan():
        with graph.lease() as lease:
            found.append(lease("returns").count())

    with graph.lease() as first:  # holds what the threads share
        first("months")
        threads = [threading.Thread(target=plan) for _ in range(2)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    assert len(set(found)) == 1 and len(found) == 2 and made == ["months"] and not graph.tables


NAMES = ["monthly_returns", "universe_size", "factor_BookToPrice", "ic_series", "backtest_results", "feature_panel", "regime_features", "daily_returns", "factor_corr"]


def test_results_run_in_any_order(spark):
    """All are planned before any runs, they run in reverse, and each equals its SQL."""
    con = duckdb.connect()
    for t in ("nation", "region", "supplier", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS FROM '{PATH}/{t}.parquet'")
    planned = {name: __spark_entry__.queries()[name](spark, PATH) for name in NAMES}
    for name, rows in reversed(planned.items()):
        got, want = rows.toPandas(), con.execute(__spark_entry__.oracle_sql()[name]).df()
        assert len(got) == len(want), name
        for c, t in rows.dtypes:
            if t == "double":
                assert np.allclose(np.sort(got[c].to_numpy(float)), np.sort(want[c].to_numpy(float)), atol=2e-6, equal_nan=True), (name, c)
    joined = planned["monthly_returns"].join(planned["factor_BookToPrice"], ["date", "ticker"])
    assert joined.count() > 0
    graph = panels.opened(spark, queries.CATALOG, PATH, "bucket")
    assert graph.readers["returns"] > 1
    panels.release(planned["monthly_returns"])
    assert planned["factor_BookToPrice"].count() > 0
    panels.release(*planned.values())
