"""Large tables are joined once for all panels made of them, and scores are made without computing their rows twice."""

from panelforge.operators import factors
from panelforge.plans.catalog import standard
from panelforge.plans.panels import Panels
from panelforge.sources.starschema import Star

PATH = "/root/testdata/sf0.001"


def scans(df, name):
    return sum("FileScan" in x and name in x for x in df._jdf.queryExecution().executedPlan().toString().split("\n"))


def test_statements_and_earnings_read_one_join(spark):
    with Panels(standard(), Star(spark, PATH)).lease() as lease:
        assert scans(lease("value factors"), "lineitem") == scans(lease("value factors"), "orders.parquet") == 0
        assert scans(lease("event factors"), "lineitem") == 1  # the insiders' trades
        assert scans(lease("event factors"), "orders.parquet") == scans(lease("exposures"), "lineitem") == 0


def test_winsorize_reads_its_rows_once(spark):
    rows = spark.read.parquet(f"{PATH}/lineitem.parquet").selectExpr("l_suppkey date", "l_returnflag factor_name", "l_extendedprice raw_score")
    assert scans(factors.winsorize(rows), "lineitem") == 1
