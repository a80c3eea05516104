"""Sums of a supplier's quarter are taken where all its lines are, those of few buckets before they are moved."""

from panelforge.sources.starschema import Star

PATH = "/root/testdata/sf0.001"


def partial_sums(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(q#" in x and "ENSURE_REQUIREMENTS" in x]


def test_supplier_lines_are_moved_and_not_partial_sums(spark):
    assert not partial_sums(Star(spark, PATH, "supplier").quarters())
    assert partial_sums(Star(spark, PATH, "bucket").quarters())


def test_sums_equal_those_of_sql(spark):
    for t in ("lineitem", "orders"):
        spark.read.parquet(f"{PATH}/{t}.parquet").createOrReplaceTempView(f"{t}_q")
    sql = """SELECT cast(date_trunc('quarter', o_orderdate) AS date) q, concat('S', lpad(cast(l_suppkey AS string), 5, '0')) ticker,
        cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) book_value, cast(sum(cast(l_extendedprice * l_tax AS decimal(18,4))) AS double) total_debt,
        min(cast(o_orderdate AS date)) first FROM lineitem_q JOIN orders_q ON l_orderkey = o_orderkey GROUP BY 1, 2"""
    columns = ["q", "ticker", "book_value", "total_debt", "first"]
    assert sorted(Star(spark, PATH, "supplier").quarters().select(columns).collect()) == sorted(spark.sql(sql).select(columns).collect())
