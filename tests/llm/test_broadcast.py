"""Joins of exploded indexes are never broadcast: Spark's estimate of their size does not count the rows of an explode."""

from pyspark.sql import functions as F

from panelforge.llm import similar, simhash


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_merge(spark):
    fps = spark.range(50).select(F.xxhash64("id").alias("fp"))
    assert "Broadcast" not in plan_of(simhash.links(fps))


def test_open_pairs_merge(spark):
    live = spark.range(40).select((F.col("id") % 3).alias("key"), F.col("id").alias("node"), (F.col("id") % 2 + 9).alias("n"), (F.col("id") % 2 + 400).alias("cap"), (F.col("id") % 7).alias("root"))
    pairs = similar.open_pairs(live)
    banded = [x for x in plan_of(pairs).split("\n") if "band#" in x and "Join" in x]
    assert banded and all("SortMergeJoin" in x for x in banded)
    assert pairs.distinct().count() == sum(a % 3 == b % 3 and a % 7 != b % 7 for a in range(40) for b in range(a))
