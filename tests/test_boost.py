"""Boosted trees learn from all rows of their window, the same ones however the rows are dealt out."""

from datetime import date

import numpy as np
from pyspark.sql import functions as F

from panelforge.operators import boost, boost_pieces, combine
from panelforge.sources.scratch import Scratch


def made(spark, n: int, dates: int):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(n, 3)), 2)  # with ties
    y = np.where(x[:, 0] > 0.3, 1.0, -0.5) * x[:, 1] + rng.normal(size=n) / 5
    return spark.createDataFrame([(date(2000 + i % dates // 12, i % dates % 12 + 1, 28), f"T{i}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "date date, ticker string, a double, b double, c double, fwd double")


def test_a_model_learns_from_all_rows_of_a_long_panel(spark):
    rows = spark.range(600_000).select(F.expr("date_add(date '2000-01-01', cast(id % 40 as int))").alias("date"), F.col("id").cast("string").alias("ticker"), F.rand(1).alias("a"))
    panel = Scratch(spark).write(rows.withColumn("fwd", F.col("a") * 2 + F.rand(2)), "rows")
    got = combine.boosted_trees(panel, ["a"], combine.TreeConfig(trees=1, depth=1))
    mean = panel.agg(F.avg("fwd")).first()[0]
    assert got[0][1] == 600_000 and abs(got[0][0] - mean) < 1e-6
    assert abs(got[1][4] - 480_000) < 2_000 and abs(got[1][1] - 0.5) < 0.02


def test_pieces_have_the_trees_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(boost_pieces, "PIECE", 300)
    monkeypatch.setattr(boost_pieces, "CUT", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        panel = made(spark, 2400, 12).repartition(5).persist()
        config = {"trees": 8, "depth": 3, "step": 0.3, "least_dates": 6, "stride": 2}
        whole = combine.boosted_walk(panel, combine.TreeConfig(**config)).toPandas()
        for task_rows in (10, 1500):  # all in pieces; the last windows only
            got = combine.boosted_walk(panel, combine.TreeConfig(**config, task_rows=task_rows)).toPandas()
            both = whole.merge(got, on=["date", "ticker"], how="outer")
            assert len(both) == len(whole) == 1200 and (both["composite_score_x"] == both["composite_score_y"]).all()
        assert combine.boosted_trees(panel, list("abc"), combine.TreeConfig(**config, task_rows=10)) == combine.boosted_trees(panel, list("abc"), combine.TreeConfig(**config))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_thresholds_are_those_of_the_whole_window(spark):
    panel, scratch = made(spark, 900, 9), Scratch(spark)
    rows = panel.select(F.unix_date("date").alias("day"), "a", "b", "c")
    pdf = rows.toPandas()
    ends = sorted(set(pdf["day"]))[4:] + [10**6]
    sizes = [int((pdf["day"] <= end).sum()) for end in ends]
    for own, end in zip(boost_pieces.thresholds(rows, ends, sizes, list("abc"), scratch), ends):
        for got, name in zip(own, "abc"):
            assert np.array_equal(got, np.unique(np.quantile(pdf[name][pdf["day"] <= end], boost.SHARES)))
    scratch.drop()


def test_trees_do_not_depend_on_the_order_of_rows():
    rng = np.random.default_rng(9)
    x, keys = rng.normal(size=(500, 4)), rng.integers(-(2**62), 2**62, 500)
    y, order, c = x @ [1, 0, -2, 0.5], rng.permutation(500), combine.TreeConfig(trees=20)
    assert boost.fit(x, y, c, keys) == boost.fit(x[order], y[order], c, keys[order])
    shares = [boost.drawn(keys, t, c).mean() for t in range(20)]
    assert abs(np.mean(shares) - 0.8) < 0.02 and len(set(shares)) > 5
