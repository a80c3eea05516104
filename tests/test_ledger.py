"""The ledger: commits over several tables, only touched parts rewritten, replays, failures, rivals and pruned reads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge.sources.ledger import Change, Ledger, Spec

SPECS = {
    "px": Spec("date date, ticker string, v double", ("date", "ticker")),
    "names": Spec("ticker string, sector string", ("ticker",), None),
    "hours": Spec("at timestamp, n long", ("at",), "at"),
}


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/ledger", SPECS)


def px(spark, *rows):
    return spark.createDataFrame([(dt.date.fromisoformat(d), t, v) for d, t, v in rows], "date date, ticker string, v double")


def all_rows(rows):
    return sorted(tuple(map(str, r)) for r in rows.collect())


def test_upserts_rewrite_only_touched_parts(spark, ledger):
    assert ledger.head()[0] == 0 and ledger.read("px").count() == 0 and ledger.read("px").columns == ["date", "ticker", "v"]
    ledger.commit({"px": px(spark, ("2020-01-05", "A", 1.0), ("2020-02-05", "A", 2.0), ("2020-03-05", "A", 3.0)), "names": spark.createDataFrame([("A", "x")], "ticker string, sector string")})
    before = ledger.parts("px")
    assert ledger.commit({"px": px(spark, ("2020-02-05", "A", 9.0), ("2020-02-06", "B", 4.0))}) == 2
    after = ledger.parts("px")
    assert {p for p in after if after[p] != before.get(p)} == {"2020-02"} and set(after) == {"2020-01", "2020-02", "2020-03"}
    assert all_rows(ledger.read("px")) == [("2020-01-05", "A", "1.0"), ("2020-02-05", "A", "9.0"), ("2020-02-06", "B", "4.0"), ("2020-03-05", "A", "3.0")]
    wider = spark.createDataFrame([(dt.date(2020, 4, 1), "C", "x")], "date date, ticker string, other string")
    ledger.commit({"px": wider, "hours": spark.createDataFrame([(dt.datetime(2020, 1, 31, 23), 1), (dt.datetime(2020, 2, 1, 0), 2)], "at timestamp, n long")})
    assert all_rows(ledger.read("px", dt.date(2020, 4, 1))) == [("2020-04-01", "C", "None")] and set(ledger.parts("hours")) == {"2020-01", "2020-02"}
    assert [r.n for r in ledger.read("hours", end=dt.date(2020, 1, 31)).collect()] == [1]
    assert ledger.vacuum() == 1 and ledger.read("px").count() == 5 and ledger.vacuum() == 0


def test_bytes_grow_with_the_batch(spark, ledger):
    many = spark.range(36_000).select(F.date_add(F.lit(dt.date(2010, 1, 1)), (F.col("id") % 3600).cast("int")).alias("date"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("ticker"), F.rand(1).alias("v"))
    ledger.commit({"px": many})
    whole = set(ledger.parts("px").values())
    ledger.commit({"px": px(spark, ("2012-05-01", "Z", 1.0))})
    size = lambda folders: sum(ledger.fs.getContentSummary(ledger.path(f"{ledger.root}/{f}")).getLength() for f in folders)
    assert len(whole) == 119 and size(set(ledger.parts("px").values()) - whole) < size(whole) / 50


def test_ranges_are_pruned(spark, ledger):
    ledger.commit({"px": px(spark, *[(f"2020-{m:02}-{d:02}", "A", float(m)) for m in range(1, 10) for d in (1, 15)])})
    rows = ledger.read("px", dt.date(2020, 3, 10), dt.date(2020, 5, 1))
    assert all_rows(rows) == [(d, "A", v) for d, v in (("2020-03-15", "3.0"), ("2020-04-01", "4.0"), ("2020-04-15", "4.0"), ("2020-05-01", "5.0"))]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "part" in filters and "2020-03" in filters and "2020-05" in filters
    assert {f.split("part=")[1][:7] for f in rows.inputFiles()} == {"2020-03", "2020-04", "2020-05"}


def test_a_commit_is_all_or_nothing(spark, ledger):
    ledger.commit({"px": px(spark, ("2020-01-05", "A", 1.0))})
    broken = px(spark, ("2020-01-06", "A", 1.0)).withColumn("v", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        ledger.commit({"names": spark.createDataFrame([("A", "x")], "ticker string, sector string"), "px": broken})
    assert ledger.head()[0] == 1 and ledger.read("names").count() == 0 and ledger.read("px").count() == 1
    draft = ledger.fs.create(ledger.path(f"{ledger.root}/_commits/_draft"))  # a writer that was lost before its rename
    draft.close()
    assert ledger.head()[0] == 1
    with pytest.raises(ValueError):
        ledger.commit({"px": px(spark, ("2020-01-05", "B", 1.0)).withColumn("date", F.lit(None).cast("date"))})


def test_batches_count_once_and_rivals_are_not_lost(spark, ledger, monkeypatch):
    one = px(spark, ("2020-01-05", "A", 1.0))
    assert ledger.commit({"px": one}, batch=("s", 0)) == 1 and ledger.commit({"px": px(spark, ("2020-01-05", "A", 7.0))}, batch=("s", 0)) == 1
    assert all_rows(ledger.read("px")) == [("2020-01-05", "A", "1.0")]
    publish, rivals = Ledger._publish, []

    def slow(self, number, content):
        if not rivals:  # another writer commits between this one's reading and its own commit
            rivals.append(publish(self, number, {**content, "tables": {"names": {}}, "batches": {"other": 1}}))
        return publish(self, number, content)

    monkeypatch.setattr(Ledger, "_publish", slow)
    assert ledger.commit({"px": px(spark, ("2020-02-05", "B", 2.0))}) == 3 and rivals == [True]
    assert ledger.head()[1]["batches"] == {"other": 1} and all_rows(ledger.read("px")) == [("2020-02-05", "B", "2.0")]


def test_rows_that_go(spark, ledger):
    ledger.commit({"px": px(spark, ("2020-01-05", "A", 1.0), ("2020-02-05", "A", 2.0))})
    ledger.commit({"px": Change(px(spark), F.col("v") < 2, ("2020-01", "2019-01"))})
    assert set(ledger.parts("px")) == {"2020-02"} and ledger.read("px").count() == 1
