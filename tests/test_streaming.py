"""Streams into the ledger: started, stopped and resumed, with late rows and replayed batches, against the batch form."""

import datetime as dt
import random

from panelforge.sources.ledger import Ledger
from panelforge.streaming.events import WINDOWS, keep_windows, upserting, windowed

SCHEMA = "event_id long, ts timestamp, event_type string, value double"


def rows_of(table):
    return sorted((str(r.window_start), r.event_type, r.n, round(r.total, 9)) for r in table.select("window_start", "event_type", "n", "total").collect())


def test_stop_and_resume_equal_the_batch(spark, tmp_path):
    rng, base = random.Random(1), dt.datetime(2020, 1, 30, 12)
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", WINDOWS)
    source, checkpoint = f"file://{tmp_path}/in", f"file://{tmp_path}/checkpoint"

    def arrive(k, late=0):
        """A file with rows of about the k-th eight hours; some come ``late`` hours later than their time."""
        rows = [(k * 1000 + i, base + dt.timedelta(hours=8 * k + 8 * rng.random() - (late if i % 5 == 0 else 0)), rng.choice("ab"), rng.random()) for i in range(200)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = keep_windows(stream, ledger, checkpoint)
        assert query.awaitTermination(300)

    for k in range(3):
        arrive(k, late=6)  # within the watermark of a day
    run()
    first = ledger.head()
    assert rows_of(ledger.read("event_windows")) == rows_of(windowed(spark.read.parquet(source)))
    for k in range(3, 6):
        arrive(k, late=10)
    run()  # a new query on the old checkpoint
    assert rows_of(ledger.read("event_windows")) == rows_of(windowed(spark.read.parquet(source)))
    assert ledger.head()[0] > first[0] and set(ledger.parts("event_windows")) == {"2020-01", "2020-02"}
    kept = rows_of(ledger.read("event_windows"))
    spark.createDataFrame([(1, base - dt.timedelta(days=9), "a", 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run()  # a row beyond the watermark is dropped
    assert rows_of(ledger.read("event_windows")) == kept
    number = ledger.head()[0]
    run()  # nothing new
    assert rows_of(ledger.read("event_windows")) == kept and ledger.head()[0] - number <= 1


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", WINDOWS)
    save = upserting(ledger, "event_windows", "s")
    batch = lambda n: spark.createDataFrame([(dt.datetime(2020, 1, 1), "a", n, 1.0)], "window_start timestamp, event_type string, n long, total double")
    save(batch(1), 0)
    save(batch(2), 1)
    save(batch(9), 1)  # the engine was lost between the commit and its own mark
    assert [r.n for r in ledger.read("event_windows").collect()] == [2] and ledger.head()[0] == 2
