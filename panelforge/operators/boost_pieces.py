"""Boosted trees of training windows too long for a task: rows stay in pieces, and the driver sees sums of bins alone.

For each level of a tree there is one job for all windows. A task adds up its pieces by window; the driver adds these sums,
as many as windows and tasks, and splits. Arithmetic is that of boost.fit and exact, so the trees are the same.
"""

from __future__ import annotations

import math
import pickle
from datetime import date

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import union
from ..sources.scratch import Scratch, shared_dir
from . import boost

#: Rows of a piece, and rows (of all windows) that a task goes through, piece by piece.
PIECE, TASK = 125_000, 4_000_000
#: Values of a range that are sorted by one task.
RANGE = 500_000
#: After so many trees the residuals are written, so that lost tasks have no longer a past than that.
CUT = 20


def thresholds(rows: DataFrame, ends: list[int], sizes: list[int], names: list[str], scratch: Scratch) -> list[list[np.ndarray]]:
    """For each window (rows up to the day ``end``) and feature the distinct quantiles of boost.SHARES, as by np.quantile.

    Distinct values by day are sorted by ranges. Their counts by range and day say in which range each window's wanted
    values are, and how many of the window are before them there.
    """
    last, k = np.array(ends), len(names)
    counts = rows.select("day", F.posexplode(F.array(*[F.col(c).cast("double") for c in names])).alias("f", "x")).groupBy("f", "x", "day").agg(F.count("*").alias("n"))
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(max(sizes) * k / RANGE))
    parts = scratch.write(counts.repartitionByRange(ranges, "f", "x").withColumn("part", F.spark_partition_id()), "ranges")

    def placed(own: pd.DataFrame) -> pd.DataFrame:
        """The wanted places (from 0, in the window's order) of one feature, by range and with their place in it."""
        table = own.pivot_table("n", "part", "day", "sum", fill_value=0).sort_index().sort_index(axis=1)
        until = np.searchsorted(table.columns.to_numpy(), last, "right")
        upto = np.c_[np.zeros(len(table), int), table.to_numpy().cumsum(1)].astype(np.int64)[:, until].cumsum(0)  # by range and window
        out = []
        for w in range(len(last)):
            low = np.floor(boost.SHARES * (upto[-1, w] - 1)).astype(np.int64)
            at = np.unique(np.r_[low, np.minimum(low + 1, upto[-1, w] - 1)])
            i = np.searchsorted(upto[:, w], at, "right")
            out.append(pd.DataFrame({"part": table.index.to_numpy()[i], "f": own["f"].iloc[0], "w": w, "place": at, "own": at - np.where(i > 0, upto[i - 1, w], 0)}))
        return pd.concat(out)

    def found(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out, own = [], {f: v.sort_values("x") for f, v in own.groupby("f")}
        for (f, w), a in asked.groupby(["f", "w"]):
            v = own[f]
            upto = np.where(v["day"].to_numpy() <= last[w], v["n"].to_numpy(), 0).cumsum()
            out.append(a[["f", "w", "place"]].assign(x=v["x"].to_numpy()[np.searchsorted(upto, a["own"].to_numpy(), "right")]))
        return pd.concat(out) if out else pd.DataFrame({"f": [], "w": [], "place": [], "x": []})

    asked = parts.groupBy("f", "part", "day").agg(F.sum("n").alias("n")).groupBy("f").applyInPandas(placed, "part int, f int, w int, place long, own long")
    values = parts.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(found, "f int, w int, place long, x double").toPandas()  # at most 126 for each window and feature
    of = {key: (v["place"].to_numpy(), v["x"].to_numpy()) for key, v in values.sort_values("place").groupby(["w", "f"])}
    return [[quantiles(*of[w, f], sizes[w]) for f in range(k)] for w in range(len(ends))]


def quantiles(place: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The distinct quantiles of ``n`` values, of which those at ``place`` are ``x``; np.quantile rounds the same way."""
    at = boost.SHARES * (n - 1)
    low = np.floor(at).astype(np.int64)
    a, b = x[np.searchsorted(place, low)], x[np.searchsorted(place, np.minimum(low + 1, n - 1))]
    t = at - low
    return np.unique(np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t))


def pieces(rows: DataFrame, ends: list[int], sizes: list[int], names: list[str], cuts: list, units: list[float]) -> tuple:
    """An RDD of (window, bins, keys, returns in units), by tasks that have few windows each; and the broadcast it reads."""
    sc = rows.sparkSession.sparkContext
    first = np.cumsum([0, *[math.ceil(n / PIECE) for n in sizes]])
    tasks = max(min(sc.defaultParallelism, int(first[-1])), math.ceil(sum(sizes) / TASK))
    shared = sc.broadcast((ends, cuts, units, first))

    def cut(batches):
        ends, cuts, units, first = shared.value
        for pdf in batches:
            pdf = pdf.sort_values("day")
            day, keys, y, x = pdf["day"].to_numpy(), pdf["_key"].to_numpy(), pdf["fwd"].to_numpy(float), pdf[names].to_numpy(float)
            for w, end in enumerate(ends):
                m = int(np.searchsorted(day, end, "right"))
                if m:
                    slot = first[w] + int(keys[0]) % (first[w + 1] - first[w])
                    own = [boost.binned(x[:m], cuts[w]).tobytes(), keys[:m].tobytes(), np.rint(y[:m] / units[w]).tobytes()]
                    yield pd.DataFrame([(int(slot * tasks // first[-1]), w, *own)], columns=["task", "w", "bins", "keys", "rest"])

    def joined(rows):
        """Pieces of a window are joined up to PIECE rows."""
        kept: dict = {}

        def piece(w):
            return w, *[np.concatenate(v, axis=-1) for v in zip(*kept.pop(w))]

        for _, r in rows:
            bins = np.frombuffer(r.bins, np.uint8)
            kept.setdefault(r.w, []).append((bins.reshape(len(names), -1), np.frombuffer(r.keys, np.int64), np.frombuffer(r.rest, float)))
            if sum(len(v[1]) for v in kept[r.w]) >= PIECE:
                yield piece(r.w)
        for w in list(kept):
            yield piece(w)

    cells = rows.mapInPandas(cut, "task int, w int, bins binary, keys binary, rest binary")
    return cells.rdd.map(lambda r: (r.task, r)).partitionBy(tasks, lambda task: task).mapPartitions(joined, True), shared


def added(records, sums) -> list:
    """(window, sum) of ``sums`` of the records, for each of a task's windows."""
    out: dict = {}
    for w, *own in records:
        s = sums(w, *own)
        if s is not None:
            out[w] = out[w] + s if w in out else s
    return list(out.items())


def collected(state, sums) -> dict:
    out: dict = {}
    for w, s in state.mapPartitions(lambda records: added(records, sums)).collect():  # one for each window and task it is in
        out[w] = out[w] + s if w in out else s
    return out


def level_sums(trees: list[boost.Tree], t: int, level: int, c):
    return lambda w, bins, keys, rest: trees[w].sums(bins, rest, boost.drawn(keys, t, c), level) if trees[w].open else None


def less(state, value):
    """The records with the residuals that ``value`` (of window and bins) leaves."""
    return state.mapPartitions(lambda records: ((w, bins, keys, rest - value(w, bins)) for w, bins, keys, rest in records), True)


def fit(panel: DataFrame, windows: list[tuple], names: list[str], c) -> list[list[tuple]]:
    """The trees of each window (last date, rows, their largest absolute return), as boost.fit has them."""
    spark, scratch = panel.sparkSession, Scratch(panel.sparkSession)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    ends, sizes, units = [(w[0] - date(1970, 1, 1)).days for w in windows], [w[1] for w in windows], [boost.unit(*w[1:]) for w in windows]
    rows = panel.where(F.col("date") <= F.lit(max(w[0] for w in windows)))
    rows = scratch.write(rows.select(F.unix_date("date").alias("day"), boost.key(), "fwd", *names), "panel")
    state = shared = file = None
    try:
        cuts = thresholds(rows, ends, sizes, names, scratch)
        state, shared = pieces(rows, ends, sizes, names, cuts, units)
        totals = collected(state.persist(StorageLevel.MEMORY_AND_DISK), lambda w, bins, keys, rest: rest.sum())
        means, grown = [float(np.rint(totals[w] / n)) for w, n in enumerate(sizes)], [[] for _ in windows]
        value = lambda w, bins: means[w]
        for t in range(c.trees):
            old, state = state, less(state, value).persist(StorageLevel.MEMORY_AND_DISK)
            if t % CUT == CUT - 1:
                state.checkpoint()
            trees, level = [boost.Tree(t, len(names), c) for _ in windows], 0
            while any(tree.open for tree in trees):
                for w, sums in collected(state, level_sums(trees, t, level, c)).items():
                    trees[w].split(level, sums, units[w])
                level += 1
            old.unpersist()
            if new := state.getCheckpointFile():
                file, gone = new, file
                remove(spark, gone)
            for own, tree in zip(grown, trees):
                own.append(tree)
            value = lambda w, bins, trees=trees: trees[w].value()[trees[w].nodes(bins, c.depth)]
    finally:
        if state is not None:
            state.unpersist()
            shared.destroy()
        remove(spark, file)
        scratch.drop()
    return [[(mean * one, n), *[tree.nested(own, one) for tree in trees]] for mean, one, n, trees, own in zip(means, units, sizes, grown, cuts)]


def remove(spark: SparkSession, file: str | None) -> None:
    if file:
        at = spark._jvm.org.apache.hadoop.fs.Path(file)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scored(panel: DataFrame, blocks: list[tuple], names: list[str], c) -> DataFrame:
    """As boost.by_task, for windows of any size; the models are broadcast."""
    models = fit(panel, [b[2:] for b in blocks], names, c)
    shared = panel.sparkSession.sparkContext.broadcast([pickle.dumps(m) for m in models])
    test = panel.join(boost.spans_of(panel, blocks), F.col("date").between(F.col("first"), F.col("last"))).select("block", "date", "ticker", *names)

    def predicted(batches):
        for pdf in batches:
            for block, own in pdf.groupby("block"):
                yield own[["date", "ticker"]].assign(composite_score=boost.predict(pickle.loads(shared.value[block]), own[names].to_numpy(float)))

    test = test.repartitionByRange("block", "ticker").sortWithinPartitions("block")  # so that a batch needs few models
    return test.mapInPandas(predicted, "date date, ticker string, composite_score double")


def walk(panel: DataFrame, blocks: list[tuple], names: list[str], c) -> DataFrame:
    """``date, ticker, composite_score``: each block (first date, last date, end of training, rows of training, their largest
    absolute return) by its own model, of all rows of its training window.

    A window of up to ``task_rows`` rows goes to one task with the dates it scores, the windows side by side; longer ones are
    fitted in pieces, all at once.
    """
    few = [b for b in blocks if b[3] <= c.task_rows]
    more = [b for b in blocks if b[3] > c.task_rows]
    return union([f(panel, own, names, c) for f, own in ((boost.by_task, few), (scored, more)) if own])
