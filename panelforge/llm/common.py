"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, shared_dir, written

__all__ = ["Scratch", "ascii_lower", "connected_components", "content", "packed", "shared_dir", "small", "text_batches", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a side of a join that are broadcast up to this many; their columns are a few ids or digests.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, entries: F.Column | None = None) -> DataFrame:
    """``df``, a written table of ids or digests, to be broadcast if it has BROADCAST_ROWS rows at most; where rows have
    an array, ``entries`` is its length, and all rows together have so many entries at most."""
    n = df.count() if entries is None else df.agg(F.coalesce(F.sum(entries), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


@contextmanager
def text_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """What runs inside hands texts to Python in batches of so many rows: sets of whole texts take memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def content() -> F.Column:
    """A 128-bit digest of the column ``text``, null as empty: names a text in joins that must not carry it."""
    text = F.coalesce("text", F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def packed(docs: DataFrame) -> F.Column:
    """All columns of ``docs`` in one, so that a join's own columns can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def ascii_lower(col) -> F.Column:
    """Lower-case A-Z only, other letters stay."""
    return F.translate(col, UPPER, LOWER)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as long pairs ``(a, b)``: rows ``(node, root)``, root the least node.

    Alternates large-star and small-star steps (Kiveris et al. 2014). Each step is a grouped minimum, combined
    before its shuffle, and a join back that adaptive execution can split for a hub; each round is written to the
    shared folder, and only its row count and checksum reach the driver. Nulls and self-loops are ignored.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.write(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        star = down.join(low, "a")
        star = star.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = scratch.write(star.where("a <> b").distinct(), "edges")
    roots = now.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("root"))
    return roots.unionByName(now.select(F.least("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))
