"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, content, small, written

#: The index has eight blocks of eight bits, so it finds all fingerprints up to seven bits apart.
WORDS, SIMILARITY, RADIUS = 5, 0.8, 7
#: More shingles than a text has.
MANY = 2**31 - 1


def words(text) -> F.Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingled(rows: DataFrame, parts: str = "w") -> DataFrame:
    """``rows`` with ``grams``: hashes of the runs of WORDS words in array ``parts``.

    Fewer words are one shingle, none have none. Words are hashed once, in a column of their own.
    """
    rows = rows.withColumn("_h", F.transform(parts, lambda w: F.xxhash64(w)))
    n = F.size("_h")
    runs = F.transform(F.sequence(F.lit(1), n - WORDS + 1), lambda i: F.xxhash64(*[F.element_at(F.col("_h"), i + k) for k in range(WORDS)]))
    grams = F.when(n >= WORDS, runs).when(n > 0, F.array(F.xxhash64(F.array_join(parts, " ")))).otherwise(F.array().cast("array<long>"))
    return rows.withColumn("grams", grams).drop("_h")


def fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and ``fp`` of rows with an array ``grams``, by summing the exploded shingles' bits."""
    each = rows.select(key, F.explode("grams").alias("g"))
    votes = [F.sum(F.shiftrightunsigned("g", b).bitwiseAND(1)).alias(f"b{b}") for b in range(64)]
    summed = each.groupBy(key).agg(F.count("*").alias("n"), *votes)
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("n"), F.lit((1 << b) if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return summed.select(key, fp.alias("fp"))


def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, mask) of the radius + 1 blocks of a fingerprint: within the radius one block at least is equal."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(lo, (1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:])]


def indexed(rows: DataFrame, radius: int, fp: str = "fp") -> DataFrame:
    """A row for each block of the fingerprint: ``block, value``."""
    keys = F.array(*[F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit(mask).cast("long")) for lo, mask in blocks(radius)])
    return rows.select("*", F.posexplode(keys).alias("block", "value"))


def short_runs(sizes: list[int]) -> F.Column:
    """Runs of words of each of the ``sizes`` under WORDS, hashed as items of that size are: (position, shingle).

    A text of just so many words has this run as its one shingle already.
    """
    w = F.col("w")

    def runs(k):
        found = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.array_join(F.slice(w, i + 1, k), " ")).alias("g")))
        return F.when(F.size(w) > k, found).otherwise(F.array().cast("array<struct<pos:int,g:bigint>>"))

    return F.concat(*map(runs, sizes))


def counted(items: DataFrame) -> DataFrame:
    """``ref, size, m, g, d``: shingle ``g`` occurs ``d`` times among the ``m`` of an item."""
    each = items.select("ref", "size", F.size("grams").alias("m"), F.explode("grams").alias("g"))
    return each.groupBy("ref", "size", "m", "g").agg(F.count("*").cast("int").alias("d"))


def occurrences(docs: DataFrame, items: DataFrame, known: DataFrame) -> DataFrame:
    """``content, n, g, at``: the places, in order, of a benchmark shingle ``g`` in a text of ``n`` shingles (MANY for
    the runs of short items). Linear in the texts; equal texts are one."""
    texts = docs.select(content().alias("content"), words(F.col("text")).alias("w"))
    sizes = [r["size"] for r in items.where(F.col("size") < WORDS).select("size").distinct().collect()]  # four at most
    # the outer form: for the inner one the optimizer adds a filter on the array and computes it there once more
    runs = shingled(texts).select("content", F.size("grams").alias("n"), F.posexplode_outer("grams").alias("pos", "g"))
    if sizes:
        runs = runs.unionByName(texts.select("content", F.lit(MANY).alias("n"), F.inline(short_runs(sizes))))
    met = runs.join(small(known.select("g").distinct()), "g", "left_semi")
    return met.groupBy("content", "n", "g").agg(F.sort_array(F.collect_set("pos")).alias("at"))


def best_windows(met: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """``content, ref, size, start``: of the windows of an item's size, the first that shares most shingles with it.

    A window from shingle s on has m shingles, as the item has (or all n of a shorter text), so the most shared ones
    make it the most similar. An occurrence at p counts in the windows from p - m + 1 to p; one that has d or more of
    its shingle before it counts only in those that start after the d-th before it. So windows share as many shingles
    as there are such stretches over their start: one running sum over the stretches' ends, whatever repeats. Pairs
    that don't have enough occurrences for the threshold in the whole text are left out before that.
    """
    pair = Window.partitionBy("content", "ref")
    both = met.join(small(known), "g").withColumn("most", F.sum(F.least(F.size("at"), "d")).over(pair))
    both = both.where(F.col("most") * (1 + threshold) >= (F.least("m", "n") + F.col("m")) * threshold - 1e-6)
    last = F.greatest(F.col("n") - F.col("m"), F.lit(0))

    def stretch(p, i):
        after = F.when(i >= F.col("d"), F.get("at", i - F.col("d")) + 1).otherwise(0)
        return F.struct(F.greatest(p - F.col("m") + 1, after).alias("lo"), F.least(p, last).alias("hi"))

    spans = both.select("content", "ref", "size", F.inline(F.transform("at", stretch))).where("lo <= hi")
    ends = F.array(F.struct(F.col("lo").alias("start"), F.lit(1).alias("step")), F.struct((F.col("hi") + 1).alias("start"), F.lit(-1).alias("step")))
    steps = spans.select("content", "ref", "size", F.inline(ends))
    level = F.struct(F.sum("step").over(pair.orderBy("start")).alias("shared"), (-F.col("start")).alias("order"))
    return steps.withColumn("level", level).groupBy("content", "ref", "size").agg(F.max_by("start", "level").alias("start"))


def similarities(pairs: DataFrame, windows: DataFrame, items: DataFrame) -> DataFrame:
    """``pairs`` (id, ref) with ``similarity``: weighted Jaccard, a shingle's weight being how often it occurs."""
    left = windows.select("id", F.explode("grams").alias("g")).groupBy("id", "g").agg(F.count("*").alias("c"))
    right = items.select("ref", F.explode("grams").alias("g")).groupBy("ref", "g").agg(F.count("*").alias("d"))
    common = pairs.join(left, "id").join(right, ["ref", "g"]).groupBy("id", "ref").agg(F.sum(F.least("c", "d")).alias("common"))
    sizes = common.join(windows.select("id", F.size("grams").alias("a")), "id").join(items.select("ref", F.size("grams").alias("b")), "ref")
    return sizes.select("id", "ref", (F.col("common") / (F.col("a") + F.col("b") - F.col("common"))).alias("similarity"))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``(content, item_id, similarity)``: digests of texts with a window that is near a benchmark item, written.

    Windows have as many words as an item. A window can only reach the threshold if it shares shingles with the item,
    so a pass over all shingles of all texts, joined with the benchmark's, tells where windows are cut (see
    best_windows). These windows and the items get SimHash fingerprints, and a multi-index over their blocks finds
    all items of a window's size within the radius. As similar windows can be farther apart, the window of a text
    that is best for an item is a candidate for it in any case. The shingles' exact weighted similarity decides on
    all candidates. Equal windows are compared once.
    """
    scratch = Scratch(docs.sparkSession)
    items = shingled(benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).distinct()).withColumn("size", F.size("w")).where("size > 0")
    items = scratch.write(items.select(F.monotonically_increasing_id().alias("ref"), "item_id", "size", "grams"), "items")
    known = scratch.write(counted(items), "known")
    starts = scratch.write(best_windows(scratch.write(occurrences(docs, items, known), "met"), known, threshold), "starts")
    spots = scratch.write(starts.groupBy("content").agg(F.collect_set(F.struct("start", "size")).alias("spots")), "spots")
    texts = docs.select(content().alias("content"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(small(spots, F.size("spots")), "content").dropDuplicates(["content"]).select("content", "spots", words(F.col("text")).alias("w"))
    cut = F.transform("spots", lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"), F.array_join(F.slice(F.col("w"), s["start"] + 1, s["size"]), " ").alias("words")))
    windows = texts.select("content", F.inline(cut)).withColumn("id", F.struct(F.xxhash64("words").alias("a"), F.xxhash64(F.lit(1), "words").alias("b")))
    windows = scratch.write(windows, "windows")
    own = windows.join(starts, ["content", "start", "size"]).select("id", "ref")
    distinct = scratch.write(shingled(windows.dropDuplicates(["id"]).select("id", "size", F.split("words", " ").alias("w"))).select("id", "size", "grams"), "distinct")
    left = indexed(distinct.select("id", "size").join(fingerprints(distinct, "id"), "id"), radius)
    right = indexed(items.select("ref", "size").join(fingerprints(items, "ref").withColumnRenamed("fp", "own"), "ref"), radius, "own")
    near = left.join(right, ["size", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("own"))) <= radius).select("id", "ref")
    pairs = scratch.write(near.unionByName(own).distinct(), "pairs")
    sure = scratch.write(similarities(pairs, distinct, items).where(F.col("similarity") >= threshold - 1e-9), "sure")
    found = windows.select("content", "id").join(sure, "id").join(small(items.select("ref", "item_id")), "ref")
    found = scratch.write(found.groupBy("content", "item_id").agg(F.max("similarity").alias("similarity")), "found")
    scratch.drop(found)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, contaminated, n_items, item_id, similarity``.

    ``item_id`` is the most similar item (ties: the smallest), null with similarity 0 for clean rows. Null and
    empty texts, and items without words or with a null id, match nothing; items under five words are one shingle,
    which matches wherever these words follow each other. Only doc_id and text, item_id and text are read; repeated rows are
    repeated; an empty table on either side gives no match.
    """
    best = matches(docs, benchmark, threshold, radius).groupBy("content").agg(F.count("*").alias("n_items"), F.max(F.struct("similarity", (-F.col("item_id")).alias("minus"))).alias("top"))
    rows = docs.select("doc_id", content().alias("content")).join(small(written(best, "best")), "content", "left")
    return rows.select("doc_id", F.col("top").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), (-F.col("top.minus")).alias("item_id"), F.coalesce("top.similarity", F.lit(0.0)).alias("similarity"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items)
