"""Near-duplicate detection: SimHash fingerprints joined on deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components

SEED, BLOCK = 42, 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The 64 bits, as a signed integer, that are set in over half of the hashes; 0 for none."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        votes += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of one text, over shingles of ``words`` words with their repeats.

    A-Z are lower-cased, words are what lies between the ASCII white space. A text with fewer words is one
    shingle; one without words (null too) gives 0. A bit is 1 if it is set in over half of the shingles' hashes.
    """
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line, n = b" ".join(parts), max(1, len(parts) - words + 1)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[:n], end[min(words, len(parts)) - 1 :]
    spans = zip(start.tolist(), end.tolist())
    return majority(np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans), np.uint64, n))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id`` and the fingerprint ``fp`` (as a signed long) of every row."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, words) for x in texts], dtype="int64")

    return docs.select("doc_id", simhash("text").alias("fp"))


def variants(fps: DataFrame, radius: int, *keep) -> DataFrame:
    """The index: ``key`` and the columns ``keep`` (``fp``), one key for each bit of each segment, with that bit left out.

    With ``radius // 2 + 1`` segments, two fingerprints within the radius differ by one bit at most in some
    segment, so they share the key that leaves out this bit (any key of the segment if they agree on it).
    """
    n = radius // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    bits = [(lo, hi, bit) for lo, hi in zip(edges, edges[1:]) for bit in range(lo, hi)]
    of = "array({})".format
    low, mask = of(",".join(str(lo) for lo, _, _ in bits)), of(",".join(f"{(((1 << (hi - lo)) - 1) & ~(1 << (bit - lo))) & ((1 << 64) - 1)}L" for lo, hi, bit in bits) if n > 1 else ",".join(f"{~(1 << bit) if bit < 63 else (1 << 63) - 1}L" for _, _, bit in bits))
    spread = fps.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    kept = f"(shiftrightunsigned(fp, {low}[bit]) & {mask}[bit])"
    return spread.select(F.expr(f"struct(cast(bit as tinyint) as bit, {kept} as rest)").alias("key"), *(keep or ["fp"]))


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints that differ in 1 to ``radius`` bits; every such pair, once.

    The index has 64 rows for each fingerprint, which Spark's estimate of its size does not count, so the join is told to
    sort and merge: broadcast, the index would go whole through the driver.
    """
    index = variants(fps.select("fp").distinct(), radius).select("key.bit", "key.rest", "fp").hint("merge")
    one, other = index.withColumnRenamed("fp", "a"), index.withColumnRenamed("fp", "b")
    near = one.join(other, ["bit", "rest"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return near.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``, ``n_links``.

    Fingerprints within ``radius`` bits are linked; ``component_id`` is the smallest doc_id reachable. ``n_links``
    counts the other distinct fingerprints linked to the row's own. Equal fingerprints meet as one node, so copies
    are never paired with each other. Null and empty texts share fingerprint zero. Rows with a null doc_id get the
    component's id but can't name it (null if no row of it has an id); repeated rows are repeated in the result.
    Columns other than doc_id and text are not read. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(fingerprints(docs, words), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = scratch.write(links(rows, radius), "links")
    root = connected_components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    named = nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(component, "root").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = rows.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
