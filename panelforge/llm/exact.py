"""Exact deduplication by deterministic block naming (Karp, Miller and Rosenberg 1972)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

BLOCK_BYTES, SALTS = 4096, 64


def named_blocks(docs: DataFrame, block_bytes: int, scratch: Scratch) -> DataFrame:
    """Level 0: ``(rid, pos, n, name, head)``, one row per block of a normalised text; equal blocks, equal names.

    ``rid`` numbers the rows, ``n`` is the text's number of blocks, ``head`` its doc_id and SHA-256 (at pos 0).
    Blocks are dealt out by hash and a salt of the row, so that a block of a third of all rows is spread, and
    ranked by sorting the bytes themselves: the hash only places a block, it never decides equality. The firsts of
    each salt are then sorted together, which gives the names.
    """
    text = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", ascii_lower(F.coalesce("text", F.lit(""))).cast("binary").alias("body"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes)).cast("int")
    text = text.select("rid", F.struct("doc_id", F.sha2("body", 256).alias("sha")).alias("head"), n.alias("n"), "body")
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)))
    rows = text.select("rid", "head", "n", F.posexplode(cut).alias("pos", "block"))
    rows = rows.select("rid", F.when(F.col("pos") == 0, F.col("head")).alias("head"), "n", "pos", F.xxhash64("block").alias("h"), F.pmod("rid", F.lit(SALTS)).cast("int").alias("salt"), "block")
    w = Window.partitionBy("h", "salt").orderBy("block")
    rows = rows.withColumn("r", F.dense_rank().over(w)).withColumn("same", F.lag("block").over(w).eqNullSafe(F.col("block")))
    rows = scratch.write(rows.withColumn("block", F.when(~F.col("same"), F.col("block"))).drop("same"), "blocks")
    firsts = rows.where(F.col("block").isNotNull()).select("h", "salt", "r", "block")
    firsts = firsts.withColumn("order", F.dense_rank().over(Window.partitionBy("h").orderBy("block"))).select("h", "salt", "r", "order", F.monotonically_increasing_id().alias("at"))
    names = firsts.select("h", "salt", "r", F.min("at").over(Window.partitionBy("h", "order")).alias("name"))
    named = scratch.write(rows.drop("block").join(names, ["h", "salt", "r"]).select("rid", "pos", "n", "name", "head"), "names")
    scratch.drop(named)
    return named


def identities(docs: DataFrame, block_bytes: int, scratch: Scratch) -> DataFrame:
    """``(rid, head, level, name)``, one row per row of ``docs``; (level, name) is equal exactly when the texts are.

    Adjacent pairs of names are named anew until a text has one name; texts of different numbers of levels differ
    in length. Every level is written to the shared folder; rows halve from level to level.
    """
    rows, level, done = named_blocks(docs, block_bytes, scratch), 0, []
    most = rows.agg(F.max("n")).first()[0] or 1
    while True:
        done.append(rows.where("n = 1").select("rid", "head", F.lit(level).alias("level"), "name"))
        if most == 1:
            break
        level, most = level + 1, (most + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = rows.where("n > 1").groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
            F.max("n").alias("n"), F.max("head").alias("head"))
        pairs = scratch.write(pairs, f"pairs{level}")
        names = pairs.select("left", "right").distinct().sortWithinPartitions("left", "right").withColumn("name", F.monotonically_increasing_id())
        half = F.floor((F.col("n") + 1) / 2).cast("int").alias("n")
        rows = scratch.write(pairs.join(names, ["left", "right"]).select("rid", "pos", half, "name", "head"), f"level{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id
    stays; a null doc_id is the smallest, and of rows that repeat the largest doc_id exactly one stays. Only doc_id
    and text are read; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(identities(docs, block_bytes, scratch), "identities")
    scratch.drop(rows)
    groups = rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("head.doc_id", "rid")).alias("keep"))
    out = rows.join(groups, ["level", "name"])
    return out.select("head.doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), F.col("head.sha").alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""
}
