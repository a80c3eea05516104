"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import os
import uuid
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir
from .pieces import _iterated, groups

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


@lru_cache(2)
def load(path: str):
    """A counter of one text's tokens for a .json (tokenizers) or .model (sentencepiece) file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer's file: another version has other counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _stored(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; an empty table where nothing is written yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache) if there else spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, path: str, cache: str) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens``.

    ``cache`` is a Parquet folder of (content digest, tokenizer digest, count) that every executor can reach. Texts
    whose digest it lacks for this tokenizer are encoded once for each distinct content and appended to it; Spark's
    committer makes the append whole or absent, so a lost executor repeats a task but never a row. Should two runs
    append the same content at once, the counts are equal and are merged on reading. Content is normalised from
    null to the empty text only, as the tokenizers tell all other texts apart. Texts are encoded in groups of about
    a million characters. Only doc_id and text are read. Repeated rows are repeated (and their text encoded once), an
    empty table gives an empty table.
    """
    spark, version = docs.sparkSession, tokenizer_digest(path)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("body")).select("doc_id", "body", F.unhex(F.sha2("body", 256)).alias("content"))
    known = _stored(spark, cache).where(F.col("tokenizer") == version)

    def count(batches):
        for texts in batches:
            yield pd.Series([n for part in groups(texts) for n in load(path)(part)], dtype="int64")

    misses = rows.select("content", "body").join(known, "content", "left_anti").dropDuplicates(["content"])
    fresh = misses.select("content", F.lit(version).alias("tokenizer"), _iterated(count, "long")("body").alias("n_tokens"))
    fresh.write.mode("append").parquet(cache)
    counts = _stored(spark, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), "content").join(counts, "content").select("doc_id", "n_bytes", "n_tokens")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that each run counts the whole table."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), cache).withColumn("over_limit", F.col("n_tokens") > 1024)
