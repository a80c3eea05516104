"""Chat formatting: logged snapshots of growing conversations are collapsed, the maximal ones are rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Turns of a conversation that one task orders together.
SPAN = 512


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, n, role, text``: turns numbered from 1 in order of (turn, role, text), nulls first.

    Done in spans of SPAN turn values: only counts of the spans are summed along a conversation, so a very long one
    is not sorted by one task. Null roles and texts become empty; a null conv_id is a conversation of its own.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("turn") / SPAN).alias("span"))
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("conv_id", "span").agg(F.count("*").alias("c")).select(F.col("conv_id").alias("cid"), F.col("span").alias("sid"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("conv_id", "span").orderBy("turn", "role", "text"))
    rows = rows.withColumn("own", own).join(spans, F.col("conv_id").eqNullSafe(F.col("cid")) & F.col("span").eqNullSafe(F.col("sid")))
    return rows.select("conv_id", (F.col("base") + F.col("own")).alias("n"), "role", "text", F.col("span").alias("part"))


def prefixes(rows: DataFrame) -> DataFrame:
    """Rows of :func:`numbered` with ``h``, the rolling 128-bit hash of turns 1 to n.

    A turn's hash covers its number, role and text, so the running exclusive or of the hashes tells order too; it
    is taken within spans and, one row for each span, along the conversation.
    """
    turn = [F.xxhash64(F.lit(seed), F.col("n"), F.length("role"), F.col("role"), F.col("text")) for seed in (1, 2)]
    rows = rows.withColumns({"h1": turn[0], "h2": turn[1]})
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("conv_id", "part").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    spans = spans.select(F.col("conv_id").alias("cid"), F.col("part").alias("sid"), *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0).cast("long")).alias(f"b{i}") for i in (1, 2)])
    own = Window.partitionBy("conv_id", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"o{i}": F.bit_xor(f"h{i}").over(own) for i in (1, 2)})
    rows = rows.join(spans, F.col("conv_id").eqNullSafe(F.col("cid")) & F.col("part").eqNullSafe(F.col("sid")))
    return rows.select("conv_id", "n", F.struct(*[F.col(f"o{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)]).alias("h"))


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_equal`` of the conversations that no longer one starts with.

    Of equal conversations the one with the smallest conv_id stays, ``n_equal`` tells how many there are. Equal
    conversations and equal proper prefixes are merged before the anti-join, so a first turn or a conversation
    that a third of the log shares is one row on either side.
    """
    heads = prefixes(numbered(turns))
    size = heads.groupBy("conv_id").agg(F.max("n").alias("n_turns"))
    joined = heads.join(size.withColumnRenamed("conv_id", "cid"), F.col("conv_id").eqNullSafe(F.col("cid")))
    flags = joined.groupBy("n", "h").agg(F.max(F.col("n") < F.col("n_turns")).alias("proper"), F.min(F.when(F.col("n") == F.col("n_turns"), F.struct(F.col("conv_id").isNull(), "conv_id"))).alias("least"), F.count(F.when(F.col("n") == F.col("n_turns"), 1)).alias("n_equal"))
    whole = flags.where("least is not null").select("n", "h", "least.conv_id", "n_equal")
    longer = flags.where("proper").select("n", "h")
    return whole.join(longer, ["n", "h"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_equal")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """``kept`` with ``rendered``: ``<|role|>`` and the text of each turn, one to a line pair, in order."""
    rows = numbered(turns).select("conv_id", "n", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text").alias("line"))
    kept = kept.withColumnRenamed("conv_id", "kid")
    rows = rows.join(kept.select("kid"), F.col("conv_id").eqNullSafe(F.col("kid")), "left_semi")
    text = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("rendered"))
    return kept.join(text, F.col("kid").eqNullSafe(F.col("conv_id"))).select("conv_id", "n_turns", "n_equal", "rendered")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: ``conv_id, n_turns, n_equal, rendered``.

    Turns with a null or repeated number keep a defined place (see :func:`numbered`); null roles and texts render
    as empty. Only conv_id, turn, role and text are read; an empty table gives an empty table. Rows that repeat are
    turns that repeat. A conversation is one row of the result, so its own text is gathered, nothing more.
    """
    return render(turns, maximal(turns))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = {
    "op4_chat_format": """
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS n,
                          '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') AS line FROM conversations),
        w AS (SELECT conv_id, list(line ORDER BY n) AS l FROM t GROUP BY conv_id),
        g AS (SELECT min(conv_id) AS conv_id, l, count(*) AS n_equal FROM w GROUP BY l)
        SELECT conv_id, len(l)::BIGINT AS n_turns, n_equal, array_to_string(l, chr(10)) AS rendered FROM g
        WHERE NOT EXISTS (SELECT 1 FROM g AS o WHERE o.l[1] = g.l[1] AND len(o.l) > len(g.l) AND o.l[1:len(g.l)] = g.l)"""
}
