"""The prefix tree of conversations: owned chains found by binary search against the minima of prefix digests."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chat import SPAN, numbered
from .common import Scratch, small

#: What counts as a word of a turn's text.
WORD = r"[^\x20\x09-\x0D]+"
#: Ids of one node are first put in a line by ranges of so many.
CHUNK = 65_536


def digests(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id, n, h, words`` of every prefix: its 128-bit digest and the words of its last turn; depth 0 included.

    ``rows`` are turns numbered from 1 without gaps. A turn's hash covers its number, role and text, so the running
    exclusive or tells order too. It is taken within spans of SPAN turns, and along a conversation by one row a span.
    """
    part = F.floor(F.col("n") / SPAN).alias("part")
    turn = [F.xxhash64(F.lit(seed), F.col("n"), F.length("role"), F.col("role"), F.col("text")).alias(f"h{seed}") for seed in (1, 2)]
    rows = rows.select("conv_id", F.col("n").cast("long").alias("n"), part, *turn, F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("conv_id", "part").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    spans = spans.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0).cast("long")).alias(f"b{i}") for i in (1, 2)])
    own = Window.partitionBy("conv_id", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"o{i}": F.bit_xor(f"h{i}").over(own) for i in (1, 2)}).join(spans, ["conv_id", "part"])
    digest = F.struct(*[F.col(f"o{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)]).alias("h")
    zero = F.lit(0).cast("long")
    return rows.select("conv_id", "n", digest, "words").unionByName(conversations.select("conv_id", zero.alias("n"), F.struct(zero.alias("h1"), zero.alias("h2")).alias("h"), zero.alias("words")))


def minima(prefixes: DataFrame) -> DataFrame:
    """A row for each distinct prefix: ``n, h, conv_id`` (its smallest member, which owns it), ``n_convs, words``."""
    return prefixes.groupBy("n", "h").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))


def chains(prefixes: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, first, top, parent`` of every conversation, written.

    A conversation that owns a prefix owns all longer ones of its own, so the depth of its ``first`` is found by
    binary search: each round looks up one depth of every conversation that is still open. ``first`` is ``top`` + 1 if
    it owns none. ``parent`` owns the prefix one turn shorter (none above depth 0). Only prefixes with several
    members are looked up in, a prefix alone is its conversation's own. Digests lie in rows of SPAN depths.
    """
    shared = scratch.write(nodes.where("n_convs > 1").select("n", "h", F.col("conv_id").alias("owner")), "shared")
    spans = prefixes.groupBy("conv_id", F.floor(F.col("n") / SPAN).alias("span")).agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("of"))
    spans = scratch.write(spans, "spans")
    shared = small(shared)
    lengths = scratch.write(prefixes.groupBy("conv_id").agg(F.max("n").alias("top")), "lengths")

    def owners(asked: DataFrame) -> DataFrame:
        """``asked`` (conv_id, at) with ``owner`` of the prefix of that depth, null where it is alone."""
        asked = asked.withColumn("span", F.floor(F.col("at") / SPAN)).join(spans, ["conv_id", "span"])
        asked = asked.withColumn("h", F.col("of")[(F.col("at") - F.col("of")[0]["n"]).cast("int")]["h"]).drop("of", "span")
        return asked.join(shared.withColumnRenamed("n", "at"), ["at", "h"], "left").drop("h")

    most = lengths.agg(F.max("top")).first()[0]
    live = lengths.select("conv_id", F.lit(0).cast("long").alias("low"), (F.col("top") + 1).alias("high"))
    done = []
    for _ in range(0 if most is None else (most + 1).bit_length()):  # an interval of k + 1 depths takes as many halvings
        asked = owners(live.withColumn("at", F.floor((F.col("low") + F.col("high")) / 2)))
        own = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True))
        live = asked.select("conv_id", F.when(own, F.col("low")).otherwise(F.col("at") + 1).alias("low"), F.when(own, F.col("at")).otherwise(F.col("high")).alias("high"))
        now = scratch.write(live, "search")
        done.append(now.where("low = high"))
        live = now.where("low < high")
    found = live
    for rows in done:
        found = found.unionByName(rows)
    found = found.select("conv_id", F.col("low").alias("first")).join(lengths, "conv_id")
    above = owners(found.where("first > 0").withColumn("at", F.col("first") - 1)).select("conv_id", "first", "top", F.col("owner").alias("parent"))
    return scratch.write(above.unionByName(found.where("first = 0").select("conv_id", "first", "top", F.lit(None).cast("long").alias("parent"))), "chains")


def totals(own: DataFrame, values: list[str], scratch: Scratch) -> DataFrame:
    """Sums of ``values`` over each chain and all chains below it, from ``own`` (conv_id, up, values).

    Bottom-up in doubling rounds: after k of them a chain has the sums of what is less than 2^k steps below, and
    ``up`` is the chain 2^k steps above; so a tower of n chains takes log n rounds.
    """
    now = scratch.write(own, "totals")
    while not now.where("up is not null").isEmpty():
        add = now.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        jump = now.select(F.col("conv_id").alias("up"), F.col("up").alias("further"))
        now = now.join(add, "conv_id", "left").join(jump, "up", "left")
        now = scratch.write(now.select("conv_id", F.col("further").alias("up"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]), "totals")
    return now.drop("up")


def suffix_sums(rows: DataFrame, values: list[str]) -> DataFrame:
    """``rows`` (conv_id, n, ...) with each of ``values`` summed over a chain from n on, in spans of SPAN depths."""
    rows = rows.withColumn("part", F.floor(F.col("n") / SPAN))
    later = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("conv_id", "part").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    spans = spans.select("conv_id", "part", *[F.coalesce(F.sum(f"_{v}").over(later), F.lit(0)).alias(f"_{v}") for v in values])
    own = Window.partitionBy("conv_id", "part").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({v: F.sum(v).over(own) for v in values}).join(spans, ["conv_id", "part"])
    return rows.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("part", *[f"_{v}" for v in values])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """``conv_id, n, ends_sha256``: of each node, the hash of the ids of ``ends`` (conv_id, n, id), ascending, by commas.

    Ids are put in a line by ranges of CHUNK, then a node's lines go through the hash in order, one after the other.
    """
    chunks = ends.groupBy("conv_id", "n", F.floor(F.col("id") / CHUNK).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))

    def hashed(batches):
        key = state = None
        for pdf in batches:
            rows = []
            for conv, n, ids in zip(pdf["conv_id"], pdf["n"], pdf["ids"]):
                if (conv, n) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = (conv, n), hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(rows, columns=["conv_id", "n", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["conv_id", "n", "ends_sha256"])

    return chunks.repartition("conv_id", "n").sortWithinPartitions("conv_id", "n", "range").mapInPandas(hashed, "conv_id long, n long, ends_sha256 string")


def trie_of(rows: DataFrame, conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """As :func:`prefix_trie`, of turns numbered from 1 without gaps, and all conversations' ids."""
    prefixes = scratch.write(digests(rows, conversations), "prefixes")
    nodes = scratch.write(minima(prefixes), "nodes")
    found = chains(prefixes, nodes, scratch)
    owning = found.where("first <= top")
    hung = owning.where("first > 0").select(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("n"), F.col("conv_id").alias("chain"))
    saved = (F.col("n_convs") - 1) * F.col("words")
    crowns = owning.select("conv_id", F.col("top").alias("n")).join(hung.select("conv_id", "n").distinct(), ["conv_id", "n"], "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    own = nodes.groupBy("conv_id").agg(F.sum(saved).alias("saved_tokens")).join(owning.select("conv_id", F.col("parent").alias("up")), "conv_id").join(crowns, "conv_id", "left")
    sums = ["saved_tokens", "n_leaves"]
    below = totals(own.select("conv_id", "up", "saved_tokens", F.coalesce("leaf", F.lit(0)).cast("long").alias("n_leaves")), sums, scratch)
    hung = hung.join(below.withColumnRenamed("conv_id", "chain"), "chain").groupBy("conv_id", "n").agg(F.count("*").alias("hung"), *[F.sum(v).alias(f"hung_{v}") for v in sums])
    ends = found.select(F.when(F.col("first") <= F.col("top"), F.col("conv_id")).otherwise(F.col("parent")).alias("conv_id"), F.col("top").alias("n"), F.col("conv_id").alias("id"))
    # what is known of a node beyond its row, in one table by the node's key, so that one join without a hot key takes it in
    marks = hung.unionByName(owning.select("conv_id", F.col("first").alias("n"), F.lit(True).alias("starts"), "parent"), allowMissingColumns=True)
    marks = marks.unionByName(owning.select("conv_id", F.col("top").alias("n"), F.lit(True).alias("stops")), allowMissingColumns=True).unionByName(ends_hashes(ends), allowMissingColumns=True)
    marks = marks.groupBy("conv_id", "n").agg(*[F.max(c).alias(c) for c in marks.columns if c not in ("conv_id", "n")])
    rows = nodes.join(marks, ["conv_id", "n"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    goes_on = F.col("stops").isNull()
    rows = rows.select(
        "conv_id", "n", F.when(F.col("starts"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        (zero("hung") + goes_on.cast("long")).alias("n_children"), (zero("hung_n_leaves") + (~goes_on & F.col("hung").isNull()).cast("long")).alias("n_leaves"),
        (saved + zero("hung_saved_tokens")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    out = scratch.write(suffix_sums(rows, sums).withColumnRenamed("n", "depth"), "trie")
    scratch.drop(out)
    return out


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """A row for each distinct sequence of a conversation's first turns, the empty one included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at depth 0), ``n_convs`` (members: conversations
    that start with it), ``n_children``, ``n_leaves`` (childless nodes of its subtree), ``saved_tokens`` (words that
    its subtree's shared turns need not hold again) and ``ends_sha256`` (of the ids of members that end there).

    Turns are ordered by (turn, role, text), nulls first; null roles and texts are empty; rows that repeat are turns
    that repeat. Rows without a conv_id are left out. ``conversations`` may list ids (conv_id), for those without
    turns. Only the named columns are read; an empty table gives an empty table. Equal conversations are members of
    one node and are never paired.
    """
    scratch = Scratch(turns.sparkSession)
    rows = scratch.write(numbered(turns.where("conv_id is not null")).select("conv_id", "n", "role", "text"), "turns")
    ids = rows.select("conv_id")
    if conversations is not None:
        ids = ids.unionByName(conversations.select("conv_id").where("conv_id is not null"))
    return trie_of(rows, ids.distinct(), scratch)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix tree of conversations that take their first turns, none to three, from one of every twenty."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    scratch = Scratch(spark)
    rows = scratch.write(numbered(turns.where("conv_id is not null")).select("conv_id", "n", "role", "text"), "logged")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    ids = scratch.write(rows.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), h.alias("h")), "ids")
    heads = rows.where("n <= 3").select(F.col("conv_id").alias("base"), F.col("n"), "role", "text")
    lent = scratch.write(ids.join(heads, "base").where("n <= h").select("conv_id", "n", "role", "text"), "lent")
    few = lent.groupBy("conv_id").agg(F.count("*").alias("k"))
    short = ids.join(few, "conv_id", "left").select("conv_id", (F.col("h") - F.coalesce("k", F.lit(0))).alias("gap")).where("gap > 0")
    own = rows.where(F.col("n") > h).join(small(scratch.write(short, "short")), "conv_id", "left")
    own = own.select("conv_id", (F.col("n") - F.coalesce("gap", F.lit(0))).alias("n"), "role", "text")
    out = trie_of(lent.unionByName(own), ids.select("conv_id"), scratch)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = {
    "op12_prefix_trie": r"""
        WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, xor(4294967295, list_reduce(
                  list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
                  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, zero: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
        b AS (SELECT c.conv_id, n, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND n <= h UNION ALL SELECT conv_id, n, role, text FROM o JOIN c USING (conv_id) WHERE n > h),
        r AS (SELECT conv_id, coalesce(l, []) AS l FROM c LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY n) AS l FROM b GROUP BY conv_id) USING (conv_id)),
        p AS (SELECT conv_id, len(l) = d AS ends, d, l[1:d] AS k FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM r)),
        t AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ends FROM p GROUP BY k, d),
        f AS (SELECT k, d - 1 AS d, count(*) AS n_children FROM (SELECT k[1:d - 1] AS k, d FROM t WHERE d > 0) GROUP BY k, d),
        s AS (SELECT t.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(k[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM t LEFT JOIN f USING (k, d)),
        a AS (SELECT k[1:up] AS k, up AS d, sum(saved)::BIGINT AS saved_tokens, count_if(n_children = 0)::BIGINT AS n_leaves FROM (SELECT k, saved, n_children, unnest(range(d + 1)) AS up FROM s) GROUP BY 1, 2)
        SELECT s.conv_id, s.d AS depth, o.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens, sha256(coalesce(s.ends, '')) AS ends_sha256
        FROM s JOIN a USING (k, d) LEFT JOIN t AS o ON o.d = s.d - 1 AND o.k = s.k[1:s.d - 1]"""
}
