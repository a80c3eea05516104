"""Joins of texts on the Jaccard similarity of their n-gram sets: signature trees over sets that share a part."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, content, small, text_batches

#: Texts link when their sets of shingles of WORDS words share PERCENT of their union.
WORDS, PERCENT = 3, 90
#: The largest size of a class of sizes is so many times its smallest.
GROWTH = 1.3
#: Bits of a signature for each shingle of a set, and the most there are.
DENSITY, MOST_BITS = 4, 8192
#: Children of a tree's node; sets of one group that one tree holds at most; pairs of nodes looked at together.
FANOUT, BLOCK, STEP = 16, 2048, 1 << 12
#: Bytes of words whose hashes a task keeps.
CACHE_BYTES = 1 << 24


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values, spread evenly."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Hashes(dict):
    """Word to hash; forgets all beyond CACHE_BYTES of words."""

    size = 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self.size += len(word) + 100
        if self.size > CACHE_BYTES:
            self.clear()
            self.size = 0
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def grams(text: str | None, words: int, hashes: Hashes) -> np.ndarray:
    """The distinct shingles' hashes, ascending, unsigned. A text with fewer words is one shingle, none has none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n, k = len(parts), min(words, len(parts))
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, parts), np.uint64, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : n - k + 1 + i])
    return np.unique(out)


def size_classes(most: int, percent: int) -> list[int]:
    """The least sizes of the classes up to that of ``most`` and the next two: a set's partners are in its class or one beside it."""
    edges = [1]
    while len(edges) < 3 or edges[-3] <= most:
        last = edges[-1]
        edges.append(max(last + 1, int(last * GROWTH), (last - 1) * 100 // percent + 1))
    return edges


def parts_of(edges: list[int], k: int, percent: int) -> int:
    """Parts of sets in class ``k``: one more than the most shingles in which two of them that link can differ."""
    return 2 * (edges[k + 1] - 1) * (100 - percent) // (100 + percent) + 1


def part_keys(tokens: np.ndarray, edges: list[int], percent: int) -> np.ndarray:
    """Keys of a set's parts, in its own class, and in the next one if partners can be there.

    A part holds the shingles whose hashes are in one of the equal ranges. Two sets that link differ in fewer shingles
    than there are parts in the larger one's class, so one part is the same in both (empty ones too), and so is its key.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    k = int(np.searchsorted(edges, n, side="right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens ^ np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)])
    out = []
    for c in (k, k + 1) if n * 100 // percent >= edges[k + 1] else (k,):
        m = parts_of(edges, c, percent)
        if m == 1:  # only equal sets link
            continue
        at = np.searchsorted((tokens >> np.uint64(32)) * np.uint64(m) >> np.uint64(32), np.arange(m + 1, dtype=np.uint64))
        place = mixed(np.arange(m, dtype=np.uint64) + np.uint64(c << 40))
        out.append(mixed(sums[at[1:]] - sums[at[:-1]] + place))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def signature(tokens: np.ndarray, density: int = DENSITY) -> np.ndarray:
    """The set's bitmap: a bit for each shingle, of ``density`` bits for a shingle, rounded up to a power of two."""
    bits = 64
    while bits < min(MOST_BITS, density * len(tokens)):
        bits *= 2
    row = np.zeros(bits, np.uint8)
    row[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(row, bitorder="little").view(np.uint64)


def folded(sigs: list[np.ndarray]) -> np.ndarray:
    """Signatures brought to the narrowest one's width, by or-ing halves: a matrix."""
    width = min(map(len, sigs))
    return np.stack([np.bitwise_or.reduce(s.reshape(-1, width), axis=0) for s in sigs])


class Tree:
    """Levels of nodes over sets: or-combined bitmaps, ranges of sizes and components, and how many shingles share bits."""

    def __init__(self, n: np.ndarray, sigs: np.ndarray, comp: np.ndarray):
        spare = n - np.bitwise_count(sigs).sum(axis=1, dtype=np.int64)
        self.levels = [(n, n, sigs, comp, comp, spare)]
        while len(self.levels[-1][0]) > FANOUT:
            low, high, bits, least, most, spare = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(spare, at)))

    def open(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes can hold sets that link and are in different components.

        Sets share no more shingles than common bits, and those of one set beyond its own number of bits.
        """
        low, high, bits, least, most, spare = self.levels[level]
        ok = (high[i] * 100 >= percent * low[j]) & (high[j] * 100 >= percent * low[i])
        ok &= (least[i] != most[i]) | (least[j] != most[j]) | (least[i] != least[j])
        at = np.flatnonzero(ok)
        i, j = i[at], j[at]
        common = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64) + np.minimum(spare[i], spare[j])
        common = np.minimum(common, np.minimum(high[i], high[j]))
        ok[at] = common * (100 + percent) >= percent * (low[i] + low[j])
        return ok

    def pairs(self, percent: int):
        """Dual traversal from the top: arrays (i, j), i < j, of the sets that no level rules out."""
        top = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[top][0]))
        stack = [(top, i, j)]
        while stack:
            level, i, j = stack.pop()
            if len(i) > STEP:
                stack += [(level, i[STEP:], j[STEP:])]
                i, j = i[:STEP], j[:STEP]
            if level == 0:
                i, j = i[i < j], j[i < j]
            ok = self.open(level, i, j, percent)
            i, j = i[ok], j[ok]
            if level == 0:
                yield i, j
            elif len(i):
                a, b = (x.ravel() for x in np.broadcast_arrays(i[:, None, None] * FANOUT + np.arange(FANOUT)[:, None], j[:, None, None] * FANOUT + np.arange(FANOUT)))
                fit = (a <= b) & (b < len(self.levels[level - 1][0])) & (a < len(self.levels[level - 1][0]))
                stack.append((level - 1, a[fit], b[fit]))


def group_pairs(group: pd.DataFrame, percent: int):
    """Pairs of nodes of one group (node, n, sig, root, side) that can link; sets of one component lie side by side."""
    root = group["root"].to_numpy()
    _, at, c = np.unique(root, return_inverse=True, return_counts=True)
    order = np.lexsort((group["n"].to_numpy(), np.where(c[at] > 1, at, -1)))
    group = group.iloc[order]
    node, side = group["node"].to_numpy(), group["side"].to_numpy()
    tree = Tree(group["n"].to_numpy(np.int64), folded([np.frombuffer(s, np.uint64) for s in group["sig"]]), at[order])
    for i, j in tree.pairs(percent):
        ok = side[i] + side[j] == 0  # of a pair of blocks, 1 and -1: one of each; of one block, all 0: any two
        yield np.minimum(node[i[ok]], node[j[ok]]), np.maximum(node[i[ok]], node[j[ok]])


def sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, rid, content, set_id, n, keys, sig`` of every row: number, digests of the text and of its set (null for an
    empty one), number of distinct shingles, keys of the set's parts, and its bitmap."""
    import xxhash

    @F.pandas_udf("set_id binary, n long, keys array<long>, sig binary")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        hashes, edges, rows = Hashes(), size_classes(1, percent), []
        for x in texts:
            tokens = grams(x, words, hashes)
            if len(tokens) >= edges[-3]:
                edges = size_classes(len(tokens), percent)
            rows.append((xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None, len(tokens), part_keys(tokens, edges, percent), signature(tokens).tobytes()))
        return pd.DataFrame(rows, columns=["set_id", "n", "keys", "sig"])

    return docs.select("doc_id", content().alias("content"), sketch("text").alias("s")).select("doc_id", F.monotonically_increasing_id().alias("rid"), "content", "s.*")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) of nodes whose sets link, written. Sets are made anew from the texts."""

    @F.pandas_udf("array<long>")
    def hashed(texts: pd.Series) -> pd.Series:
        hashes = Hashes()
        return pd.Series([grams(x, words, hashes).view(np.int64) for x in texts], dtype=object)

    own = Scratch(docs.sparkSession)
    pairs = own.write(pairs.distinct(), "candidates")
    asked = own.write(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "content"), "node"), "asked")
    texts = docs.select(content().alias("content"), "text").join(small(asked), "content").groupBy("node").agg(F.first("text").alias("text"))
    sets = own.write(texts.select("node", hashed("text").alias("tokens")), "sets")
    one, other = (sets.select(F.col("node").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    common = F.size(F.array_intersect("ta", "tb"))
    links = pairs.join(one, "a").join(other, "b").where(common * (100 + percent) >= (F.size("ta") + F.size("tb")) * percent)
    out = scratch.write(links.select("a", "b"), "links")
    own.drop()
    return out


def tree_pairs(live: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) from a signature tree for each group of ``live`` (key, node, n, sig, root, c: rows of the key).

    Groups of over BLOCK sets are dealt out to blocks by hash; then each pair of blocks has a tree, and only pairs of
    one set of each are looked for. A task reads its groups one after the other.
    """
    blocks = F.ceil(F.col("c") / BLOCK)
    rows = live.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "with"), F.greatest("block", "with")
    side = F.when(low == high, 0).when(F.col("block") == low, 1).otherwise(-1)
    rows = rows.select("key", low.alias("one"), high.alias("other"), "node", "n", "sig", "root", side.cast("int").alias("side"))
    group = ["key", "one", "other"]

    def search(batches):
        kept = None
        for pdf in batches:
            pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            ids = pdf[group].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1]) if len(pdf) else np.zeros(1, np.int64)
            kept = pdf.iloc[starts[-1] :]
            for a, b in zip(starts[:-1], starts[1:]):
                for x, y in group_pairs(pdf.iloc[a:b], percent):
                    yield pd.DataFrame({"a": x, "b": y})
        if kept is not None and len(kept):
            for x, y in group_pairs(kept, percent):
                yield pd.DataFrame({"a": x, "b": y})

    return rows.repartition(*group).sortWithinPartitions(*group).mapInPandas(search, "a long, b long")


def set_links(nodes: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of ``nodes``, whose components are those of all links.

    Sets that link have a part in common, so they meet in its key. In each key's group one set, that with the largest
    share of its keys in common with others (the original of edited copies), is compared with all first. Then groups
    with sets of different components are searched by signature trees; exact overlaps decide.
    """
    keys = nodes.select("node", "n", F.size("keys").alias("whole"), F.explode("keys").alias("key"))
    several = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    index = scratch.write(keys.join(several, "key"), "index")
    share = index.groupBy("node").agg((F.count("*") / F.max("whole")).alias("share"))
    index = scratch.write(index.drop("whole").join(small(scratch.write(share, "share")), "node"), "ranked")
    pivots = index.groupBy("key").agg(F.max(F.struct("share", (-F.col("node")).alias("order"), "n", "node")).alias("q"))
    met = index.join(pivots, "key").where("node <> q.node").where((F.least("n", "q.n") * 100) >= F.greatest("n", "q.n") * percent)
    found = verified(met.select(F.least("node", "q.node").alias("a"), F.greatest("node", "q.node").alias("b")), nodes, docs, words, percent, scratch)
    roots = connected_components(found)
    live = index.select("key", "node", "n", "c").join(small(scratch.write(roots, "roots")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    live = scratch.write(live, "live")
    split = live.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    live = live.join(split, "key").join(nodes.select("node", "sig"), "node")
    return found.unionByName(verified(tree_pairs(live, percent), nodes, docs, words, percent, scratch))


def linked_texts(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: components of texts whose shingle sets link.

    A-Z are lower-cased, words are what lies between the ASCII white space; a set holds the distinct shingles of
    ``words`` words, the whole sequence of a text with fewer. Two sets link when 100 times their intersection is
    ``percent`` times their union or more. Rows of equal sets are one node and never paired; those without words (null
    and empty texts too) have an empty set and are linked with nothing. ``component_id`` is the smallest doc_id
    reachable, the row's own included; null if no row of the component has one. Columns other than doc_id and text are
    not read, repeated rows are repeated, an empty table gives an empty table.
    """
    with text_batches(docs.sparkSession):
        return _linked_texts(docs, words, percent)


def _linked_texts(docs: DataFrame, words: int, percent: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(sketches(docs, words, percent), "sketches")
    twins = scratch.write(rows.where("n > 0").groupBy("set_id").agg(F.min("rid").alias("first"), F.count("*").alias("c")).where("c > 1").select("set_id", "first"), "twins")
    named = rows.join(small(twins), "set_id", "left").withColumn("node", F.coalesce("first", "rid"))
    nodes = named.where("node = rid and n > 0").select("node", "content", "n", "keys", "sig")
    roots = scratch.write(connected_components(set_links(nodes, docs, words, percent, scratch)), "roots")
    named = scratch.write(named.select("doc_id", "n", "node").join(small(roots), "node", "left").select("doc_id", "n", F.coalesce("root", "node").alias("root")), "rooted")
    groups = scratch.write(named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")).where("c > 1").drop("c"), "groups")
    out = named.join(small(groups), "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    scratch.drop(named, groups)
    return out


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op13_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w),
        n AS (SELECT s, min(doc_id) AS id FROM s WHERE len(s) > 0 GROUP BY s),
        g AS (SELECT id, len(s) AS k, unnest(s) AS gram FROM n),
        l AS (SELECT x.id AS a, y.id AS b FROM g AS x JOIN g AS y USING (gram) WHERE x.id <> y.id AND 100 * least(x.k, y.k) >= 90 * greatest(x.k, y.k)
              GROUP BY x.id, y.id, x.k, y.k HAVING 100 * count(*) >= 90 * (x.k + y.k - count(*))),
        r AS (SELECT id, id AS seen FROM n UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen),
        c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
        SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM s LEFT JOIN n ON s.s = n.s LEFT JOIN c USING (id)"""
}
