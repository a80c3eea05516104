"""Periodic runs of words: Main and Lorentz's divide and conquer (1984) on interned words, Z-functions at each midpoint."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run has at least so many words, and twice its period.
LEAST = 12
#: Nodes of fewer words are not divided further; what lies in one has a period of less than half of it.
LEAF = 48
RUNS = "array<struct<start:long,length:long,period:long>>"


def interned(words: list[bytes]) -> np.ndarray:
    """Words as numbers: equal words, equal numbers."""
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def zs(w: np.ndarray) -> np.ndarray:
    """The Z-function: for each place the length of the longest common prefix of ``w`` and what starts there (0 at 0).

    Only places with the first symbol are visited, all others are 0.
    """
    n, out = len(w), np.zeros(len(w), np.int64)
    left = right = 0
    s, z = w.tolist(), {}
    for i in (np.flatnonzero(w[1:] == w[0]) + 1).tolist():
        k = min(right - i, z.get(i - left, 0)) if i < right else 0
        if i + k >= right:  # else the box around it decides
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    if z:
        out[np.fromiter(z, np.int64, len(z))] = np.fromiter(z.values(), np.int64, len(z))
    return out


def crossing(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the repetitions that cross the place ``m``, two periods long at least, maximal within ``s``.

    For each period p: how far the words before ``m`` equal those p later, and how far the words from ``m`` on equal
    those p further (the root of the repetition stands right of ``m``), or the same to the left.
    """
    u, v = s[:m], s[m:]
    end = np.array([-1], np.int64)
    forth = zs(np.concatenate([v, end, u, v]))  # common prefixes with v: of v's own suffixes, then of all of s's
    back = zs(np.concatenate([u[::-1], end, v[::-1], u[::-1]]))  # the same mirrored: common suffixes with u
    p = np.arange(1, len(v) + 1)
    more = np.append(forth[1 : len(v)], 0)
    less = back[m + 1 + len(v) - p]  # of u and s[: m + p]
    right = less + more >= p
    q = np.arange(1, m + 1)
    before = np.append(back[1:m], 0)
    after = forth[len(v) + 1 + m - q]  # of v and s[m - q :]
    left = before + after >= q
    return (
        np.concatenate([(m - less)[right], (m - q - before)[left]]),
        np.concatenate([(m + p + more)[right], (m + after)[left]]),
        np.concatenate([p[right], q[left]]),
    )


def segments(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The stretches that runs can lie in: of words within a group of ``least // 2`` words that occurs again.

    In a run the words before its last period are those one period later, and these are half of ``least`` at the
    least; so all of a run's words are in such groups. Groups are told apart by a hash: equal ones never differ.
    """
    k = least // 2
    n = len(ids)
    if n < least:
        return []
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[i : n - k + 1 + i].view(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    line = np.sort(h)
    if not (line[1:] == line[:-1]).any():
        return []
    twice = np.flatnonzero(pd.Series(h).duplicated(keep=False).to_numpy())
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + k, -1)
    inside = np.concatenate([[0], (np.cumsum(step)[:n] > 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(inside))
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least]


def shifted(s: np.ndarray, periods: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the stretches of ``s`` whose words equal those a period later, for each of ``periods``."""
    found = []
    for p in periods:
        same = np.concatenate([[False], s[p:] == s[:-p], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        edges = edges[edges[:, 1] - edges[:, 0] >= p]
        found.append(np.stack([edges[:, 0], edges[:, 1] + p, np.full(len(edges), p)], axis=1))
    a, b, p = np.concatenate(found).T
    return a, b, p


def runs(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period.

    A run lies whole in the node of the division whose midpoint it crosses first. A repetition that meets its node's
    border and goes on beyond is a piece of one found there, so it is left out, which comes to extending it and
    dropping what is found twice. Of one stretch the smallest period stays. Nodes under LEAF words are not divided:
    the short periods of what lies in them are read off by comparing a segment with itself, a period later.
    """
    found = []
    for lo, hi in segments(ids, least):
        a, b, p = shifted(ids[lo:hi], range(1, min(LEAF, hi - lo) // 2 + 1))
        keep = b - a >= least
        found.append(np.stack([a + lo, b - a, p], axis=1)[keep])
        stack = [(lo, hi)] if hi - lo > LEAF else []
        while stack:
            l, r = stack.pop()
            m = (l + r) // 2
            a, b, p = crossing(ids[l:r], m - l)
            a, b = a + l, b + l
            keep = b - a >= np.maximum(least, 2 * p)
            a, b, p = a[keep], b[keep], p[keep]
            if len(a):
                whole = ((a == 0) | (ids[a - 1] != ids[np.minimum(a - 1 + p, len(ids) - 1)])) & ((b == len(ids)) | (ids[np.minimum(b, len(ids) - 1)] != ids[b - p]))
                found.append(np.stack([a, b - a, p], axis=1)[whole])
            stack += [x for x in ((l, m), (m, r)) if x[1] - x[0] > LEAF]
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words without those that repeat: of each run only the first period stays; joined by one space."""
    if not len(found):
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 0] + found[:, 1], -1)
    gone = np.cumsum(step)[:-1] > 0
    return b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, text="text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``runs``, an array of (start, length, period) by start, then period, and the ``collapsed`` text.

    Words are what lies between the ASCII white space. A run is a stretch of words with smallest period ``period``, of
    ``least`` words and two periods at least, that no neighbouring word extends. ``collapsed`` has the words that are
    in no run behind its first period. Every row is judged on its own: null and empty texts have no runs and collapse
    to an empty one, repeated rows are repeated, an empty table gives an empty table. Other columns stay as they are,
    but for columns named runs or collapsed, which are replaced.
    """

    @F.pandas_udf(f"runs {RUNS}, collapsed string")
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            words = _bytes(x).split()
            found = runs(interned(words), least)
            rows.append(([{"start": a, "length": n, "period": p} for a, n, p in found.tolist()], collapsed(words, found).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=["runs", "collapsed"])

    judged = docs.withColumn("runs", judge(text))
    return judged.withColumns({"collapsed": F.col("runs.collapsed"), "runs": F.col("runs.runs")})


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document as the query takes them: of one in ten, those from a place on repeat a period."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, of texts with periods put in (see looped); a null doc_id puts none in."""

    @F.pandas_udf("string")
    def rebuilt(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(looped(None if pd.isna(i) else int(i), _bytes(x).split())).decode("utf-8", "surrogatepass") for i, x in zip(ids, texts)], dtype=object)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), "text")
    found = periodic_runs(docs.select("doc_id", rebuilt(F.col("doc_id").cast("string"), "text").alias("text"))).drop("text")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("best.least")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.expr("(best.least * -1000) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: CRC-32 of the decimal doc_id, bit by bit; words as in the contract; equal groups of six words give the places and
#: distances, gaps and islands the stretches.
SQL = {
    "op11_periodic_runs": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor(4294967295, list_reduce(
                       list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
                       lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, zero: xor(x >> 1, 3988292384 * (x & 1))))) AS h FROM documents),
        e AS (SELECT doc_id, w, len(w)::BIGINT AS n, h % 10 = 0 AND len(w) > 0 AS looped, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS k FROM d),
        f AS (SELECT doc_id, n, CASE WHEN looped THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // k) + 1] END) ELSE w END AS w FROM e),
        g AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 6], ' ') AS six FROM (SELECT doc_id, n, w, unnest(range(n - 5)) AS i FROM f WHERE n >= 12)),
        p AS (SELECT doc_id, x.i, y.i - x.i AS q FROM g AS x JOIN g AS y USING (doc_id, six) WHERE y.i > x.i AND 2 * (y.i - x.i) <= x.n),
        o AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p),
        r AS (SELECT doc_id, q, min(i) AS s, count(*) + 5 + q AS l FROM o GROUP BY doc_id, q, island HAVING count(*) + 5 + q >= greatest(12, 2 * q)),
        u AS (SELECT doc_id, s, l, min(q) AS q FROM r GROUP BY doc_id, s, l),
        b AS (SELECT doc_id, count(*) AS n_runs, arg_min({'start': s, 'length': l, 'period': q}, (-l, s, q)) AS best, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS line FROM u GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM u),
        kept AS (SELECT doc_id, coalesce(string_agg(word, ' ' ORDER BY i), '') AS body FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM f) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
               sha256(coalesce(line, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
        FROM f LEFT JOIN b USING (doc_id) LEFT JOIN kept USING (doc_id)"""
}
