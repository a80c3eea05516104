"""Periodic runs against a plain scan of every period, on random words and on a table with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from panelforge.llm import runs


def plain(words, least=12):
    """Every maximal stretch of every period; of one stretch the smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_every_period():
    rng = random.Random(3)
    for _ in range(800):
        n, v = rng.randint(0, rng.choice([30, 90, 260])), rng.choice([1, 2, 3, 5, 20])
        s = [rng.randrange(v) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, n)
            s = s[:a] + [s[a + (i - a) % p] for i in range(a, n)]
        s = s + s if rng.random() < 0.3 else s
        assert list(map(tuple, runs.runs(np.array(s, np.int64)).tolist())) == plain(s), s
    least = [0, 1] * 3
    assert list(map(tuple, runs.runs(np.array(least, np.int64), 4).tolist())) == plain(least, 4) == [(0, 6, 2)]


def test_long_periods_and_very_long_texts():
    rng = np.random.default_rng(4)
    part = rng.integers(0, 1000, 4000)
    s = np.concatenate([rng.integers(0, 1000, 500), part, part, part[:100], [1001]])
    assert (500, 8100, 4000) in set(map(tuple, runs.runs(s).tolist()))
    assert runs.runs(np.zeros(50_000, np.int64)).tolist() == [[0, 50_000, 1]]


TEXTS = [None, "", " \t\n", "a", "a " * 12, "A a " * 9, "x y z " * 5 + "w", "q " + "lo  li\n" * 40 + "end", "été 漢 " * 7, "a b c d e f g h i j k l", "a " * 11]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 300))) for _ in range(80)] + [" ".join(str(i % 97) for i in range(20_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, TEXTS[4]), (None, "b " * 30), (None, None)]
    path = str(tmp_path_factory.mktemp("runs"))
    spark.createDataFrame([(i, t, 7, "clash", "clash") for i, t in rows], "doc_id long, text string, runs int, best string, collapsed string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return rows, path


def test_op11(spark, odd):
    rows, path = odd
    want = []
    for i, t in rows:
        words = (t or "").split()
        n = len(words)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        found = plain(words) if n < 5000 else list(map(tuple, runs.runs(runs.interned([w.encode() for w in words])).tolist()))
        gone = {k for a, m, q in found for k in range(a + q, a + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else [None] * 4), sha("".join(f"{a},{m},{q}\n" for a, m, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    got = runs.op11_periodic_runs(spark, path).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_operator_keeps_columns_and_takes_empty_tables(spark, odd):
    docs = spark.read.parquet(f"{odd[1]}/documents.parquet")
    out = runs.periodic_runs(docs)
    assert out.columns == docs.columns and dict(out.dtypes)["collapsed"] == "string"
    row = out.where("text like 'q %'").first()
    assert row.collapsed == "q lo li end" and [tuple(r) for r in row.runs] == [(1, 80, 2)]
    assert runs.periodic_runs(docs.limit(0)).count() == 0
