"""The prefix tree of conversations against nested dictionaries, on tables with odd rows."""

import hashlib
import random
import zlib

from panelforge.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, h string, owner int, n string"


def ordered(rows):
    """conv_id: its turns (role, text), ordered as the operator says; ids of null left out."""
    out = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def brute(convs):
    """Rows of the tree of {conv_id: turns}."""
    members, ends = {}, {}
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {k: [] for k in members}
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * len(k[-1][1].split() if k else []) + sum(saved[x] for x in kids[k])
    sha = lambda k: hashlib.sha256(",".join(map(str, ends.get(k, []))).encode()).hexdigest()
    return sorted((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], sha(k)) for k in members)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA).repartition(3)


def grown(rng, n=60):
    """Conversations that share first turns in many ways: branches, equal ones, a tower, odd values."""
    rows, logs = [], []
    for c in range(n):
        turns = list(rng.choice(logs)[: rng.randint(0, 9)]) if logs and rng.random() < 0.8 else []
        turns += [(rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None, "long text of words " * 3])) for _ in range(rng.randint(0, 4))]
        turns = turns or [("user", "hello")]
        logs.append(turns)
        rows += [(c * 3 if c % 5 else c * 3 + 1, t, *x) for t, x in enumerate(turns)]
    rows += [(1000 + c, t, "user", f"step {t}") for c in range(20) for t in range(20 - c)]  # each the next one's continuation
    rows += [(2000 + c, t, "user", f"step {t}" if t < c else f"own {c}") for c in range(20) for t in range(c + 1)]
    rows += [(3000, None, "user", "b"), (3000, None, None, None), (3000, 5, "user", "a"), (3000, 5, "user", "a"), (None, 1, "user", "gone"), (3001, -2, None, None)]
    return rows


def test_prefix_trie(spark):
    rows = grown(random.Random(6))
    want = brute(ordered(rows))
    assert sorted(map(tuple, trie.prefix_trie(table(spark, rows)).collect()), key=str) == sorted(want, key=str)
    none = table(spark, rows).limit(0)
    assert trie.prefix_trie(none).count() == 0
    alone = trie.prefix_trie(none, spark.createDataFrame([(5,), (3,), (None,)], "conv_id long")).collect()
    assert [tuple(r)[:7] for r in alone] == [(3, 0, None, 2, 0, 1, 0)] and alone[0].ends_sha256 == hashlib.sha256(b"3,5").hexdigest()


def test_long_conversations_and_many_equal_ones(spark):
    rng = random.Random(7)
    long = [("user", rng.choice(["x", "y y"])) for _ in range(1400)]
    convs = {7: long, 8: long[:900] + [("bot", "other")], 9: long[:513], 4: long[:1023], 10: long[:1399] + [("bot", "z")]}
    convs |= {100_000 * i: [("user", "hi"), ("bot", "ho")] for i in range(1, 60)}
    rows = [(c, t, *x) for c, turns in convs.items() for t, x in enumerate(turns)]
    assert sorted(map(tuple, trie.prefix_trie(table(spark, rows)).collect()), key=str) == sorted(brute(convs), key=str)


def test_op12(spark, tmp_path):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "bot"]), f"{rng.choice('ab')} {t}") for c in range(90) if c != 40 for t in range(rng.randint(1, 5))]
    rows += [(r[0] + 10**9, *r[1:]) for r in rows[:9]] + [(None, 1, "user", "x"), (3, None, None, "first")]
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    logs, built = ordered(rows), {}
    for c, turns in logs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = logs.get(c - c % 20, [])[:h] + turns[h:]
    assert any(not t for t in built.values())
    assert sorted(map(tuple, trie.op12_prefix_trie(spark, str(tmp_path)).collect()), key=str) == sorted(brute(built), key=str)
