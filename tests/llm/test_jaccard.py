"""The n-gram join against all pairs: edited copies, stars, chains, templates, small and odd texts, blocks of one group."""

import random

import numpy as np
import pytest

from panelforge.llm import jaccard
from panelforge.llm.jaccard import Hashes, Tree, folded, grams, part_keys, signature, size_classes

SCHEMA = "doc_id long, text string, n int, node string, content string"


def shingles(text, words=3):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words=3, percent=90):
    sets = [shingles(t, words) for _, t in rows]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= percent * len(x | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, (d, _) in zip(group, rows):
        least[g] = min((v for v in (least.get(g), d) if v is not None), default=None)
    return sorted(((d, len(s), least[g]) for (d, _), s, g in zip(rows, sets, group)), key=str)


def corpus(rng):
    word = lambda: f"w{rng.randrange(3000)}"
    line = lambda n: [word() for _ in range(n)]
    texts = []
    for _ in range(25):  # edited copies: some within the similarity, some just beyond
        base = line(rng.choice([5, 9, 11, 12, 30, 60, 130, 400]))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy + line(rng.choice([0, 0, 1, len(copy) // 12])))
    hub = line(200)
    for i in range(40):  # a star: copies alike to the first, not to each other
        copy = list(hub)
        for k in rng.sample(range(0, 200, 10), 3):
            copy[k] = word()
        texts.append(copy)
    texts.insert(len(texts) - 20, hub)
    chain = line(100)
    for i in range(15):  # each like the next
        texts.append(list(chain))
        chain[i * 6] = word()
    passage = line(80)
    texts += [line(rng.randint(5, 60)) + passage for _ in range(30)] + [["x"], ["x"], ["X", "y"], ["x", "y"], ["x", "y", "z"], [], ["a"] * 500, ["a"] * 3]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(t)) for i, t in enumerate(texts)]
    return rows + [(None, rows[3][1]), (None, None), (900, None), (3, rows[3][1]), (901, "é 漢 " * 40), (902, " ".join(line(30_000)))]


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", "clash") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("block", [2048, 7])
def test_components_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(random.Random(11))
    assert sorted(map(tuple, jaccard.linked_texts(table(spark, rows)).collect()), key=str) == brute(rows)
    assert jaccard.linked_texts(table(spark, rows).limit(0)).count() == 0


def test_other_similarities_and_words(spark):
    rows = corpus(random.Random(12))[:150]
    assert sorted(map(tuple, jaccard.linked_texts(table(spark, rows), 5, 80).collect()), key=str) == brute(rows, 5, 80)


def test_sets_that_link_share_a_part():
    rng = np.random.default_rng(13)
    for _ in range(3000):
        percent = int(rng.choice([90, 80, 95]))
        n = int(rng.integers(1, rng.choice([12, 40, 300])))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        gone, new = rng.integers(0, 1 + n // 8), rng.integers(0, 1 + n // 8)
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64) * np.uint64(2)]))
        both = len(np.intersect1d(x, y))
        edges = size_classes(max(len(x), len(y), 1), percent)
        if len(y) and 100 * both >= percent * (len(x) + len(y) - both) and both < max(len(x), len(y)):
            assert set(part_keys(x, edges, percent)) & set(part_keys(y, edges, percent))


def test_trees_lose_no_pair():
    rng = random.Random(14)
    hashes = Hashes()
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    sets = []
    for _ in range(700):
        copy = list(base) if rng.random() < 0.5 else [f"v{rng.randrange(900)}" for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(5000)}"
        sets.append(grams(" ".join(copy), 3, hashes))
    comp = np.array([rng.choice([0, 1, 2, 1000 + i]) for i in range(len(sets))])
    order = np.argsort(comp, kind="stable")
    sets, comp = [sets[i] for i in order], comp[order]
    tree = Tree(np.array([len(s) for s in sets]), folded([signature(s) for s in sets]), comp)
    assert len(tree.levels) == 3
    got = {(a, b) for i, j in tree.pairs(90) for a, b in zip(i.tolist(), j.tolist())}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if comp[i] != comp[j] and 100 * (k := len(np.intersect1d(sets[i], sets[j], True))) >= 90 * (len(sets[i]) + len(sets[j]) - k)}
    assert want <= got and len(want) > 1000 and all(comp[i] != comp[j] for i, j in got)
    assert len(got) < 0.7 * len(sets) * (len(sets) - 1) / 2
