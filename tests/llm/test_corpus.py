"""Corpus operators against brute-force versions, on a table with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelforge.llm import chat, decontaminate, exact, language, pieces, simhash, similar, token_files, tokens, toxicity, urls
from panelforge.llm.common import connected_components, shared_dir

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "été", "漢字", "x1"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp long, content string, rid int"


def make(n=60):
    rng = random.Random(5)
    line = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", ",", "."]) for _ in range(k))
    texts = [line(rng.randint(1, 80)) for _ in range(n)]
    texts += [texts[0], texts[0].upper(), None, "", "   \n\t ", "one", "one two", line(30_000), "😀" * 50, texts[1] + " tail", "1 2 3"]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", 7, "clash", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def components(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(240, pairs)
    assert got == {i: want[i] for p in pairs for i in p if p[0] != p[1]}


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_links_are_complete(spark, radius):
    rng = np.random.default_rng(2)
    centre = rng.integers(-(2**62), 2**62, 6)
    fps = sorted({int(np.int64(c) ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 64, k).astype(np.int64))) if k else int(c) for c in centre for k in range(7) for _ in range(4)} | {0, -1, 1})
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
    assert got == want


def brute_fp(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op1(docs, rows, none):
    out = simhash.near_duplicates(docs).collect()
    fps = [brute_fp(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3]
    root = components(len(rows), pairs)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, root)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out), key=str) == want
    assert simhash.near_duplicates(none).count() == 0


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def test_similar_groups(spark, docs, rows, none):
    """Against all pairs: the table of odd cases, chains of edited copies, and a large group of them."""
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(900)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([40, 120, 400]))] for _ in range(12)]
    more = []
    for k, words in enumerate(base):
        for n in range(60 if k == 0 else 4):
            own = words.copy()
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            more.append((1000 * (k + 1) + n, " ".join(own).title() if n % 2 else "  ".join(own)))
    for table, given in ((docs, rows), (spark.createDataFrame(more, "doc_id long, text string"), more)):
        sets = [brute_shingles(t) for _, t in given]
        root = components(len(given), [(a, b) for a in range(len(given)) for b in range(a) if alike(sets[a], sets[b])])
        least = {}
        for (i, _), r in zip(given, root):
            if i is not None:
                least[r] = min(i, least.get(r, i))
        got = sorted(((r.doc_id, r.component_id) for r in similar.similar_groups(table).collect()), key=str)
        assert got == sorted(((i, least.get(r)) for (i, _), r in zip(given, root)), key=str)
    assert similar.similar_groups(none).count() == 0


def test_similar_groups_meet(spark):
    """Pairs alone in their keys: texts of similarity 0.8 and more are compared, whatever the edit."""
    rng = random.Random(12)
    line = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    pairs = []
    for _ in range(20):
        text, often = line(300), line(10)
        pairs.append((text + often, text + often * 60))
        text = line(204)
        pairs.append((text, text + line(50)))
        text = line(200)
        pairs.append((text + line(20), line(20) + text))
    rows = [(2 * k + n, " ".join(t)) for k, pair in enumerate(pairs) for n, t in enumerate(pair)]
    assert all(alike(brute_shingles(a[1]), brute_shingles(b[1])) for a, b in zip(rows[::2], rows[1::2]))
    got = {r.doc_id: r.component_id for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_similar_groups_stars(spark):
    """Edited copies that are similar to their original only, which has any id, against all pairs."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, texts = [word() for _ in range(12)], []
    for size, edits, copies in ((100, 2, 80), (100, 2, 30), (200, 4, 60)):
        original = passage + [word() for _ in range(size - 12)]
        texts.append(original)
        for _ in range(copies):
            own = original.copy()
            for at in rng.sample(range(size), edits):
                own[at] = word()
            texts.append(own)
    rows = list(zip(rng.sample(range(10**6), len(texts)), map(" ".join, texts)))
    sets = [brute_shingles(t) for _, t in rows]
    root = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])])
    least = {r: min(i for (i, _), x in zip(rows, root) if x == r) for r in root}
    got = {r.doc_id: r.component_id for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: least[r] for (i, _), r in zip(rows, root)}


def test_op2(spark, docs, rows, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, cache = Tokenizer.from_file(path), f"{shared_dir(spark)}/cache-{random.random()}"
    for _ in range(2):
        out = tokens.count_tokens(docs, path, cache)
        got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out.collect()), key=str)
        assert got == sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows), key=str)
    assert spark.read.parquet(cache).count() == len({x or "" for _, x in rows})  # the second run found all
    assert tokens.count_tokens(none, path, cache).count() == 0


def test_op3(spark):
    cases = [(1, "http://a.NET/x", "a.net", "/x", "net/", "block"), (2, "https://b.example.net/en/q?x#y", "b.example.net", "/en/q", "example.net/en/", "allow"), (3, "http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), (4, "http://x.org/fr/1", "x.org", "/fr/1", "org/fr/", "allow"), (5, "http://notexample.com/de/1", "notexample.com", "/de/1", None, None), (6, None, "", "", None, None), (7, "no scheme", "", "", None, None), (8, "http://spam-farm.example.com/en/1", "spam-farm.example.com", "/en/1", None, "block"), (9, "http://a.net", "a.net", "", None, None), (10, "http://therin.example.com/en/2", "therin.example.com", "/en/2", None, "allow"), (8, "", "", "", None, None)]
    got = urls.filter_urls(spark.createDataFrame([(c[0], c[1], "z") for c in cases], "page_id long, url string, rule string")).collect()
    assert len(got) == len(cases)
    by = {(r.page_id, r.host): r for r in got}
    for page, _, host, path, rule, verdict in cases:
        r = by[page, host]
        assert (r.path, r.rule) == (path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_op3_odd_tables(spark):
    """Empty table, very long urls, repeated rows, clashing columns; n-grams and the decision against plain loops."""
    schema = "page_id long, url string, grams string, features string, p double, by_rule string"
    assert urls.filter_urls(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "http://x.example.com/" + "a/" * 20_000, "g", "f", 0.5, "b")] + [(2, "http://spam-farm.example.com/en/1", "g", "f", 0.5, "b")] * 2
    got = urls.filter_urls(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.page_id for r in got) == [1, 2, 2] and all(r.verdict == "block" for r in got if r.page_id == 2)
    model = urls.train(spark)
    hosts = [("therin.example.com", "/en/2"), ("best-casino.example.org", "/slots"), ("", ""), ("a", "/")]
    table = urls.with_grams(spark.createDataFrame(hosts, "host string, path string"), F.col("host"), F.col("path"))
    for r in model.transform(urls.hashed(table)).collect():
        plain = [m + t[i : i + n] for m, t in (("h", f"^{r.host}$"), ("p", f"^{r.path}$")) for n in urls.GRAMS for i in range(len(t) - n + 1)]
        assert r.grams == plain
        score = model.intercept + sum(model.coefficients[int(i)] * v for i, v in zip(r.features.indices, r.features.values))
        assert (r.p == 1) == (score > 0)


def test_op4_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string, h string")).count() == 0


def test_op4(spark):
    logs = {1: "ab", 2: "abc", 3: "abcd", 4: "abx", 5: "abx", 6: "b", 7: "", 8: "a" * 1500, 9: "a" * 700}
    turns = [(c, 10 * k, "user" if k % 2 == 0 else None, x, "extra") for c, s in logs.items() for k, x in enumerate(s)] + [(None, None, "user", None, "")]
    got = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, h string")).collect()
    full = {c: [("user" if k % 2 == 0 else "", x) for k, x in enumerate(s)] for c, s in logs.items() if s} | {None: [("user", "")]}
    want = {}
    for c, t in full.items():
        same = [o for o, u in full.items() if u == t]
        if not any(len(u) > len(t) and u[: len(t)] == t for u in full.values()) and c == min((o for o in same if o is not None), default=None):
            want[c] = (len(t), len(same), "\n".join(f"<|{r}|>\n{x}" for r, x in t))
    assert {r.conv_id: (r.n_turns, r.n_equal, r.rendered) for r in got} == want


def test_op5(spark, docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = f"{shared_dir(spark)}/files-{random.random()}"
    token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), out)
    got = token_files.read_token_files(spark, out).orderBy("start").collect()
    ids = {x: [*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x in rows}
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=str) == sorted(((i, ids[x]) for i, x in rows), key=str)
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))


def test_op5_empty(spark, none):
    out = f"{shared_dir(spark)}/files-{random.random()}"
    token_files.write_token_files(none, public_tokenizers.path("word_bpe_49k.json"), out)
    assert token_files.read_token_files(spark, out).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_equal_the_library(name):
    """Word by word as the whole text; a tokenizer of another kind takes whole texts; long chunks aren't remembered."""
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path(name), random.Random(14)
    t, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
    assert encoder.divisible == (name == "word_bpe_49k.json")
    parts = ["don't", "I'LL", "é", "É", "İ", "ſ", "ß", "\xa0", "\x1c", "\x85", " ", "\n", "<|endoftext|>", "<|", "A", "b", "3", "12", "...", "'s", "'", "œ", "漢", "e\u0301", "'T", "\u0307", "_", "\xad", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["ab,1" * 50_000, "x" * 5_000_000 if encoder.divisible else "x"]
    for at in range(0, len(texts), 500):
        got = encoder.encode(texts[at : at + 500])
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts[at : at + 500]]
    assert max(map(len, encoder.young), default=0) <= token_files.LONG


def test_codes_round_trip():
    ranks = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 5], "<u4")
    rng = random.Random(16)
    for _ in range(50):
        n = np.array([rng.randint(0, len(ranks)) for _ in range(rng.randint(0, 6))], np.int64)
        some = np.concatenate([ranks[:0], *(ranks[:k] for k in n)])
        coded = token_files.pack(some, n)
        assert [len(c) for c, _ in coded] == [-(-k // 4) for k in n.tolist()]
        assert token_files.unpack([c for c, _ in coded], [d for _, d in coded], n).tolist() == some.tolist()
        for at, k in enumerate(n.tolist()):
            assert token_files.unpack([coded[at][0]], [coded[at][1]], n[at : at + 1]).tolist() == ranks[:k].tolist()
    assert [(s.start, s.stop) for s in token_files.parts(np.array([1, 1, 5, 9, 1, 1]), 3)] == [(0, 2), (2, 3), (3, 4), (4, 6)]


def test_op6(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    item = [rng.choice(vocab) for _ in range(30)]
    pad = lambda k: [rng.choice(vocab) for _ in range(k)]
    near = item.copy()
    near[1] = "changed"
    far = [w if i % 4 else "other" for i, w in enumerate(item)]
    texts = [" ".join(pad(50) + item + pad(50)), "... ".join(pad(20) + [w.upper() for w in item]), " ".join(near + pad(9)), " ".join(pad(40) + far), " ".join(pad(200)), None, "", "tiny item", " ".join(item[:20])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, size int")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "Tiny, item!"), (3, None), (None, "x y"), (4, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert [got[i].contaminated for i in range(9)] == [True, True, True, False, False, False, False, True, False]
    assert (got[0].item_id, got[0].n_items, got[0].similarity) == (1, 2, 1.0) and got[7].item_id == 2
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.limit(0)).collect())


def test_op6_all_windows(spark):
    """Against every window of every text: quotes with words changed, inserted and left out, items of 1 to 60 words."""
    rng = random.Random(15)
    vocab = [f"w{i}" for i in range(2000)]
    pad = lambda k: [rng.choice(vocab) for _ in range(k)]
    items = [(k, pad(size)) for k, size in enumerate([1, 2, 4, 5, 6, 9, 12, 20, 33, 47, 60])] + [(11, ["a", "b"] * 12)]
    items += [(12, ["r"] * 40), (13, ["a", "b", "c", "a", "b"] * 6 + pad(12)), (14, pad(8) + ["r"] * 10 + pad(8))]
    texts = [[], ["w1"], ["r"] * 39, ["r"] * 30, ["r"] * 700 + pad(50), ["a", "b", "c", "a", "b"] * 40]
    for _, words in items:
        for n in range(12):
            own = words.copy()
            for _ in range(rng.randint(0, 1 + len(words) // 18)):
                at, kind = rng.randrange(len(own) + 1), rng.choice("cid")
                own[at : at + (kind != "i")] = [] if kind == "d" else pad(rng.randint(1, 3))
            texts.append(pad(rng.randint(0, 30)) + own + pad(rng.randint(0, 30)))
    texts.append(pad(5) + items[8][1] + pad(3000) + items[9][1])
    grams = lambda w: Counter([" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [])
    want = {}
    for i, text in enumerate(texts):
        for item, words in items:
            own, best = grams(words), 0
            for at in range(max(1, len(text) - len(words) + 1)):
                other = grams(text[at : at + len(words)])
                best = max(best, (own & other).total() / (own | other).total())
            if best >= 0.8 - 1e-9:
                want[i, item] = best
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] * 2 + [(None, " ".join(texts[-1])), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] * 2, "item_id long, text string")
    rows = decontaminate.contamination(docs, bench).collect()
    assert len(rows) == 2 * len(texts) + 2
    for r in rows:
        i = len(texts) - 1 if r.doc_id is None and r.contaminated else r.doc_id
        own = {k: v for (d, k), v in want.items() if d == i}
        assert (i, r.contaminated, r.n_items) == (i, bool(own), len(own)), own
        if own:
            assert abs(r.similarity - max(own.values())) < 1e-9 and own[r.item_id] > max(own.values()) - 1e-9


def test_op6_one_word(spark):
    """A word repeated 20,000 times against items that repeat it: places are rows, not places by places."""
    items = spark.createDataFrame([(1, "x " * 200), (2, "x " * 60 + "y " * 60), (3, "x " * 3)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 20_000), (2, "z " + "x " * 58 + "y " * 20_000), (3, "y " * 20_000)], "doc_id long, text string")
    known = decontaminate.counted(shown := decontaminate.shingled(items.select("item_id", decontaminate.words(F.col("text")).alias("w"))).select(F.col("item_id").alias("ref"), F.size("w").alias("size"), "grams"))
    met = decontaminate.occurrences(docs, shown, known)
    assert met.agg(F.sum(F.size("at"))).first()[0] < 130_000  # each place once for runs of five words and once for those of three
    starts = decontaminate.best_windows(met, known, 0.8).collect()
    # 60 of x and 60 of y: windows of the second text share 114 of 116 shingles with or without z
    assert sorted((r.ref, r.start) for r in starts) == [(1, 0), (2, 0), (3, 0), (3, 1)]
    got = {r.doc_id: (r.n_items, r.item_id, r.similarity) for r in decontaminate.contamination(docs, items).collect()}
    assert got[1] == (2, 1, 1.0) and got[2][:2] == (2, 3) and got[3] == (0, None, 0.0)


def test_blocks_find_all_within_radius():
    rng = random.Random(4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        assert any((a >> lo) & mask == (b >> lo) & mask for lo, mask in decontaminate.blocks(decontaminate.RADIUS))


def test_op7(spark, none):
    rng = random.Random(6)
    text = lambda ws: " ".join(rng.choice(ws) for _ in range(40))
    kinds = {"en": ["the", "thing", "with", "other", "when"], "de": ["schön", "straße", "auch", "nicht", "zwischen"]}
    rows = [(i, text(kinds[k]), k) for i, k in enumerate(["en", "de"] * 40)] + [(100, None, "en"), (101, "123 ...", "de"), (102, text(kinds["en"]) + " " + text(kinds["de"]), None), (None, text(kinds["de"]), None), (103, "", None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = language.train(docs.where(language.learnable()))
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:80]) and got[None].lang_pred == "de"
    assert all((got[i].lang_pred, got[i].score) == ("und", 0) for i in (100, 101, 103))
    assert 0.3 < got[102].score < 0.7
    assert language.identify(none, language.train(none)).count() == 0
    flags = {r.doc_id: r.l for r in docs.select("doc_id", language.learnable().alias("l")).collect() if r.doc_id is not None}
    assert all(f == (zlib.crc32(str(i).encode()) % 4 != 2) for i, f in flags.items())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_levenshtein_automaton():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(3, 8)))
    terms = {word(): 1.0 for _ in range(40)}
    lexicon = toxicity.Lexicon(terms)
    for _ in range(500):
        w = word()
        want = min(((edits(w, t), t) for t in terms if len(t) >= toxicity.FUZZY_LENGTH and edits(w, t) <= toxicity.EDITS), default=(0, None))[1]
        assert lexicon.near(w) == want


def test_op8(spark):
    rng = random.Random(8)
    say = lambda *bad: " ".join([rng.choice(WORDS) for _ in range(20)] + list(bad))
    rows = [(i, say("blockhead") if i % 3 == 0 else say()) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon, weights = toxicity.train(docs, labels)
    more = spark.createDataFrame([(1, say("blockhead")), (2, say("blokhead")), (3, say()), (4, None), (5, ""), (6, say() + ' he said "blockhead" ' + say())], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(more, lexicon, weights).collect()}
    assert "blockhead" in lexicon.terms and got[1] > 0.3 and max(got[3], got[4], got[5]) < 0.3 and got[2] > got[3]
    plain, quote = lexicon.features(say("blockhead")), lexicon.features('a "b blockhead" said')
    assert plain[2] == 0 < quote[2] and quote[0] < plain[0]
    empty = docs.limit(0)
    assert toxicity.score(empty, *toxicity.train(empty, labels.limit(0))).count() == 0


def test_op8_odd_tables(spark):
    """Other labels, repeated rows and ids, clashing columns, very long texts; the lexicon against a plain count."""
    import math

    rng = random.Random(18)
    say = lambda *bad: " ".join([rng.choice(WORDS) for _ in range(20)] + list(bad))
    rows = [(i, say("blockhead", "numskull") if i % 4 == 0 else say()) for i in range(200)]
    docs = spark.createDataFrame([(*r, 0.5, "w", 3) for r in rows * 2 + [(None, None)]], "doc_id long, text string, score double, word string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(5, 7), (6, -1)], "doc_id long, toxic int")
    lexicon, weights = toxicity.train(docs, labels)
    n = {True: Counter(w for i, t in rows for w in set(t.lower().split()) if i % 4 == 0), False: Counter(w for i, t in rows for w in set(t.lower().split()) if i % 4)}
    odds = {w: math.log((n[True][w] + 0.5) / 51) - math.log((n[False][w] + 0.5) / 151) for w in n[True]}
    want = {w: o for w, o in odds.items() if n[True][w] >= toxicity.LEAST_DOCS and o >= toxicity.LEAST_ODDS}
    assert set(lexicon.terms) == set(want) == {"blockhead", "numskull"} and all(abs(lexicon.terms[w] - o) < 1e-9 for w, o in want.items())
    long = spark.createDataFrame([(1, say() * 20_000), (2, say("blockhead")), (2, say("blockhead")), (3, "x" * 1_000_000)], "doc_id long, text string")
    got = toxicity.score(long, lexicon, weights).collect()
    assert len(got) == 4 and [r.score > 0.3 for r in sorted(got)] == [False, True, True, False]
    assert toxicity.score(docs, lexicon, weights).columns == ["doc_id", "score"]


@pytest.mark.parametrize("block", [4, 4096])
def test_op9(docs, rows, none, block):
    norm = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    got = exact.exact_duplicates(docs.limit(1000) if block == 4096 else docs.where("length(coalesce(text, '')) < 2000"), block).collect()
    rows = rows if block == 4096 else [r for r in rows if len(r[1] or "") < 2000]
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((str(i), str(max((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact.exact_duplicates(none, block).count() == 0


def test_op10(docs, rows, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = [*sp.encode(t or ""), sp.eos_id()]
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted(map(tuple, pieces.round_trip(docs, path).collect()), key=str) == sorted(want, key=str)
    back = pieces.decoded(pieces.encoded(docs, path), path).select("text", "ids", "decoded").collect()
    assert all(r.decoded == sp.decode(list(r.ids)) for r in back)
    assert pieces.round_trip(none, path).count() == 0


def test_merges_equal_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, model, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.pieces(path), random.Random(9)
    parts = ["a", "b", "ab", "aa", " ", "  ", "\n", "\t", "é", "漢", "😀", "▁", "the", "in", "ing", "\x00", "<0x0A>", "</s>", "1", "=="]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a" * 5000, "ab" * 3000, "inging" * 900]
    ours = model.encode(texts)
    assert ours == [sp.encode(t) for t in texts]
    assert [model.decode(x) for x in ours] == [sp.decode(x) for x in ours]


def test_pipeline(spark, tmp_path):
    """run() against a plain version, stage by stage, on a small corpus."""
    import corpus_pipeline

    rng = random.Random(10)
    vocab = {k: [f"{k}{i}{'aeiou'[i % 5]}" for i in range(200)] for k in ("the", "sch")}
    line = lambda k, n=60: " ".join(rng.choice(vocab[k]) for _ in range(n))
    texts = [(line("the"), "en") for _ in range(40)] + [(line("sch"), "de") for _ in range(40)]
    item = line("the", 20)
    texts += [(texts[0][0].upper(), "en"), (None, "en"), ("12 34", "de"), (line("the") + " " + item, "en"), (texts[5][0], "en"), (texts[7][0] + " tail", "en")]
    docs = [(i, t, k, "s", 1) for i, (t, k) in enumerate(texts)]
    docs += [docs[10], (None, line("the"), "en", "s", 1)]  # a repeated row and one without an id
    clash = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, sha string, found string, content string, kept boolean, own string"
    spark.createDataFrame([(*d, "x", 7, "x", "x", "x", False, "x") for d in docs], clash).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}").collect()), key=str)
    left = [d for d in dict.fromkeys(docs) if d[1] and any(c.isalpha() for c in d[1])]
    last = {d[1].lower(): d[0] for d in left}
    left = [d for d in left if last[d[1].lower()] == d[0]]
    sets = {d[0]: brute_shingles(d[1]) for d in left}
    left = [d for d in left if d[0] is None or not any(o is not None and o < d[0] and alike(sets[o], sets[d[0]]) for o in sets)]
    assert got == sorted((d[0] for d in left if item not in d[1]), key=str)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
        none = stage(spark, empty, f"{tmp_path}")
        assert none.columns == empty.columns and none.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, f"{tmp_path}").count() == 0
