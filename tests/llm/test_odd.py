"""Language inference against plain loops, and odd tables of op4, op7 and the pipeline."""

import math
import random
from collections import Counter

import numpy as np

from panelforge.llm import chat, language


def plain_trigrams(text):
    """Bucket to count, character by character."""
    line, last = [], None
    for c in f" {(text or '').lower()} ":
        c = c if c.isalpha() else " "
        if not (c == last == " "):
            line.append(c)
        last = c
    found = Counter()
    for x in zip(line, line[1:], line[2:]):
        if any(c != " " for c in x):
            h = sum(ord(c) * m for c, m in zip(x, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)))
            found[(h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - language.BITS)] += 1
    return found


def plain_predict(model, text):
    """Expectation-maximisation with loops; language sets grow by the full mixture's proportions."""
    grams = plain_trigrams(text)
    if not grams:
        return "und", 0.0
    total, k = sum(grams.values()), len(model.langs)

    def fit(langs):
        pi = {x: 1 / len(langs) for x in langs}
        for _ in range(language.ROUNDS if len(langs) > 1 else 0):
            new = dict.fromkeys(langs, 0.0)
            for g, n in grams.items():
                whole = sum(pi[x] * model.p[g, x] for x in langs)
                for x in langs:
                    new[x] += n * pi[x] * model.p[g, x] / whole
            pi = {x: v / total for x, v in new.items()}
        return pi, sum(n * math.log(sum(pi[x] * model.p[g, x] for x in langs)) for g, n in grams.items())

    single = [sum(n * math.log(model.p[g, x]) for g, n in grams.items()) for x in range(k)]
    first = int(np.argmax(single))
    best, ll = {first: 1.0}, single[first]
    full, most = fit(range(k))
    if most - ll > language.PENALTY * math.log(total + 1):
        order = [first] + sorted((x for x in range(k) if x != first), key=lambda x: -full[x])
        for size in range(2, k + 1):
            pi, more = fit(order[:size])
            if more - ll <= language.PENALTY * math.log(total + 1):
                break
            best, ll = pi, more
    top = max(best, key=lambda x: (best[x], -x))
    return model.langs[top], best[top]


def test_mixtures_equal_plain_loops():
    rng = random.Random(1)
    words = {"a": ["the", "thing", "with"], "b": ["schön", "straße", "auch"], "c": ["être", "déjà", "nous", "the"]}
    text = lambda *kinds: " ".join(rng.choice(words[rng.choice(kinds)]) for _ in range(rng.randint(1, 60)))
    counts = np.zeros((language.BUCKETS, 3))
    for i, k in enumerate("abc"):
        for g, n in plain_trigrams(text(k) + " " + text(k)).items():
            counts[g, i] += n
    model = language.LanguageModel(list("abc"), counts)
    texts = [text(*rng.choice(["a", "b", "c", "ab", "bc", "abc"])) for _ in range(60)] + ["", None, "12 -", "x", "ß", "  The\n\nTHE  thing,with 3"]
    for x, (lang, share) in zip(texts, model.predict(texts)):
        want = plain_predict(model, x)
        assert lang == want[0] and abs(share - want[1]) < 1e-9, x
    doc, gram, n = language.trigrams(texts)
    for i, x in enumerate(texts):
        assert dict(zip(gram[doc == i].tolist(), n[doc == i].tolist())) == plain_trigrams(x)


def test_op7_repeated_rows_and_very_long_texts(spark):
    words = {"en": "the thing with other when", "de": "schön straße auch nicht zwischen"}
    rows = [(i, words[k] * 5, k) for i, k in enumerate(["en", "de"] * 10)] + [(5, words["de"] * 5, "de")] * 2 + [(99, f"{words['en']} " * 40_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs, language.train(docs.where(language.learnable()))).collect()
    assert len(got) == len(rows) and [r.lang_pred for r in got if r.doc_id == 99] == ["en"] and [r.lang_pred for r in got if r.doc_id == 5] == ["de"] * 3


def test_op4_repeated_rows_and_many_null_turns(spark):
    turns = [(1, 1, "user", "a")] * 3 + [(2, None, "user", f"{i % 5}") for i in range(1500)] + [(3, 1, "user", "a")] * 2
    got = {r.conv_id: (r.n_turns, r.n_equal, r.rendered) for r in chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    lines = lambda texts: "\n".join(f"<|user|>\n{x}" for x in texts)
    assert got == {1: (3, 1, lines("aaa")), 2: (1500, 1, lines(sorted(str(i % 5) for i in range(1500))))}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some item of a benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
