"""Language identification: each document as a mixture of languages, fitted by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed
from .pieces import groups

#: Character trigrams are hashed to so many buckets; the bound of the model is BUCKETS x languages.
BITS = 15
BUCKETS = 1 << BITS
ROUNDS, SMOOTHING, PENALTY = 12, 0.5, 3.0


def learnable() -> F.Column:
    """Rows to learn from: CRC-32 of doc_id as text, modulo 4, is not 2. A null doc_id has no remainder: false."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(False))


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's index, bucket, count) of the lower-cased texts' trigrams that hold a letter, sorted by both.

    All that isn't a letter counts as a space, runs of which count once.
    """
    lines = [" " + (x or "").lower() + " " for x in texts]
    flat = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(lines)), np.fromiter(map(len, lines), np.int64, len(lines)))
    kinds, back = np.unique(flat, return_inverse=True) if len(flat) < 1000 else (None, None)
    if kinds is None:
        table = np.zeros(int(flat.max()) + 1, bool)
        present = np.flatnonzero(np.bincount(flat))
        table[present] = [chr(c).isalpha() for c in present]
        letter = table[flat]
    else:
        letter = np.array([chr(c).isalpha() for c in kinds], bool)[back]
    code = np.where(letter, flat, 32).astype(np.uint64)
    keep = letter | np.append(True, letter[:-1] | (owner[1:] != owner[:-1]))
    code, owner, letter = code[keep], owner[keep], letter[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (code[:-2] * np.uint64(0x9E3779B1) + code[1:-1] * np.uint64(0x85EBCA77) + code[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    inside = (owner[:-2] == owner[2:]) & (letter[:-2] | letter[1:-1] | letter[2:])
    key = owner[:-2][inside] * BUCKETS + (mixed[inside] >> np.uint64(64 - BITS)).astype(np.int64)
    key, n = np.unique(key, return_counts=True)
    return key // BUCKETS, key % BUCKETS, n


class LanguageModel:
    """Trigram log-likelihoods of each language, with the mixture inference."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        p = counts + SMOOTHING
        self.p = np.ascontiguousarray((p / p.sum(0)).astype(np.float64)) if langs else np.zeros((BUCKETS, 0))

    def _fit(self, doc, n, p, mask, total):
        """Proportions and log-likelihood of each document over its languages in ``mask``."""
        start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        pi = mask / mask.sum(1, keepdims=True)
        for _ in range(ROUNDS if (mask.sum(1) > 1).any() else 0):
            joint = pi[doc] * p
            joint *= (n / joint.sum(1))[:, None]
            pi = np.add.reduceat(joint, start) / total[:, None]
        return pi, np.add.reduceat(n * np.log((pi[doc] * p).sum(1)), start)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its proportion) of each text; ``und`` and 0 for one that is null or has no letter.

        Language sets grow one by one, by the full mixture's proportions, while the log-likelihood gains more than
        PENALTY times the logarithm of the number of trigrams. Ties go to the language first in order.
        """
        out = [("und", 0.0)] * len(texts)
        doc, gram, n = trigrams(texts)
        if not len(doc) or not self.langs:
            return out
        whole, doc = np.unique(doc, return_inverse=True)
        p, k = self.p[gram], len(self.langs)
        start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        total = np.add.reduceat(n, start).astype(float)
        single = np.add.reduceat(n[:, None] * np.log(p), start)
        first = single.argmax(1)
        best, best_ll = np.zeros((len(whole), k)), single.max(1)
        best[np.arange(len(whole)), first] = 1
        if k > 1:
            full, ll = self._fit(doc, n, p, np.ones((len(whole), k)), total)
            live = ll - best_ll > PENALTY * np.log(total + 1)
            full[np.arange(len(whole)), first] = 2
            order = np.argsort(-full, 1, kind="stable")
            for size in range(2, k + 1):
                if not live.any():
                    break
                rows, inverse = np.flatnonzero(live), np.cumsum(live) - 1
                of = live[doc]
                mask = np.zeros((len(rows), k))
                np.put_along_axis(mask, order[rows, :size], 1, 1)
                pi, ll = self._fit(inverse[doc[of]], n[of], p[of], mask, total[rows])
                better = ll - best_ll[rows] > PENALTY * np.log(total[rows] + 1)
                best[rows[better]], best_ll[rows[better]] = pi[better], ll[better]
                live[rows[~better]] = False
        top = best.argmax(1)
        for i, t, share in zip(whole.tolist(), top.tolist(), best[np.arange(len(whole)), top].tolist()):
            out[i] = (self.langs[t], min(1.0, share))
        return out


def train(docs: DataFrame) -> LanguageModel:
    """The model of ``docs`` (text, lang; rows with a null in either are left out), from all their whole texts.

    Each task counts trigrams by language in numpy, Spark sums the counts, and the driver gets at most BUCKETS rows
    for each language.
    """

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, own in pdf.groupby("lang")["text"]:
                for part in groups(own.tolist()):
                    _, gram, n = trigrams(part)
                    total.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += np.bincount(gram, n, BUCKETS).astype(np.int64)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "gram": at, "n": n[at]})

    rows = docs.select("lang", "text").where("lang is not null and text is not null").mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS, len(langs)))
    counts[rows["gram"].to_numpy(int), np.searchsorted(langs, rows["lang"]).astype(int)] = rows["n"]
    return LanguageModel(langs, counts)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` of whole texts; columns of these names are replaced, all others stay.

    Null texts and those without a letter are ``und`` with 0. Rows are judged one by one: repeated rows are repeated,
    an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def guess(batches):
        for texts in batches:
            yield pd.DataFrame([x for part in groups(texts, 1 << 18) for x in shared.value.predict(part)], columns=["lang_pred", "score"])

    guess.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    kept = docs.drop("lang_pred", "score")
    rows = kept.select(packed(kept).alias("row"), F.pandas_udf(guess, "lang_pred string, score double")("text").alias("l"))
    return rows.select("row.*", "l.*")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(learnable()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score")
