"""Toxicity scores: a learned lexicon in a trie, Levenshtein automata for misspellings, and context windows."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .language import learnable

#: Labelled documents to learn from; they bound the lexicon and the misspellings seen in training too.
TRAIN_ROWS = 20_000
#: A term occurs in so many toxic documents at least, and its log odds are so high at least.
LEAST_DOCS, LEAST_ODDS = 3, 2.5
#: Terms from this length on may be misspelled, by one edit.
FUZZY_LENGTH, EDITS = 5, 1
WINDOW, THRESHOLD, CACHE_WORDS = 6, 0.3, 300_000
WORD = re.compile(r"\w+(?:[@$*]\w+)*")
#: Signs and words of quotation and report.
QUOTES = set("\"“”„«»‘’")
REPORTS = {"said", "says", "quote", "quoted", "wrote", "called", "word", "term", "sagte", "zitat", "wort", "dit", "mot", "dijo", "palabra"}


class Lexicon:
    """Terms with weights in a trie; ``known`` gives words near a term weights of their own."""

    def __init__(self, terms: dict[str, float], known: dict[str, float] | None = None):
        self.terms, self.known, self.trie = terms, known or {}, {}
        self.reach, self.longest = set(), max(map(len, terms), default=0)
        #: What a worker remembers: words met, and those of them that match.
        self.met: set[str] = set()
        self.marked: dict[str, tuple[float, bool]] = {}
        for term in terms:
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            if len(term) >= FUZZY_LENGTH:
                self.reach.update(self.shortened(term))

    @staticmethod
    def shortened(word: str) -> set[str]:
        """The word with up to EDITS letters left out. Words within EDITS of each other share one of these."""
        out = last = {word}
        for _ in range(EDITS):
            last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
            out = out | last
        return out

    def near(self, word: str) -> str | None:
        """The nearest term within EDITS of ``word``; of equally near ones the first in order.

        The states of the word's Levenshtein automaton are the entries near the diagonal of the rows of edit
        distances; they run down the trie and a branch ends where none is within EDITS. Words that share no
        shortened form with a term can't reach an end and aren't tried.
        """
        if not FUZZY_LENGTH - EDITS <= len(word) <= self.longest + EDITS or self.reach.isdisjoint(self.shortened(word)):
            return None
        size, best = len(word), (EDITS + 1, "")
        first = tuple(abs(k) if k >= 0 else size for k in range(-EDITS, EDITS + 1))
        stack = [(self.trie, 0, first)]
        while stack:
            node, depth, row = stack.pop()
            for c, below in node.items():
                if c == "":
                    k = size - depth + EDITS
                    if 0 <= k <= 2 * EDITS and row[k] <= EDITS and len(below) >= FUZZY_LENGTH:
                        best = min(best, (row[k], below))
                    continue
                new, left = [], size
                for k in range(2 * EDITS + 1):
                    i = depth + 1 + k - EDITS  # letters of the word; the entry's place in the full row
                    if i < 0 or i > size:
                        new.append(size)
                        continue
                    left = min(row[k + 1] + 1 if k < 2 * EDITS else size, row[k] + (i == 0 or word[i - 1] != c), left + 1)
                    new.append(left)
                if min(new) <= EDITS:
                    stack.append((below, depth + 1, new))
        return best[1] if best[0] <= EDITS else None

    def match(self, word: str) -> tuple[float, bool] | None:
        """(weight, whether misspelled) of a word, or None."""
        if word in self.terms:
            return self.terms[word], False
        term = self.near(word)
        if term is None:
            return None
        weight = self.known.get(word, self.terms[term])
        return (weight, True) if weight > 0 else None

    def features(self, text: str | None) -> list[float]:
        """Sums over hits: abusive, misspelled, quoted; the largest weight; hits in 100 words."""
        low = (text or "").lower()
        words = WORD.findall(low)
        distinct = set(words)
        if len(self.met) > CACHE_WORDS:
            self.met, self.marked = set(), {}
        new = distinct - self.met
        self.met |= new
        self.marked.update((w, m) for w in new if (m := self.match(w)))
        if self.marked.keys().isdisjoint(distinct):
            return [0.0] * 5
        cache = self.marked
        hits = [i for i, w in enumerate(words) if w in cache]
        spans = [m.span() for m in WORD.finditer(low)]
        abuse = fuzzy = quoted = top = 0.0
        for i in hits:
            weight, near = cache[words[i]]
            first, last = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
            left, right = low[spans[first][0] : spans[i][0]], low[spans[i][1] : spans[last][1]]
            report = bool(REPORTS.intersection(words[first : last + 1]))
            inside = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
            quote = (report + inside) / 2
            abuse += weight * (1 - quote) * (not near)
            fuzzy += weight * (1 - quote) * near
            quoted += weight * quote
            top = max(top, weight * (1 - quote / 2))
        return [math.log1p(abuse), math.log1p(fuzzy), math.log1p(quoted), top, min(10.0, 100 * len(hits) / len(words))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and weights learned from at most TRAIN_ROWS labelled documents, the ones of least hash.

    ``labels`` has doc_id and toxic; rows with a null, or with a label other than 0 and 1, are left out, of repeated
    ids the larger label counts. Of documents that share a doc_id one text, the first in order, is taken, so repeated
    rows count once. Words are counted by documents; counts come back only for words that can be terms or are within
    EDITS of one. Empty tables on either side, or labels of one kind only, give an empty lexicon's weights: an
    intercept of -3, below any threshold in use. Columns other than doc_id, text and toxic are not read.
    """
    spark = docs.sparkSession
    picked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # TRAIN_ROWS ids at most
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    scratch = Scratch(spark)
    rows = scratch.write(rows, "labelled")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)

    def count(batches):
        seen = {0: Counter(), 1: Counter()}
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                seen[int(toxic)].update(set(WORD.findall((text or "").lower())))
        words = list(seen[0] | seen[1])
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pd.DataFrame({"word": part, "n1": [seen[1][w] for w in part], "n0": [seen[0][w] for w in part]})

    words = rows.mapInPandas(count, "word string, n1 long, n0 long").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    words = words.withColumn("odds", odds)
    found = words.where((F.col("n1") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS)).collect()
    lexicon = Lexicon({r.word: r.odds for r in sorted(found)})
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("boolean")
    def close(ws: pd.Series) -> pd.Series:
        return pd.Series([w not in shared.value.terms and shared.value.near(w) is not None for w in ws], dtype=bool)

    near = words.where(close("word")).collect()
    lexicon = Lexicon(lexicon.terms, {r.word: r.odds for r in near})
    shared = spark.sparkContext.broadcast(lexicon)

    def featured(batches):
        for pdf in batches:
            yield pd.DataFrame([[*shared.value.features(t), float(y)] for t, y in zip(pdf["text"], pdf["toxic"])], columns=[*"abcde", "y"])

    x = rows.mapInPandas(featured, "a double, b double, c double, d double, e double, y double").toPandas().to_numpy()
    scratch.drop()
    if n1 == 0 or n0 == 0:
        return lexicon, np.array([0, 0, 0, 0, 0, -3.0])
    return lexicon, logistic(x[np.lexsort(x.T)][:, :5], x[np.lexsort(x.T)][:, 5])


def score(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row's whole text; null and empty texts have no hit, as clean ones.

    Rows are scored one by one: repeated rows are repeated, an empty table gives an empty table, other columns are not
    read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, weights))

    def rate(batches):
        lex, w = shared.value
        for texts in batches:
            yield pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(w[:-1], lex.features(t)) + w[-1]))))) for t in texts], dtype=float)

    rate.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.select("doc_id", F.pandas_udf(rate, "double")("text").alias("score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    lexicon, weights = train(docs.where(learnable()), labels.where(learnable()))
    return score(docs, lexicon, weights).select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
