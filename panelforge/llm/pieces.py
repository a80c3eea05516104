"""SentencePiece BPE encoding by vectorised merge rounds, and decoding."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NONE = np.iinfo(np.int64).max
#: Space becomes this mark; words are cut before it.
MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Bytes of words a task remembers before it starts afresh, counting OVERHEAD and 8 for each letter of a word.
CACHE_BYTES, OVERHEAD = 48 << 20, 300


class Cache(dict):
    """Words with their ids; ``trim`` forgets all once they take CACHE_BYTES."""

    size = 0

    def learn(self, words: list[str], ids) -> None:
        self.update(zip(words, ids))
        self.size += 8 * sum(map(len, words)) + OVERHEAD * len(words)

    def trim(self) -> None:
        if self.size > CACHE_BYTES:
            self.clear()
            self.size = 0


class Pieces:
    """The vocabulary of a BPE model with byte fallback, identity normalisation and a dummy prefix.

    The file is read by the sentencepiece library; splitting, merging and decoding are done here.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.eos, size = sp.eos_id(), sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        byte = [sp.is_byte(i) for i in range(size)]
        self.bytes = [b"" if s else bytes([int(p[3:5], 16)]) if b else p.replace(MARK, " ").encode() for p, s, b in zip(names, special, byte)]
        self.byte_ids = {self.bytes[i]: i for i in range(size) if byte[i]}
        ids = {p: i for i, p in enumerate(names) if not special[i] and not byte[i]}
        if any(re.search(f"[^{MARK}]{MARK}|.\n|\n.", p, re.S) for p in ids):
            raise ValueError("a piece spans words")
        self.chars = {p: i for p, i in ids.items() if len(p) == 1}
        self.size = size
        pairs = {ids[p[:k]] * size + ids[p[k:]]: i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self._index(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))
        score = np.array([sp.get_score(i) for i in range(size)])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)

    def _index(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """A hash table for pairs: a slot for each key, and a second, smaller table for keys whose slot is taken."""
        self.tables, bits = [], 19
        while len(keys):
            slot = self._slot(keys, bits, len(self.tables))
            slot, first = np.unique(slot, return_index=True)
            table = np.full(1 << bits, -2, np.int64), np.zeros(1 << bits, np.int64)
            table[0][slot], table[1][slot] = keys[first], merged[first]
            self.tables.append((bits, *table))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, merged, bits = keys[rest], merged[rest], max(8, bits - 3)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, turn: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn * 0x5851F42D4C957F2D & (1 << 64) - 1 | 1)) >> np.uint64(64 - bits)).view(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged piece and its rank for each pair of symbols; NONE as the rank where there is none."""
        key = np.where((left < self.size) & (right < self.size), left * self.size + right, -1)
        piece = np.full(len(key), -1, np.int64)
        for turn, (bits, keys, merged) in enumerate(self.tables):
            at = self._slot(key, bits, turn)
            hit = keys[at] == key
            piece[hit] = merged[at[hit]]
        return piece, np.where(piece >= 0, self.rank[piece], NONE)

    def merge(self, words: list[str]) -> list[list[int]]:
        """Symbols of each word once no pair is left; symbols from ``size`` on are characters without a piece.

        All words lie in one flat array. In a round each word takes its pair of least rank, and all leftmost
        occurrences of it that don't overlap are merged, unless a pair so formed would come before the rest:
        then only the first, as merging one at a time would. Finished words leave the array; ranks are looked up
        anew only beside what was merged.
        """
        flat = "".join(words)
        if not flat:
            return [[] for _ in words]
        code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        table = np.arange(int(code.max()) + 1) + self.size
        for c in np.flatnonzero(np.bincount(code)).tolist():
            table[c] = self.chars.get(chr(c), self.size + c)
        symbol = table[code]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        piece, rank = (np.append(x, y) for x, y in zip(self.pair(symbol[:-1], symbol[1:]), (-1, NONE)))
        rank[:-1][word[:-1] != word[1:]] = NONE
        ready = []
        while len(symbol):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, start)
            live = np.repeat(least, np.diff(np.append(start, len(symbol))))
            keep = live != NONE
            ready.append((word[~keep], symbol[~keep]))
            take = np.flatnonzero(keep & (rank == live))
            if not len(take):
                break
            run = np.append(True, np.diff(take) != 1)
            if not run.all():
                first = np.maximum.accumulate(np.where(run, np.arange(len(take)), 0))
                take = take[(np.arange(len(take)) - first) % 2 == 0]
            own = word[take]
            head = np.append(True, own[1:] != own[:-1])
            if not head.all():
                take = take[head | ~self._unsafe(symbol, word, piece, live, take, own, head)]
            symbol[take] = piece[take]
            keep[take + 1] = False
            at = (np.cumsum(keep) - 1)[take]
            symbol, word, piece, rank = symbol[keep], word[keep], piece[keep], rank[keep]
            at = np.unique(np.concatenate([at, np.maximum(at - 1, 0)]))
            after = np.minimum(at + 1, len(symbol) - 1)
            piece[at], new = self.pair(symbol[at], symbol[after])
            rank[at] = np.where((word[after] == word[at]) & (after > at), new, NONE)
        word, symbol = (np.concatenate(x) for x in zip(*ready))
        order = np.argsort(word, kind="stable")
        edge, out = np.searchsorted(word[order], np.arange(len(words) + 1)).tolist(), symbol[order].tolist()
        return [out[a:b] for a, b in zip(edge, edge[1:])]

    def _unsafe(self, symbol, word, piece, live, take, own, head) -> np.ndarray:
        """Which merges are of a word where merging all at once may differ from merging one at a time."""
        new, two = piece[take], np.minimum(take + 2, len(symbol) - 1)
        before = np.where((take > 0) & (word[take - 1] == own), self.pair(symbol[take - 1], new)[1], NONE)
        after = np.where((take + 2 < len(symbol)) & (word[two] == own), self.pair(new, symbol[two])[1], NONE)
        early = np.minimum(np.minimum(before, after), self.pair(new, new)[1]) <= live[take]
        other = new != new[np.maximum.accumulate(np.where(head, np.arange(len(take)), 0))]
        bad = np.zeros(int(word[-1]) + 1, bool)
        bad[own[early | other]] = True
        return bad[own]

    def ids(self, symbols: list[int]) -> list[int]:
        """Symbols as ids; a character without a piece becomes the ids of its UTF-8 bytes."""
        if max(symbols) < self.size:
            return symbols
        return [i for s in symbols for i in ([s] if s < self.size else [self.byte_ids[bytes([b])] for b in chr(s - self.size).encode("utf-8", "surrogatepass")])]

    def words(self, text: str | None) -> list[str]:
        return WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str | None], cache: Cache | None = None) -> list[list[int]]:
        """Ids of each text, without begin or end; a null or empty text has none."""
        cache = Cache() if cache is None else cache
        cut = [self.words(x) for x in texts]
        new = list({w for words in cut for w in words if w not in cache})
        cache.learn(new, map(self.ids, self.merge(new)))
        return [list(chain.from_iterable(map(cache.__getitem__, words))) for words in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control ids vanish, and so does the dummy prefix."""
        out = b"".join(map(self.bytes.__getitem__, ids))
        return out.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def groups(texts, most: int = 1 << 19):
    """Lists of texts of about ``most`` characters together; a longer text is alone."""
    part, n = [], 0
    for x in texts:
        if part and n + len(x or "") > most:
            yield part
            part, n = [], 0
        part.append(x)
        n += len(x or "")
    if part:
        yield part


def encoded(docs: DataFrame, path: str, end: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int) of the whole ``text``, the end id last if ``end``; null counts as empty.

    ``path`` must name the model on every executor. An existing column ``ids`` is replaced.
    """

    def encode(batches):
        model, cache = pieces(path), Cache()
        for texts in batches:
            out = []
            for part in groups(texts):
                cache.trim()
                out += [x + [model.eos] * end for x in model.encode(part, cache)]
            yield pd.Series(out)

    return docs.withColumn("ids", _iterated(encode, "array<int>")("text"))


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``decoded``, the text of ``ids``; null ids give an empty text."""

    def decode(batches):
        for ids in batches:
            yield pd.Series([pieces(path).decode([] if x is None else list(x)) for x in ids], dtype=object)

    return rows.withColumn("decoded", _iterated(decode, "string")("ids"))


def _iterated(f, kind: str):
    from collections.abc import Iterator

    f.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(f, kind)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (see op10's contract).

    Encodes, adds the end id, decodes those ids, and keeps only digests, in one pass of bounded memory: texts go
    in groups of about half a million characters. Null and empty texts have the end id alone. Works on rows alone, so
    repeated rows are repeated and an empty table gives an empty table.
    """

    def digest(batches):
        model, cache, names = pieces(path), Cache(), list(map(str, range(pieces(path).size)))
        for texts in batches:
            rows = []
            for part in groups(texts):
                cache.trim()
                for ids in model.encode(part, cache):
                    ids.append(model.eos)
                    line = " ".join(map(names.__getitem__, ids)).encode()
                    rows.append((len(ids), hashlib.sha256(line).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    from collections.abc import Iterator

    digest.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    out = docs.select("doc_id", F.pandas_udf(digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")("text").alias("o"))
    return out.select("doc_id", "o.*")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
