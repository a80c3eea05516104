"""Token ids in files: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

A file set is a folder of three Parquet tables. Each row of ``records`` is one document; rows are in ascending
doc_id order within a shard, and the shards are ascending ranges of doc_id:

* ``doc_id``; ``shard``; ``own``, the number of ids before it in its shard; ``n``, its number of ids
* ``control``: two bits for each id, four ids to a byte from the low bits up: the length of its code less one
* ``data``: the codes, little-endian ranks of 1 to 4 bytes

``shards`` has the number of ids before each shard, and ``ranks`` has (rank, id), rank 0 being the most frequent id
(ties: the smaller id).
"""

from __future__ import annotations

import json
import os
import uuid
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, text_batches
from .pieces import _iterated, groups

#: Bytes of each of the two generations of chunks a Python worker remembers, counting OVERHEAD for each chunk.
CACHE_BYTES, OVERHEAD = 96 << 20, 200
#: Longer chunks (in bytes) are not remembered. Words in a line for the library, and lines in a call.
LONG, LINE = 100, 128
#: Chunks with signs from here on, or with control signs, may be changed or cut in a way of the library's own.
PLAIN = "\u0180"
#: For each control byte: the four code lengths, and their sum.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)
#: The id a document ends with.
END = 1


def pack(ranks: np.ndarray, n: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(control, data) bytes of documents with ``n`` ranks each (unsigned, under 2**32), which follow each other."""
    ranks = ranks.astype("<u4")
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = -(-n // 4)
    begin = np.cumsum(quads) - quads
    places = np.zeros(4 * int(quads.sum()), np.uint8)
    places[np.arange(len(ranks)) + np.repeat(4 * begin - (np.cumsum(n) - n), n)] = more
    control = (places.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= more[:, None]].tobytes()
    ends = np.append(0, np.cumsum(more.astype(np.int64) + 1))[np.append(0, np.cumsum(n))].tolist()
    cuts = np.append(begin, quads.sum()).tolist()
    return [(control[c:d], data[e:f]) for c, d, e, f in zip(cuts, cuts[1:], ends, ends[1:])]


def unpack(control: list[bytes], data: list[bytes], n: np.ndarray) -> np.ndarray:
    """The ranks of :func:`pack`, of all documents: lengths by table lookup on control bytes, codes gathered at their offsets."""
    quads = -(-n // 4)
    places = np.arange(int(n.sum())) + np.repeat(4 * (np.cumsum(quads) - quads) - (np.cumsum(n) - n), n)
    size = LENGTHS[np.frombuffer(b"".join(control), np.uint8)].reshape(-1)[places]
    raw = np.zeros((len(size), 4), np.uint8)
    raw[np.arange(4, dtype=np.uint8) < size[:, None]] = np.frombuffer(b"".join(data), np.uint8)
    return raw.view("<u4").reshape(-1)


def parts(n: np.ndarray, most: int = 1 << 18) -> list[slice]:
    """Runs of documents with about ``most`` ids together; a longer document is alone."""
    ends = np.cumsum(n)
    out, at = [], 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + most, "right")))
        out.append(slice(at, to))
        at = to
    return out


#: What the Encoder relies on (fixed values): how a tokenizer file must normalise and cut texts.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Signs that a word is often followed by: the pattern cuts before them.
ENDS = frozenset(".,;:!?")
#: The suffix of pieces that end a word.
SUFFIX = "</w>"


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def divisible(tokenizer) -> bool:
    """Whether texts can be encoded word by word: lower-cased, white space dropped, cut as PRETOKENS says, each word
    ended by a piece with SUFFIX, and no added token that could lie within a text without the sign ``<|``."""
    file = json.loads(tokenizer.to_str())
    cut = {"type": "Split", "pattern": {"Regex": PRETOKENS}, "behavior": "Removed", "invert": True}
    same = (file["normalizer"] or {}).get("normalizers") == NORMALIZERS and (file["pre_tokenizer"] or {}).get("pretokenizers") == [cut, BYTES]
    model = file["model"]
    whole = model.get("end_of_word_suffix") == SUFFIX and not any(model.get(k) for k in ("dropout", "unk_token", "fuse_unk", "continuing_subword_prefix"))
    return same and whole and all("<|" in x["content"] for x in file["added_tokens"])


def words_only(tokenizer):
    """The same model (shared, not copied) for lines of words that are normalised and cut already: white space alone cuts
    them."""
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer(tokenizer.model)
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t


class Encoder:
    """Encodes texts chunk by chunk (what stands between ASCII white space), for tokenizers that are ``divisible``.

    Each distinct chunk is encoded once and remembered, by the tasks of a worker together, in two generations: chunks
    in use move to the younger, and the older goes when the younger has CACHE_BYTES. New chunks are cut into words by
    the tokenizer's own pattern, and distinct new words go through the library's model in lines of LINE words (see
    words_only); the pieces with SUFFIX tell where a word ends. Chunks whose lower-casing or cutting could differ from
    the library's go through it whole; so do all texts where the tokenizer is of another kind. Long chunks are not
    remembered.
    """

    def __init__(self, path: str):
        self.tokenizer = t = _tokenizer(path)
        self.dtype = np.dtype("<u2" if t.get_vocab_size() <= 1 << 16 else "<u4")
        self.divisible = divisible(t)
        self.ends = np.array([(t.id_to_token(i) or "").endswith(SUFFIX) for i in range(t.get_vocab_size())])
        self.model = words_only(t) if self.divisible else t
        self.cut = regex.compile(PRETOKENS).findall
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each of the words of the pattern; those of a call come apart after each piece with SUFFIX."""
        out, width = [], self.dtype.itemsize
        for at in range(0, len(words), LINE * LINE):
            part = words[at : at + LINE * LINE]
            lines = [" ".join(part[i : i + LINE]) for i in range(0, len(part), LINE)]
            found = self.model.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable([x.ids for x in found]), self.dtype)
            edge = (width * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(edge) != len(part):
                out += self._library(part)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *edge], edge)]
        return out

    def _learn(self, chunks: set[bytes]) -> list[bytes]:
        """Puts the ids of all ``chunks`` into the younger generation; returns the long ones, which are not to stay."""
        young, old = self.young, self.old
        new = chunks.difference(young)
        again = old.keys() & new
        for c in again:
            young[c] = x = old[c]
            self.size += len(c) + len(x) + OVERHEAD
        new = list(new - again)
        if not new:
            return []
        together = b"\n".join(new).decode("utf-8", "surrogatepass").lower()
        plain, alone, ended, cuts, odd = max(together) < PLAIN, {}, {}, {}, []
        for c, text in zip(new, together.split("\n")):
            known = plain or text.isascii() or max(text) < PLAIN
            if known and text.isalpha():
                alone[c] = text
            elif known and text[-1] in ENDS and text[:-1].isalpha():
                ended[c] = text[:-1]
            elif known and b"<|" not in c and text.isprintable():
                cuts[c] = self.cut(text)
            else:
                odd.append(c)
        young.update(zip(alone, self._words(list(alone.values()))))
        words = {*ENDS, *ended.values(), *chain.from_iterable(cuts.values())}
        ids = {w: x for w in words if (x := young.get(w.encode())) is not None}  # met as a chunk of its own
        rest = list(words - ids.keys())
        ids.update(zip(rest, self._words(rest)))
        young.update((c, ids[w] + ids[chr(c[-1])]) for c, w in ended.items())
        young.update((c, b"".join([ids[w] for w in parts])) for c, parts in cuts.items())
        if odd:
            young.update(zip(odd, self._library([c.decode("utf-8", "surrogatepass") for c in odd])))
        self.size += sum(map(len, new)) + sum(map(len, map(young.__getitem__, new))) + OVERHEAD * len(new)
        return [c for c in new if len(c) > LONG] if max(map(len, new)) > LONG else []

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``dtype``."""
        if not self.divisible:
            return self._library([x or "" for x in texts])
        raws = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
        cut = [(x if b"<|" in x else x.lower()).split() for x in raws]
        if self.size > CACHE_BYTES:
            self.young, self.old, self.size = {}, self.young, 0
        young = self.young
        rest = self._learn(set().union(*cut))
        of = young.__getitem__
        out = [b"".join(map(of, chunks)) for chunks in cut]
        for c in rest:
            self.size -= len(c) + len(young.pop(c)) + OVERHEAD
        return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_token_files(docs: DataFrame, path: str, out: str) -> None:
    """Encode every whole ``text`` with the tokenizer at ``path``, append END, and write the file set ``out``.

    Ids are encoded once, into a table in the shared folder. Their counts, taken a batch at a time by numpy and
    summed by Spark, give the ranks: the vocabulary bounds that table, so it is broadcast. Documents are dealt by
    ranges of doc_id, sorted, and coded in that order, which gives each its start within the shard. Null texts are
    empty (END alone), null doc_ids come first, rows that share a doc_id are neighbours in any order, an empty
    table gives empty files. Only doc_id and text are read.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    dtype = Encoder(path).dtype
    end = np.array([END], dtype).tobytes()

    def encode(batches):
        for texts in batches:
            yield pd.Series([x + end for part in groups(texts, 1 << 21) for x in encoder(path).encode(part)], dtype=object)

    raw = f"{shared_dir(spark)}/raw-ids-{uuid.uuid4().hex}"
    with text_batches(spark):
        docs.select("doc_id", _iterated(encode, "binary")("text").alias("raw")).write.parquet(raw)
    ids = spark.read.schema(f"doc_id {kind}, raw binary").parquet(raw)

    def count(batches):
        total = np.zeros(0, np.int64)
        for pdf in batches:
            own = np.bincount(np.frombuffer(b"".join(pdf["raw"]), dtype))
            total = np.pad(total, (0, max(0, len(own) - len(total))))
            total[: len(own)] += own
        yield pd.DataFrame({"id": np.flatnonzero(total), "n": total[total > 0]})

    ranks = ids.select("raw").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").select("id").toPandas()
    spark.createDataFrame(ranks.reset_index(names="rank"), "rank long, id long").coalesce(1).write.parquet(f"{out}/ranks")
    rank = np.zeros(int(ranks["id"].max()) + 1 if len(ranks) else 1, "<u4")
    rank[ranks["id"].to_numpy(np.int64)] = np.arange(len(ranks))
    shared = spark.sparkContext.broadcast(rank)

    def code(batches):
        before = 0
        for pdf in batches:
            raw, n = pdf["raw"].tolist(), pdf["raw"].str.len().to_numpy(np.int64) // dtype.itemsize
            rows = [x for at in parts(n) for x in pack(shared.value[np.frombuffer(b"".join(raw[at]), dtype)], n[at])]
            coded = pd.DataFrame(rows, columns=["control", "data"])
            coded.insert(0, "n", n)
            coded.insert(0, "own", before + np.cumsum(n) - n)
            coded.insert(0, "shard", pdf["shard"].to_numpy())
            coded.insert(0, "doc_id", pdf["doc_id"])
            before += int(n.sum())
            yield coded

    ties = ids.withColumn("tie", F.monotonically_increasing_id())  # a doc_id that many rows share, null too, is split
    ordered = ties.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id").drop("tie").withColumn("shard", F.spark_partition_id())
    ordered.mapInPandas(code, f"doc_id {kind}, shard int, own long, n long, control binary, data binary").write.parquet(f"{out}/records")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    sums = spark.read.parquet(f"{out}/records").groupBy("shard").agg(F.sum("n").alias("n"))
    sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(f"{out}/shards")


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (binary, little-endian unsigned 32-bit) of a file set."""
    ids = np.array([r.id for r in spark.read.parquet(f"{out}/ranks").orderBy("rank").collect()], "<u4")
    shared = spark.sparkContext.broadcast(ids)

    @F.pandas_udf("binary")
    def decode(control: pd.Series, data: pd.Series, n: pd.Series) -> pd.Series:
        control, data, n, out = control.tolist(), data.tolist(), n.to_numpy(np.int64), []
        for at in parts(n):
            raw = shared.value[unpack(control[at], data[at], n[at])].tobytes()
            ends = [0, *(4 * np.cumsum(n[at])).tolist()]
            out += [raw[a:b] for a, b in zip(ends, ends[1:])]
        return pd.Series(out, dtype=object)

    rows = spark.read.parquet(f"{out}/records").join(F.broadcast(spark.read.parquet(f"{out}/shards")), "shard")
    return rows.select("doc_id", (F.col("base") + F.col("own")).alias("start"), F.col("n").alias("n_tokens"), decode("control", "data", "n").alias("ids"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), out)
    return read_token_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
