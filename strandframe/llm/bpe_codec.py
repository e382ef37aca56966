"""Encoding and decoding by a table of distinct words.

Texts are split into words; the table holds each distinct word of the corpus once, with its ids; ids are joined back to the
words by position, and the decoded text comes from joining ids to their pieces. The most frequent words, as many as a stated
number of bytes holds, are broadcast as sorted word hashes beside an array of ids, and are joined inside each text. Words
beyond that bound are all rare; each text's distinct ones meet the table in a shuffled join and come back to their text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import least_count, shared_path

#: Bytes of the table of words that are broadcast, the most frequent words first; 12 a word beside its ids.
BROADCAST_BYTES = 96 << 20
#: Words that a task gathers before it hands on the distinct ones.
GATHERED = 400_000
#: Texts whose words are joined together.
TEXTS = 100
#: Distinct words whose ids a worker keeps.
KEPT_WORDS = 350_000
TABLE = "word string, n long, ids binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _ids_column(batch: pd.DataFrame, name: str) -> pd.Series:
    return batch[name].astype(object).where(batch[name].notna(), None)


def distinct_words(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(word, n): the distinct words of all texts and how often they come."""
    text = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen = bpe.loaded(text.value), Counter()
        for batch in batches:
            for x in batch["text"]:
                if x:
                    seen.update(words.split(x))
                    if len(seen) >= GATHERED:
                        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                        seen.clear()
        if seen:
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return docs.select("text").mapInPandas(gather, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encoded_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """(word, n, ids): each word encoded once; ids are little-endian unsigned 16-bit integers."""
    text = words.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = bpe.loaded(text.value).tokenizer
        for batch in batches:
            found = tokenizer.encode_batch_fast(batch["word"].tolist(), add_special_tokens=False)
            yield batch.assign(ids=[np.array(x.ids, "<u2").tobytes() for x in found])

    return words.mapInPandas(encode, TABLE)


class Table:
    """Ids of words by their hashes, for lookups in a worker. ids: all words' ids in the order of hashes; many: how many each has."""

    def __init__(self, seed: int, hashes: np.ndarray, many: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes)
        starts, many = (np.cumsum(many) - many)[order], many[order]
        self.seed, self.hashes, self.ends = seed, hashes[order], np.cumsum(many).astype(np.uint32)
        self.ids = ids[np.repeat(starts - (self.ends - many), many) + np.arange(len(ids))]
        self.distinct = not (self.hashes[1:] == self.hashes[:-1]).any()

    def places(self, words: list[str]) -> np.ndarray:
        """Where in the table each word is; -1 for those that it lacks."""
        h = np.array([xxhash.xxh64_intdigest(w, self.seed) for w in words], np.uint64)
        if not len(self.hashes):
            return np.full(len(h), -1)
        k = np.searchsorted(self.hashes, h)
        return np.where(self.hashes[np.minimum(k, len(self.hashes) - 1)] == h, k, -1)

    def at(self, places: np.ndarray) -> list[np.ndarray]:
        ends = np.append(np.uint32(0), self.ends)
        return [self.ids[a:b] for a, b in zip(ends[places].tolist(), ends[places + 1].tolist(), strict=True)]


def collected(table: DataFrame, least: int) -> Table:
    """The words of the table (word, n, ids) that come so often, on the driver, by hashes made on the executors. Where two of
    them have one hash, or a rarer word has one of theirs, it is another seed's."""
    context, frequent = table.sparkSession.sparkContext, table.where(F.col("n") >= least)
    for seed in range(100):

        def hashed(batches: Iterator[pd.DataFrame], seed: int = seed) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"h": np.array([xxhash.xxh64_intdigest(w, seed) for w in b["word"]], np.uint64).view(np.int64), "ids": b["ids"]})

        got = frequent.mapInPandas(hashed, "h long, ids binary").toArrow().combine_chunks()
        ids = got["ids"].chunk(0) if got["ids"].num_chunks else None
        if ids is None:
            return Table(seed, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16))
        ends = np.frombuffer(ids.buffers()[1], "<i4")[ids.offset : ids.offset + len(ids) + 1]
        values = np.frombuffer(ids.buffers()[2], "<u2")[ends[0] // 2 : ends[-1] // 2]
        out = Table(seed, got["h"].to_numpy().view(np.uint64), np.diff(ends).astype(np.int64) // 2, values)
        if out.distinct and (least <= 1 or not _mistaken(table.where(F.col("n") < least), context.broadcast(out))):
            return out
    raise ValueError("the words have no distinct hashes")


def _mistaken(rare: DataFrame, shared) -> bool:
    """Whether the broadcast table takes one of these words for its own."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[shared.value.places(b["word"].tolist()) >= 0]

    return not rare.select("word").mapInPandas(found, "word string").isEmpty()


class Joined(dict):
    """What a worker has joined so far: word to (its ids as text, their number, their pieces)."""

    def __init__(self, table: Table, pieces: list[bytes]):
        super().__init__()
        self.table, self.pieces = table, pieces

    def fill(self, words: set[str], rare: dict[str, bytes]) -> None:
        """Joins the words that are new, all at once; those that the table lacks are in `rare`."""
        if len(self) >= KEPT_WORDS:
            self.clear()
        new = [w for w in words if w not in self]  # set.difference would walk through all of this table
        places = self.table.places(new)
        known = np.flatnonzero(places >= 0)
        for k, found in zip(known.tolist(), self.table.at(places[known]), strict=True):
            self._put(new[k], found.tolist())
        for k in np.flatnonzero(places < 0).tolist():
            self._put(new[k], np.frombuffer(rare[new[k]], "<u2").tolist())

    def _put(self, word: str, ids: list[int]) -> None:
        pieces = self.pieces
        self[word] = (",".join(map(str, ids)), len(ids), b"".join([pieces[k] for k in ids]))


def _digests(docs: DataFrame, vocabulary: str, table: Table) -> DataFrame:
    """DIGESTS of (doc_id, text, rare), rare being the text's words that the table lacks, with their ids, or null."""
    context = docs.sparkSession.sparkContext
    text, shared = context.broadcast(vocabulary), context.broadcast(table)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, joined = bpe.loaded(text.value), Joined(shared.value, bpe.pieces(text.value))
        for batch in batches:
            rows = []
            for k in range(0, len(batch), TEXTS):
                some = batch.iloc[k : k + TEXTS]
                split = [words.split(x) if x else [] for x in some["text"]]
                rare = {r["word"]: r["ids"] for found in some["rare"] if found is not None for r in found}
                joined.fill(set().union(*split), rare)
                for text_words in split:
                    found = [joined[w] for w in text_words]
                    ids = ",".join([f[0] for f in found])
                    whole = b"".join([f[2] for f in found]).decode("utf-8", "replace").encode()
                    rows.append((sum([f[1] for f in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(whole).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", _ids_column(batch, "doc_id").array)
            yield out

    return docs.select("doc_id", "text", "rare").mapInPandas(join, DIGESTS)


def _with_rare_words(docs: DataFrame, vocabulary: str, table: DataFrame, frequent: Table) -> DataFrame:
    """(doc_id, text, rare): each text beside its words that `frequent` lacks, with their ids. Texts are told apart by doc_id and
    a digest; no word of this join is frequent, and a text's rare words are no more than the text."""
    context = docs.sparkSession.sparkContext
    text, shared = context.broadcast(vocabulary), context.broadcast(frequent)

    def lacking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = bpe.loaded(text.value)
        for b in batches:
            found = [list(set(words.split(x))) if x else [] for x in b["text"]]
            new = list(set().union(*found))
            lack = {w for w, k in zip(new, shared.value.places(new).tolist(), strict=True) if k < 0}
            yield b[["doc", "copy"]].assign(words=[[w for w in f if w in lack] for f in found])

    docs = docs.withColumn("doc", F.col("doc_id").cast("string")).withColumn("copy", F.sha2(F.coalesce("text", F.lit("")), 256))
    rare = docs.select("doc", "copy", "text").mapInPandas(lacking, "doc string, copy string, words array<string>")
    rare = rare.select("doc", F.col("copy").alias("c"), F.explode("words").alias("word")).distinct().join(table.select("word", "ids"), "word")
    rare = rare.groupBy(F.col("doc").alias("d"), "c").agg(F.collect_list(F.struct("word", "ids")).alias("rare"))
    return docs.join(rare, F.col("doc").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")), "left")


def round_trip(docs: DataFrame, vocabulary: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document the number of its ids, and digests of the ids and of the text decoded from them.

    Null and empty texts have no ids; repeated rows give repeated rows; extra columns are ignored; an empty table gives no rows.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    path = shared_path(spark, "words")
    encoded_words(distinct_words(docs, vocabulary), vocabulary).write.parquet(path)
    table = spark.read.schema(TABLE).parquet(path)
    least = least_count(table, 12, broadcast_bytes, "ids")
    frequent = collected(table, least)
    if least > 1:
        docs = _with_rare_words(docs, vocabulary, table.where(F.col("n") < least), frequent)
    else:
        docs = docs.withColumn("rare", F.lit(None).cast("array<struct<word string, ids binary>>"))
    return _digests(docs, vocabulary, frequent)
