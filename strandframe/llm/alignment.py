"""Alignment of two tokenizers' tokens over the same bytes.

A text, with a space before it, is cut before each space that follows a character which is not white space. There both tokenizers end
a token whatever stands around, so each distinct unit is encoded and aligned once in a worker and its result holds wherever it comes.

In a batch of new units all tokens of both tokenizers stand on one line of bytes. Every token points to the token of the other
side that overlaps it and ends farthest to the right, or to itself where none ends beyond it; replacing each pointer by its
successor's pointer, for all tokens at once, doubles the distance until all point to the last token of their group.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import checkpointed, held, least_count, shared_path

#: Bytes of the table of linked pairs that are broadcast, the most frequent pairs first, and of each pair.
BROADCAST_BYTES, PAIR_BYTES = 96 << 20, 24
#: Distinct units whose alignments a worker keeps; beyond, it starts afresh.
KEPT_UNITS = 250_000
#: Texts whose new units are aligned together; bytes of links that a task's writer holds.
TEXTS, ROW_GROUP = 200, 16 << 20
UNITS = re.compile(r"(?<=\S)(?= )")
#: A space after white space; without one, units are what single spaces part.
AFTER_SPACE = re.compile(r"\s ")
#: How the byte-level tokenizer parts words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pair of ids is one number of 32 bits: the first id times this, plus the second.
SHIFT = 1 << 16
LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
COUNTED = [c.split()[0] for c in ALIGNED.split(", ")]


def read_model(path: str) -> bytes:
    """The bytes of a tokenizer's model file."""
    with open(path, "rb") as f:
        return f.read()


def units(text: str) -> list[str]:
    """A space and the text, cut into units; each is given without the space that it begins with."""
    if text[:1] != " " and not AFTER_SPACE.search(text):
        return text.split(" ")
    return [u[1:] for u in UNITS.split(" " + text)]


def farthest(first_ends: np.ndarray, second_ends: np.ndarray) -> np.ndarray:
    """For each token of the first side, then of the second, the last token of its group (numbered through both sides). Both
    sides cover the same bytes without gaps; ends ascend."""
    many = len(first_ends)
    first_starts, second_starts = (np.concatenate(([0], e[:-1])) for e in (first_ends, second_ends))
    to_second = many + np.searchsorted(second_starts, first_ends, "left") - 1
    to_first = np.searchsorted(first_starts, second_ends, "left") - 1
    to_first = np.where(first_ends[to_first] > second_ends, to_first, many + np.arange(len(second_ends)))
    pointer = np.concatenate((to_second, to_first))
    while True:
        doubled = pointer[pointer]
        if np.array_equal(doubled, pointer):
            return pointer
        pointer = doubled


class Aligner:
    """Alignments of distinct units by number: the numbers of tokens of A and B, of groups and of links, the groups as text with a ;
    before each, and the links' pairs as little-endian 32-bit numbers. Units whose bytes a tokenizer does not give back have the number -1."""

    def __init__(self, vocabulary: str, model: bytes):
        import sentencepiece

        self.a_ranks = bpe._by_ranks(vocabulary, json.loads(vocabulary), WORDS)
        if self.a_ranks is None:  # else the vocabulary is held once only
            from tokenizers import Tokenizer

            self.a = Tokenizer.from_str(vocabulary)
            self.a.no_truncation()
            self.a.no_padding()
            self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_pieces = bpe.pieces(vocabulary)
        self.b_pieces = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size()))]
        if max(len(self.a_pieces), len(self.b_pieces)) > SHIFT:
            raise ValueError("ids of both vocabularies must fit in 16 bits")
        self.a_sizes, self.b_sizes = (np.array([len(p) for p in pieces]) for pieces in (self.a_pieces, self.b_pieces))
        #: Each id as text after each mark: before a group, within a side, between its sides.
        many = max(len(self.a_pieces), len(self.b_pieces))
        self.marked = [f"{mark}{k}" for mark in ";,|" for k in range(many)]
        self.marked_sizes = np.array([len(x) for x in self.marked])
        self.many = many
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.good = 0
        self.fields, self.texts, self.pairs = np.zeros((1024, 4), np.int64), [], []

    def full(self) -> bool:
        return len(self.index) >= KEPT_UNITS

    def _a_ids(self, text: str) -> list[int]:
        if self.a_ranks is not None:
            return self.a_ranks.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def fill(self, wanted: set[str]) -> None:
        """Aligns those units that are new, all at once."""
        new = wanted.difference(self.index) if len(wanted) > len(self.index) else {u for u in wanted if u not in self.index}
        # A unit that ends in white space ends a text; elsewhere its space would go with the next unit's.
        last = [u for u in new if not u or u[-1] <= " " or u[-1] > "~" and u[-1].isspace()]
        whole = list(new.difference(last))
        # Bytes that a tokenizer does not give back are looked for unit by unit, if there are any.
        raw = "".join([" " + u for u in whole])
        a_ids, b_ids = self._a_ids(raw), self.b.encode(whole, num_threads=1)
        if self._gives(raw.encode(), a_ids, [i for x in b_ids for i in x]):
            a_ids = [a_ids]
        else:
            a_ids, b_ids, whole = self._checked(whole, b_ids)
        if last:
            more_a, more_b, last = self._checked(last, [x or [self.b.piece_to_id("▁")] for x in self.b.encode(last, num_threads=1)])
            a_ids, b_ids, whole = a_ids + more_a, b_ids + more_b, whole + last
        if whole:
            self._align(whole, list(itertools.chain.from_iterable(a_ids)), b_ids)

    def _gives(self, raw: bytes, a_ids: list[int], b_ids: list[int]) -> bool:
        return b"".join([self.a_pieces[i] for i in a_ids]) == raw == b"".join([self.b_pieces[i] for i in b_ids])

    def _checked(self, found: list[str], b_ids: list[list[int]]) -> tuple[list[list[int]], list[list[int]], list[str]]:
        out_a, out_b, out = [], [], []
        for u, y in zip(found, b_ids, strict=True):
            x = self._a_ids(" " + u)
            if self._gives((" " + u).encode(), x, y):
                out_a.append(x)
                out_b.append(y)
                out.append(u)
            else:
                self.index[u] = -1
        return out_a, out_b, out

    def _align(self, names: list[str], a_ids: list[int], b_ids: list[list[int]]) -> None:
        a, b = np.array(a_ids, np.int64), np.fromiter(itertools.chain.from_iterable(b_ids), np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        unit_ends = np.cumsum([1 + len(u) if u.isascii() else 1 + len(u.encode()) for u in names])
        last = farthest(a_ends, b_ends)
        # Each stretch of bytes between neighbouring ends lies in one token of either side: those two are linked.
        ends = np.union1d(a_ends, b_ends)
        pairs = a[np.searchsorted(a_ends, ends)] * SHIFT + b[np.searchsorted(b_ends, ends)]
        group_ends = np.unique(np.concatenate((a_ends, b_ends))[last])
        counts = [np.diff(np.searchsorted(e, unit_ends, "right"), prepend=0) for e in (a_ends, b_ends, group_ends, ends)]
        # The text of all groups: tokens by group, those of A before those of B, each after its mark.
        group, side = last, np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, group))
        group, side = group[order], side[order]
        new_side = np.concatenate(([True], (group[1:] != group[:-1]) | (side[1:] != side[:-1])))
        chosen = np.where(~new_side, 1, np.where(side == 0, 0, 2)) * self.many + np.concatenate((a, b))[order]
        cuts = np.cumsum(self.marked_sizes[chosen])[np.cumsum(counts[0] + counts[1]) - 1].tolist()
        text = "".join(map(self.marked.__getitem__, chosen.tolist()))
        first = self.good
        self.index.update(zip(names, range(first, first + len(names)), strict=True))
        self.texts += [text[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        raw, link_cuts = pairs.astype("<u4").tobytes(), (4 * np.cumsum(counts[3])).tolist()
        self.pairs += [raw[a:b] for a, b in zip([0, *link_cuts], link_cuts, strict=False)]
        self.good += len(names)
        while self.good > len(self.fields):
            self.fields = np.concatenate((self.fields, np.zeros_like(self.fields)))
        for j, n in enumerate(counts):
            self.fields[first : self.good, j] = n


def _numbered(found: list[list[str]], aligner: Aligner) -> list[list[int]]:
    """The numbers of the units of each text, all aligned; of texts that have no tokens, none."""
    number = aligner.index.__getitem__
    out = [list(map(number, f)) for f in found]
    return [[] if -1 in x else x for x in out] if aligner.good < len(aligner.index) else out


def aligned(docs: DataFrame, vocabulary: str, model: bytes) -> DataFrame:
    """LINKED: per document its tokens, groups and links, the digest of its groups and its links' pairs."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held(("aligner", hash(shared.value)), lambda: Aligner(*shared.value))
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                some = batch.slice(k, TEXTS)
                found = [units(t) if t else [] for t in some["text"].to_pylist()]
                if aligner.full():
                    aligner.clear()
                aligner.fill(set().union(*found))
                numbers = _numbered(found, aligner)
                sums = np.array([aligner.fields[x].sum(0) if x else np.zeros(4, np.int64) for x in numbers], np.int64).reshape(-1, 4)
                texts = ["".join([aligner.texts[i] for i in x])[1:] for x in numbers]
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
                pairs = pa.array(np.frombuffer(b"".join([aligner.pairs[i] for x in numbers for i in x]), "<i4"))
                pairs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sums[:, 3]))).astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([some["doc_id"], *map(pa.array, sums.T), pa.array(digests, pa.string()), pairs], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(link, LINKED)


def _counted(linked: DataFrame, table) -> DataFrame:
    """linked without its pairs, with n_best and count_sum as far as the broadcast table of pairs goes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, values = table.value
        for batch in (whole.slice(k, TEXTS) for whole in batches for k in range(0, whole.num_rows, TEXTS)):
            own, ends = batch["pairs"].flatten().to_numpy(), np.concatenate(([0], np.cumsum(batch["n_links"].to_numpy())))
            sums = [np.zeros(batch.num_rows, np.int64)] * 2
            if len(pairs):
                k = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
                known = pairs[k] == own
                totals = [np.concatenate(([0], np.cumsum(np.where(known, v[k], 0)))) for v in values]
                sums = [t[ends[1:]] - t[ends[:-1]] for t in totals]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in COUNTED[:5]), *map(pa.array, sums), batch["groups_sha256"]], COUNTED)

    return linked.mapInArrow(count, ALIGNED)


def align(docs: DataFrame, vocabulary: str, model: bytes, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document the numbers of tokens of both tokenizers, of groups and of links, how many links are their B id's most
    frequent, the sum of their pairs' counts over all texts, and a digest of the groups.

    Texts that are null or empty, or whose bytes a tokenizer does not give back, have zeros and '' as digest; such texts add no
    counts. Texts of any length are taken whole. Repeated rows count and return as often as they come; null ids are kept; extra
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "links")
    aligned(docs, vocabulary, model).write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    linked = spark.read.schema(LINKED).parquet(path)
    counted = checkpointed(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    # An id of B meets at most as many pairs as A has ids, so no part of this window outgrows a task.
    best = F.col("n") == F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(SHIFT - 1)))
    pairs = checkpointed(counted.withColumn("best", best.cast("long")))
    least = least_count(pairs, PAIR_BYTES, broadcast_bytes)
    got = pairs.where(F.col("n") >= least).toArrow().sort_by("pair")
    table = spark.sparkContext.broadcast((got["pair"].to_numpy(), (got["best"].to_numpy(), got["n"].to_numpy())))
    out = _counted(linked, table)
    if least == 1:
        return out
    # Pairs beyond the table are all rare: each text's meet their counts in a shuffle. Rows of one id and digest are alike.
    rare = linked.select("doc_id", "groups_sha256", "pairs").dropDuplicates(["doc_id", "groups_sha256"]).withColumn("pair", F.explode("pairs"))
    rare = rare.join(pairs.where(F.col("n") < least), "pair").groupBy(F.col("doc_id").alias("d"), F.col("groups_sha256").alias("g")).agg(F.sum("best").alias("b"), F.sum("n").alias("s"))
    out = out.join(rare, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("groups_sha256") == F.col("g")), "left")
    more = {"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))}
    return out.withColumns(more).select(*COUNTED)
