"""Token ids in files of Re-Pair grammars.

A shard holds consecutive documents in blocks. In each block, frequent pairs of symbols are replaced by new symbols, again
and again; the block stores the rules, how many ids each symbol expands to, and the shortened sequence. All symbols fit 16
bits: the ids and as many rules as remain. Running sums of expansion lengths give any document's symbols without expanding
the rest (``decode_document``).

A file is Parquet, written and read by Spark in any store: shard, block, start (ids of the shard before the block), doc_ids,
lengths, grammar.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import shared_path

MAGIC = b"RPG1"
SYMBOLS = 1 << 16
#: Ids in a block, at least (unless it is a shard's last); a pair's least count; new symbols a round.
BLOCK_IDS, LEAST, RULES = 1 << 20, 8, 4096
#: Distinct words that a worker keeps encoded; texts that are encoded at once.
KEPT_WORDS, TEXTS = 600_000, 32
BLOCK = "shard int, block int, start long, doc_ids array<long>, lengths array<int>, grammar binary"


class _Pairs:
    """The neighbouring symbols of a sequence, as replaced pairs leave it: a place is that of the left symbol in the first sequence, and
    those of a pair make a group. A pair that is new has a new symbol in it, so its group is found as a whole when that symbol is made and
    only shrinks from then on; pairs that come fewer than `least` times need no group."""

    def __init__(self, ids: np.ndarray, least: int):
        n = len(ids)
        self.seq, self.least = ids.astype(np.uint16), least
        # 32 bits a place: looked up all over, they stay in the processor's cache, and the memory is used again for the next block.
        self.after, self.before, self.gone = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32), np.zeros(n, bool)
        self.group = np.full(n, -1, np.int32)  # of the pair at a place
        self.places, self.filled = np.empty(3 * n, np.int32), 0  # of all groups, one after another
        self.pair, self.count, self.first, self.size = (np.zeros(0, np.int64) for _ in range(4))
        self._add(np.arange(n - 1))

    def _runs(self, at: np.ndarray) -> np.ndarray:
        """Whether each of ascending places begins a run of neighbours."""
        return np.append(True, self.after[at[:-1]] != at[1:])[: len(at)]

    def every_other(self, at: np.ndarray) -> np.ndarray:
        """Of ascending places, in each run of neighbours every other one from the left."""
        starts = np.flatnonzero(self._runs(at))
        if len(starts) == len(at):
            return np.ones(len(at), bool)
        return (np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))) % 2 == 0

    def _add(self, at: np.ndarray) -> None:
        """Groups for the pairs at places that have none; at does not hold the last place."""
        key = self.seq[at].astype("<u8")  # 16 bits of either symbol and 32 of the place
        key <<= np.uint64(16)
        key |= self.seq[self.after[at]]
        key <<= np.uint64(32)
        key |= at.astype(np.uint64)
        key.sort()
        at, pair = key.view("<u4").reshape(-1, 2).T
        starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
        size = np.diff(np.append(starts, len(pair)))
        many = size >= self.least
        use = np.repeat(many, size)
        pair, at, size = pair[starts[many]].astype(np.int64), at[use].astype(np.int64), size[many]
        own = np.arange(len(self.pair), len(self.pair) + len(pair))
        self.group[at] = np.repeat(own, size)
        self.places[self.filled : self.filled + len(at)] = at
        self.pair, self.count = np.concatenate((self.pair, pair)), np.concatenate((self.count, size))
        self.first, self.size = np.concatenate((self.first, self.filled + np.cumsum(size) - size)), np.concatenate((self.size, size))
        self.filled += len(at)
        self._count_twins(own)

    def of(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the groups' pairs stand, a group's places ascending, and which of the groups it is."""
        size = self.size[groups]
        which = np.repeat(np.arange(len(groups)), size)
        at = self.places[np.repeat(self.first[groups] - np.cumsum(size) + size, size) + np.arange(len(which))]
        here = self.group[at] == groups[which]
        return at[here], which[here]

    def _count_twins(self, groups: np.ndarray) -> None:
        """How often those of the groups whose symbols are one can be replaced: of a run of one symbol, every other pair counts."""
        twins = groups[self.pair[groups] >> 16 == self.pair[groups] & 0xFFFF]
        if len(twins):
            at, which = self.of(twins)
            order = np.argsort(at)  # a run is of one group
            at, which = at[order], which[order]
            self.count[twins] = np.bincount(which[self.every_other(at)], minlength=len(twins))

    def replace(self, at: np.ndarray, symbol: np.ndarray) -> None:
        """Puts symbols for the pairs at ascending places that do not overlap."""
        n = len(self.seq)
        right, left = self.after[at], self.before[at]
        beyond = self.after[right]
        apart = left >= 0
        apart[1:] &= left[1:] != right[:-1]
        lost = np.concatenate((left[apart], at, right))
        groups = self.group[lost]
        groups = groups[groups >= 0]
        fewer = np.bincount(groups, minlength=len(self.count))
        self.count -= fewer
        self.group[lost] = -1
        self.seq[at], self.gone[right], self.after[at] = symbol, True, beyond
        self.before[beyond[beyond < n]] = at[beyond < n]
        self._count_twins(np.flatnonzero(fewer))
        self._add(np.concatenate((left[apart], at[beyond < n])))


def compress(ids: np.ndarray, first: int, least: int = LEAST, most: int = RULES) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence): symbol first + k stands for the pair rules[k]. Ids are below first.

    Each round takes the counts of all pairs and replaces those at least half as frequent as the most frequent one, until no pair comes
    `least` times or the symbols are used up. Between rounds only counts beside replaced pairs change.
    """
    pairs, rules, made = _Pairs(ids, least), [], 0
    while (room := min(most, SYMBOLS - first - made)) > 0 and len(pairs.count):
        top = int(pairs.count.max())
        if top < least:
            break
        chosen = np.flatnonzero(pairs.count >= max(least, (top + 1) // 2))
        chosen = chosen[np.argsort(pairs.pair[chosen])]
        n = pairs.count[chosen]
        most_frequent = chosen[n.argmax()]
        chosen = chosen[np.sort(np.argsort(-n, kind="stable")[:room])]
        at, rule = _places(pairs, chosen)
        used = np.bincount(rule, minlength=len(chosen))
        kept = np.flatnonzero(used >= least)  # pairs that lose too many of their places to others wait for a later round
        if not len(kept):  # the most frequent pair alone
            chosen, kept = np.array([most_frequent]), np.array([0])
            at, rule = _places(pairs, chosen)
        symbol = np.zeros(len(chosen), np.int64)
        symbol[kept] = first + made + np.arange(len(kept))
        new = symbol[rule]
        pair = pairs.pair[chosen[kept]]
        pairs.replace(at[new > 0], new[new > 0])
        rules.append(np.column_stack((pair >> 16, pair & 0xFFFF)).astype(np.uint16))
        made += len(kept)
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16), pairs.seq[~pairs.gone].astype(np.uint16)


def _places(pairs: _Pairs, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chosen groups' pairs stand, ascending, of neighbours, which overlap, every other one; and which group it is."""
    at, rule = pairs.of(chosen)
    order = np.argsort(at)
    at, rule = at[order], rule[order]
    even = pairs.every_other(at)
    return at[even], rule[even]


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule's symbol stands for; a rule's parts come before it."""
    out = [1] * len(rules)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return np.array(out, np.uint32)


def expand(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids of a sequence of symbols."""
    whole = _unrolled(first + np.arange(len(rules)), rules, first)
    size = np.ones(first + len(rules), np.int64)
    size[first:] = expansion_lengths(rules, first)
    start = np.arange(first + len(rules))
    start[first:] = first + np.cumsum(size[first:]) - size[first:]
    table, seq = np.concatenate((np.arange(first), whole)), seq.astype(np.int64)
    many = size[seq]
    return table[np.repeat(start[seq] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]


def _unrolled(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids of a short sequence, which take no table of all rules' ids."""
    while len(at := np.flatnonzero(seq >= first)):
        width = np.ones(len(seq), np.int64)
        width[at] = 2
        to = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        out[to] = seq
        pair = rules[seq[at] - first]
        out[to[at]], out[to[at] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


def to_bytes(ids: np.ndarray, first: int) -> bytes:
    rules, seq = compress(ids, first)
    return MAGIC + struct.pack("<III", first, len(rules), len(seq)) + rules.astype("<u2").tobytes() + expansion_lengths(rules, first).astype("<u4").tobytes() + seq.astype("<u2").tobytes()


def from_bytes(blob: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(first, rules, expansion lengths, sequence)"""
    if blob[:4] != MAGIC:
        raise ValueError("not a block of grammar-compressed ids")
    first, n, m = struct.unpack_from("<III", blob, 4)
    rules = np.frombuffer(blob, "<u2", 2 * n, 16).reshape(n, 2)
    return first, rules, np.frombuffer(blob, "<u4", n, 16 + 4 * n), np.frombuffer(blob, "<u2", m, 16 + 8 * n)


def decode_document(blob: bytes, start: int, length: int) -> np.ndarray:
    """The ids from start on, of a block; only the symbols that hold them are expanded."""
    first, rules, lengths, seq = from_bytes(blob)
    symbols = seq.astype(np.int64)
    width = np.where(symbols >= first, lengths[np.maximum(symbols - first, 0)] if len(lengths) else 1, 1).astype(np.int64)
    ends = np.cumsum(width)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + length, "left") + 1
    skipped = int(ends[a - 1]) if a else 0
    return _unrolled(symbols[a:b], rules, first)[start - skipped : start - skipped + length]


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1) -> None:
    """Writes all documents' ids, each document's followed by the end id, in ascending doc_id; null ids first, equal ids by text."""
    spark = docs.sparkSession
    text = spark.sparkContext.broadcast(vocabulary)
    end = np.array([end_id], "<u2").tobytes()

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, shard, block, start = bpe.loaded(text.value, KEPT_WORDS), TaskContext.get().partitionId(), 0, 0
        first = words.tokenizer.get_vocab_size()
        doc_ids: list = []
        parts: list[bytes] = []
        held = 0

        def done() -> pd.DataFrame:
            return pd.DataFrame({"shard": [shard], "block": [block], "start": [start], "doc_ids": [doc_ids], "lengths": [[len(p) // 2 for p in parts]], "grammar": [to_bytes(np.frombuffer(b"".join(parts), "<u2"), first)]})

        for batch in batches:
            texts = batch["text"].tolist()
            encoded = (x for k in range(0, len(texts), TEXTS) for x in words.encode_all(texts[k : k + TEXTS]))
            for doc_id, x in zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), encoded, strict=True):
                doc_ids.append(doc_id)
                parts.append(x + end)
                held += len(parts[-1]) // 2
                if held >= BLOCK_IDS:
                    yield done()
                    block, start, doc_ids, parts, held = block + 1, start + held, [], [], 0
        if parts:
            yield done()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInPandas(blocks, BLOCK).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """Documents of a folder of such files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(BLOCK).parquet(path)
    totals = sorted((r["shard"], r["n"]) for r in files.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect())  # a row a shard
    base, at = {}, 0
    for shard, n in totals:
        base[shard], at = at, at + n

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                first, rules, _, seq = from_bytes(row.grammar)
                ids = expand(seq, rules, first).astype("<u4")
                n = np.asarray(row.lengths, np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[b - k : b]) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                doc_ids = pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], "Int64")
                yield pd.DataFrame({"doc_id": doc_ids, "start": base[row.shard] + row.start + ends - n, "n_tokens": n, "ids_crc32": crc})

    return files.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Documents as read back from files written to the shared folder.

    Null and empty texts are the end id alone; repeated rows are written as often as they come; extra columns are ignored;
    an empty table gives no rows.
    """
    path = shared_path(docs.sparkSession, "ids")
    write(docs, vocabulary, path, end_id)
    return read(docs.sparkSession, path)
