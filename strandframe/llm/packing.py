"""Best-fit packing of documents into sequences of a fixed number of tokens.

Items of equal length are alike, and so are bins of equal remaining capacity. Best-fit decreasing over the whole corpus
is therefore worked out on counts: a histogram of lengths (at most ``capacity`` rows) goes to the driver, a segment tree
over remaining capacities finds the tightest open bins for each length in logarithmic time, and runs of equal placements
come back. Each piece finds its place from its rank among those of its length. The result is that of best-fit decreasing
over all items, wherever they are stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import checkpointed

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


class Tightest:
    """A segment tree over remaining capacities 0..n: how many open bins have each, and the least one of at least some length."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.tree = [False] * (2 * self.size)

    def put(self, capacity: int, there: bool) -> None:
        k = capacity + self.size
        self.tree[k] = there
        while k > 1:
            k //= 2
            self.tree[k] = self.tree[2 * k] or self.tree[2 * k + 1]

    def find(self, length: int) -> int | None:
        """The least capacity of an open bin that is at least length."""
        k = length + self.size
        if self.tree[k]:
            return length
        while k > 1:  # up to where a right sibling has an open bin, then down by its left side
            if k % 2 == 0 and self.tree[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.tree[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs of placements and the number of bins.

    A run (length, first rank, items, first bin, items a bin, offset) puts items of a length, by rank, into consecutive bins,
    so many in each, from an offset on.
    """
    tree, open_bins, runs, bins = Tightest(capacity), {}, [], 0  # open_bins: remaining capacity to [(first bin, bins)]
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if (room := tree.find(length)) is None:
                room, each = capacity, capacity // length
                first, many, bins = bins, -(-left // each), bins - (-left // each)
            else:
                first, many = open_bins[room].pop()
                if not open_bins[room]:
                    tree.put(room, False)
                each = room // length
            full = min(many, left // each)
            for k, a, b in ((each, first, full), (left % each if full < many and full == left // each else 0, first + full, 1)):
                if k and b:  # the second of these is one bin that takes fewer
                    runs.append((length, rank, k * b, a, k, capacity - room))
                    rank, left = rank + k * b, left - k * b
                    open_bins.setdefault(room - k * length, []).append((a, b))
                    tree.put(room - k * length, True)
                    first, many = a + b, first + many - a - b
            if many:
                open_bins.setdefault(room, []).append((first, many))
                tree.put(room, True)
    return np.array(runs, np.int64).reshape(-1, 6), bins


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits; else whole sequences, after a first piece that takes the rest."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of all documents, with the task that made each and its place among that task's pieces of its length."""
    text = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen, task = bpe.loaded(text.value), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            rows = []
            for doc_id, x in zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), batch["text"], strict=True):
                ids = np.frombuffer(words.encode(x) + end, "<u2").astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, start, n, zlib.crc32(ids[start : start + n]), task, seen[n]))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(make, PIECE)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    Null and empty texts are the end id alone; longer documents than a sequence are cut, others never. Repeated rows are
    packed as often as they come, extra columns are ignored, an empty table gives no rows.
    """
    made = checkpointed(pieces(docs, vocabulary, capacity, end_id))  # ranks must not change between the two readings below
    by_task = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    runs, _ = best_fit_decreasing(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shift = 48  # ranks stay below 2**48
    plan = made.sparkSession.sparkContext.broadcast((runs, (runs[:, 0] << shift) + runs[:, 1]))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, keys = plan.value
        for b in batches:
            rank = b["base"].to_numpy(np.int64) + b["place"].to_numpy(np.int64)
            length = b["length"].to_numpy(np.int64)
            r = runs[np.searchsorted(keys, (length << shift) + rank, "right") - 1]
            k = rank - r[:, 1]
            yield b.drop(columns=["task", "place", "base"]).assign(sequence_id=r[:, 3] + k // np.maximum(r[:, 4], 1), offset=r[:, 5] + k % np.maximum(r[:, 4], 1) * length)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return made.join(bases, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", "task", "place", "base").mapInPandas(place, schema)
