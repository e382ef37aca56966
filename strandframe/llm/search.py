"""Ranked lexical search of a set of items in all documents by two trees.

A document is a sparse vector of what each term's occurrences are worth in it, an item one of its terms' weights, and a score
their product. Items and each batch of documents are sorted by the term that they owe most to, terms of one item being
neighbours, and halved again and again. A node holds the maximum of each coordinate, so the product of two nodes bounds all scores between their members:
where the bound lies below the weakest k-th score among the node's items, the pair of nodes is dropped whole. All numbers are
integers below 2**53, which doubles hold exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Items, and bytes of their texts, that are searched for together: so much is sent to the executors at a time.
BLOCK_ITEMS, BLOCK_BYTES = 2048, 4 << 20
#: Cells of the dense matrix of a batch of documents, and the least and most documents of one.
CELLS, LEAST_DOCS, MOST_DOCS = 8 << 20, 64, 4096
#: Members of a leaf.
ITEM_LEAF, DOC_LEAF = 4, 32
#: Shares in which the best of all tasks are merged first.
SHARES = 64
VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item int, item_id long, doc_id long, score long"
#: Bytes that end a term become spaces and A-Z small letters; bytes of characters beyond U+007F stay.
FOLDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of digits, letters and characters beyond U+007F, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(FOLDED).split() if text else []


def vectors(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): per document the number of its terms, and how often it holds each of the numbered ones."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            many, held = [], []
            for text in batch["text"]:
                found = terms(text.as_py())
                many.append(len(found))
                held.append(np.unique(np.array([k for k in map(number.get, found) if k is not None], np.int32), return_counts=True))
            ends = np.cumsum([0, *(len(x) for x, _ in held)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *(h[k] for h in held)]).astype(np.int32))) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(many, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, VECTORS)


class Tree:
    """Rows halved down to leaves, those that owe most to the same coordinate side by side. order: the rows by leaf; levels: for each
    depth the bounds of its nodes in `order` and their coordinate maxima."""

    def __init__(self, rows: np.ndarray, leaf: int, weight: np.ndarray | float = 1.0):
        self.order = np.argsort((rows * weight).argmax(1), kind="stable")
        cuts, self.levels = [0, len(rows)], []
        while True:
            self.levels.append((cuts, np.array([rows[self.order[a:b]].max(0) for a, b in zip(cuts, cuts[1:], strict=False)], np.float64)))
            if max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) <= leaf:
                return
            cuts = [0, *(c for a, b in zip(cuts, cuts[1:], strict=False) for c in ((a + b) // 2, b))]

    def level(self, depth: int) -> tuple[list[int], np.ndarray]:
        return self.levels[min(depth, len(self.levels) - 1)]


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.rows = k, [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in range(items)]
        #: Scores below this are of no use to the item; equal ones may still win by a smaller id.
        self.least = np.ones(items)

    def add(self, item: int, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        scores, null, ids = (np.concatenate(p) for p in zip(self.rows[item], (scores, null, ids), strict=True))
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.rows[item] = (scores[order], null[order], ids[order])
        if len(order) == self.k:
            self.least[item] = max(1, scores[order[-1]])


def two_trees(items: Tree, weights: np.ndarray, docs: np.ndarray, null: np.ndarray, ids: np.ndarray, best: Best, weight: np.ndarray | float = 1.0) -> int:
    """Adds what a batch of documents has among the items' best; returns how many pairs of an item and a document were scored."""
    tree, scored = Tree(docs, DOC_LEAF, weight), 0
    depth, pairs = 0, np.zeros((1, 2), np.int64)
    deepest = max(len(items.levels), len(tree.levels)) - 1
    while True:
        (item_cuts, item_maxima), (doc_cuts, doc_maxima) = items.level(depth), tree.level(depth)
        weakest = np.minimum.reduceat(best.least[items.order], item_cuts[:-1]) if depth < len(items.levels) else weakest  # noqa: F821
        bounds = (item_maxima @ doc_maxima.T)[pairs[:, 0], pairs[:, 1]]
        alive = bounds >= weakest[pairs[:, 0]]
        pairs, bounds = pairs[alive], bounds[alive]
        if depth == deepest or not len(pairs):
            break
        # A node's halves follow each other on the next level; a leaf of the shallower tree stays as it is.
        more_items, more_docs = depth + 1 < len(items.levels), depth + 1 < len(tree.levels)
        step = np.array([(i, d) for i in range(1 + more_items) for d in range(1 + more_docs)])
        pairs = (pairs * (1 + more_items, 1 + more_docs))[:, None, :] + step
        pairs = pairs.reshape(-1, 2)
        depth += 1
    for k in np.argsort(-bounds, kind="stable"):
        q, d = pairs[k]
        members = items.order[item_cuts[q] : item_cuts[q + 1]]
        if len(members) == 0 or bounds[k] < best.least[members].min():
            continue
        rows = tree.order[doc_cuts[d] : doc_cuts[d + 1]]
        scores = weights[members] @ docs[rows].astype(np.float64).T
        scored += scores.size
        for item, row in zip(members, scores, strict=True):
            good = row >= best.least[item]
            if good.any():
                best.add(item, row[good].astype(np.int64), null[rows[good]], ids[rows[good]])
    return scored


def _block(docs: DataFrame, items: list, k: int) -> DataFrame | None:
    """FOUND of one block of items: each one's best documents of each task; None where no document has a term."""
    context = docs.sparkSession.sparkContext
    counts = [Counter(terms(r["text"])) for r in items]
    number = {t: j for j, t in enumerate(dict.fromkeys(t for c in counts for t in sorted(c)))}
    held = checkpointed(vectors(docs, number))
    total = held.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not total["terms"] or not number:
        return None
    df = np.zeros(len(number), np.int64)
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many as the block's terms
        df[r["term"]] = r["count"]
    docs_total, terms_total = total["docs"], total["terms"]
    weight = np.array([math.floor(1000 * math.log((2 * docs_total + 2) / (2 * x + 1))) for x in df.tolist()], np.float64)
    weights = np.zeros((len(items), len(number)))
    for i, c in enumerate(counts):
        for t, n in c.items():
            weights[i, number[t]] = n * weight[number[t]]
    shared = context.broadcast((weights, weight.astype(np.float32), [r["item_id"] for r in items]))
    size = max(LEAST_DOCS, min(MOST_DOCS, CELLS // len(number)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, weight, item_ids = shared.value
        tree, best = Tree(weights, ITEM_LEAF), Best(len(item_ids), k)
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                many = [len(x) for x in batch["terms"]]
                row, term = np.repeat(np.arange(batch.num_rows), many), batch["terms"].flatten().to_numpy()
                tf = batch["tfs"].flatten().to_numpy().astype(np.int64)
                m = np.array([25 + 75 * n * docs_total // terms_total for n in batch["n"].to_pylist()], np.int64)
                worth = np.zeros((batch.num_rows, len(weights[0])), np.float32)
                worth[row, term] = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
                null = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
                two_trees(tree, weights, worth, null, batch["doc_id"].fill_null(0).to_numpy(), best, weight)
        many = [len(s) for s, _, _ in best.rows]
        item = np.repeat(np.arange(len(item_ids), dtype=np.int32), many)
        scores, null, ids = (np.concatenate([r[j] for r in best.rows]) for j in range(3))
        names = pa.array([item_ids[i] for i in item], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(item), names, pa.array(ids, mask=null), pa.array(scores)], ["item", "item_id", "doc_id", "score"])

    return held.mapInArrow(find, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest scores above 0, equal ones by ascending doc_id.

    Items are taken in blocks, all documents for each block. Null and empty texts have no terms: as items they find nothing, as
    documents they are not found. Texts of any length are taken whole. Each row of `items` is an item and each row of `docs` a
    document, repeated ones too; null doc_ids come last among equal scores. Extra columns are ignored; an empty table on either side gives no rows.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    docs, found = docs.select("doc_id", "text"), None
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        one = _block(docs, some, k) if some else None
        if one is None:
            continue
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        # Every task gives k rows an item; shares of them are cut to k before one task takes an item's rest.
        one = one.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)))
        one = one.withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).where(F.col("rank") <= k)
        one = one.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        one = one.select("item_id", "rank", "doc_id", "score")
        found = one if found is None else found.unionByName(one)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found
