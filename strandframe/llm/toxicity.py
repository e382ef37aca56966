"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, pairs of neighbouring words and pairs with one word between, each hashed to
2**BITS coordinates; a word also counts by its first STEM letters, so that its inflected forms share a weight. Every coordinate has its own learning rate; L1 leaves most weights at nothing, so the model is the
sorted coordinates and weights of the rest, and its broadcast holds no more than the coordinates seen in training.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, fresh, held, reuse_freed_memory

BITS = 22
STEM = 4
#: Labelled documents learned from, at most about so many (each is taken with the same chance, by a hash of its id).
SAMPLE = 40_000
#: Rate, its softening, L1, L2 of FTRL-proximal; passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 6.0, 1.0, 5
TOKEN = re.compile(r"[^\W_]+")
KEPT_WORDS = 300_000
#: The coordinate that every text has, and its weight where there are no labels.
BIAS, UNLEARNED = 0, -1.0

class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return h


def features(text: str | None) -> np.ndarray:
    """Distinct coordinates of a text, ascending; the first is the bias, which every text has."""
    if not text:
        return np.zeros(1, np.uint32)
    words = TOKEN.findall(text.lower())
    hashes = held("toxicity", _Hashes)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    stems = np.fromiter((hashes[w[:STEM]] for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        parts = [h * np.uint64(0x9E3779B97F4A7C15), stems * np.uint64(0xD6E8FEB86659FD93)]
        if len(h) > 1:
            parts.append(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] * np.uint64(0x165667B19E3779F9))
        if len(h) > 2:
            parts.append(h[:-2] * np.uint64(0x27D4EB2F165667C5) + h[2:] * np.uint64(0x85EBCA77C2B2AE63))
    x = np.concatenate(parts) >> np.uint64(64 - BITS)
    x[x == BIAS] = 1
    x = np.unique(x.astype(np.uint32))
    return np.concatenate((np.zeros(1, np.uint32), x))


@dataclass
class Model:
    """Coordinates that have a weight, ascending, and their weights."""

    at: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weight
        return out


def ftrl(rows: list[np.ndarray], labels: np.ndarray, passes: int = PASSES) -> Model:
    """The model after so many passes over the rows, in their order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(x: np.ndarray) -> np.ndarray:
        zx = z[x]
        l1 = np.where(x == BIAS, 0.0, L1)
        return np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((BETA + np.sqrt(n[x])) / ALPHA + L2))

    for _ in range(passes):
        for x, y in zip(rows, labels, strict=True):
            w = weights(x)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            z[x] += g - sigma * w
            n[x] += g * g
    at = np.flatnonzero(n).astype(np.uint32)
    w = weights(at)
    return Model(at[w != 0], w[w != 0].astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """Learns from whole texts of labelled documents for whose id learn holds; rows with a null id, text or label teach nothing.

    A document that is labelled twice counts once, as toxic if either label says so. The sample is learned from in one task.
    """
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = max(labels.count(), 1)
    share = int(min(1.0, sample / n) * 2**31)
    order = F.abs(F.hash("doc_id", F.lit(17)).cast("long"))
    chosen = labels.where(order <= share)  # about `sample` ids, of 12 bytes each
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"turn": b["turn"], "x": [features(t).tobytes() for t in b["text"]], "toxic": b["toxic"]})

    def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, y = [], []
        for b in batches:
            rows += [np.frombuffer(x, np.uint32) for x in b["x"]]
            y += b["toxic"].tolist()
        m = ftrl(rows, np.array(y, float))
        yield pd.DataFrame({"at": [m.at.tobytes()], "weight": [m.weight.tobytes()]})

    rows = texts.select(F.xxhash64("doc_id", "text").alias("turn"), "text", F.col("toxic").cast("int").alias("toxic")).mapInPandas(featurize, "turn long, x binary, toxic int")
    got = rows.repartition(1).sortWithinPartitions("turn").mapInPandas(learned, "at binary, weight binary").collect()
    if not got:  # nothing learned: no text is toxic
        return Model(np.zeros(1, np.uint32), np.array([UNLEARNED], np.float32))
    return Model(np.frombuffer(got[0]["at"], np.uint32), np.frombuffer(got[0]["weight"], np.float32))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with a column of the chance that a text is toxic. Null and empty texts get that of the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop(out).schema.add(out, "double")

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reuse_freed_memory()
        w = shared.value.dense()
        for b in batches:
            s = np.array([w[features(t)].sum(dtype=np.float64) for t in b["text"]])
            yield b.assign(**{out: 1 / (1 + np.exp(-np.clip(s, -35, 35)))})

    return docs.drop(out).mapInPandas(scored, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; fold 0 of the ids teaches nothing.

    Repeated rows give repeated rows; with no labels at all every score is below 0.5; extra columns are ignored.
    """
    model = train(docs, labels, fold("doc_id", folds) != 0)
    rows = score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those that score as toxic, in their own columns, whatever those are called.

    Null and empty texts have the score of the bias alone, which is that of a clean text; repeated rows stay or go together; an
    empty table stays empty.
    """
    model = train(docs, labels, fold("doc_id", 5) != 0)
    (made,) = fresh(docs, "toxic_score")
    return score(docs, model, made).where(F.col(made) < threshold).select(*docs.columns)
