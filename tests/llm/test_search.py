"""Ranked search against scores worked out one by one."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strandframe.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    split = [(d, Counter(plain_terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in split if c), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for d, c in split:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        for rank, (s, null, d) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, None if null else d, -s] += 1
    return out


def test_search(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    odd = [(90_000, None), (90_001, ""), (90_002, "--- !?"), (None, items[0][1]), (90_003, items[0][1]), (90_003, items[0][1]), (90_004, "É " + items[1][1].upper() * 300)]
    more = [(500, None), (501, ""), (502, "zzzznothing"), (None, items[2][1]), (500, items[3][1])]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS item")
    i = spark.createDataFrame(items + more, "item_id long, text string").selectExpr("*", "2 AS n", "3 AS doc_id")
    assert Counter(tuple(r) for r in search.search(d, i).collect()) == plain(docs + odd, items + more)


def test_blocks_and_empty_tables(spark, monkeypatch):
    random.seed(8)
    words = [f"w{k}" for k in range(30)] + ["ÄÖ", "x_y", "A1"]
    docs = [(k, " ".join(random.choices(words, k=random.randint(0, 12)))) for k in range(700)]
    items = [(k, " ".join(random.choices(words, k=random.randint(0, 6)))) for k in range(25)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(search, "BLOCK_ITEMS", 9)
    assert Counter(tuple(r) for r in search.search(d, i, 4).collect()) == plain(docs, items, 4)
    assert search.search(d.limit(0), i).count() == search.search(d, i.limit(0)).count() == search.search(d.where("text = ''"), i).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_two_trees_drop_no_winner(seed):
    rng = np.random.default_rng(seed)
    n_items, n_docs, n_terms, k = (int(rng.integers(1, m)) for m in (40, 900, 25, 12))
    weights = (rng.integers(0, 9000, (n_items, n_terms)) * (rng.random((n_items, n_terms)) < 0.3)).astype(float)
    docs = (rng.integers(0, 900_000, (n_docs, n_terms)) * (rng.random((n_docs, n_terms)) < 0.2)).astype(np.float32)
    docs[n_docs // 2 :] = docs[: n_docs - n_docs // 2]  # ties
    ids, null, best = np.arange(n_docs), np.zeros(n_docs, bool), search.Best(n_items, k)
    for a in range(0, n_docs, 300):
        search.two_trees(search.Tree(weights, search.ITEM_LEAF), weights, docs[a : a + 300], null[a : a + 300], ids[a : a + 300], best)
    scores = (weights @ docs.astype(float).T).astype(np.int64)
    for item in range(n_items):
        want = [(int(scores[item, d]), int(d)) for d in np.lexsort((ids, -scores[item]))[:k] if scores[item, d] > 0]
        assert list(zip(best.rows[item][0].tolist(), best.rows[item][2].tolist(), strict=True)) == want


def test_two_trees_leave_most_pairs_out():
    rng = np.random.default_rng(3)
    weights, docs = np.zeros((64, 640)), np.zeros((2048, 640), np.float32)
    for j in range(64):
        weights[j, 10 * j : 10 * j + 10] = rng.integers(1000, 9000, 10)
    for d in range(2048):
        docs[d, 10 * (d % 64) + rng.integers(0, 10, 5)] = 500_000
    best = search.Best(64, 5)
    scored = search.two_trees(search.Tree(weights, search.ITEM_LEAF), weights, docs, np.zeros(2048, bool), np.arange(2048), best)
    assert scored < 64 * 2048 / 4
