"""Nearest neighbours by blocks: int8 product tiles with error bounds, then exact products of what survives.

Vectors are scaled to unit length and rounded to 8 bits. The product of two rounded vectors differs from the exact one by no
more than the lengths of what rounding took allow, so each tile of queries by candidates gives every pair a lower and an upper bound.
A pair survives if its upper bound reaches the k-th largest lower bound of its query; survivors are recomputed in double
precision. No pair of the true result is lost. Queries and candidates are both dealt into blocks; a task holds one tile, and
the tiles' best are merged by heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import reuse_freed_memory

#: Rows of a block of queries and of one of candidates, about.
QUERIES, CANDIDATES = 2048, 8192
#: Components of a product that float32 adds without error: 127 * 127 * 1024 < 2**24.
EXACT = 1024
FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, some not zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    return F.coalesce(vector.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit vectors, their scales, lengths of the rounded vectors, lengths of the errors."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of 8-bit vectors."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        out += a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].T.astype(np.float32)
    return out


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest candidates of each query within a tile: (query, candidate, cosine). Ids ascend."""
    # Of equal vectors only the k + 1 smallest ids can be among the k nearest, one of them being perhaps the query itself.
    _, group = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, group))
    first = np.r_[True, np.diff(group[order]) != 0]
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    keep = np.sort(order[np.arange(len(order)) - start <= k])
    ids, vectors = ids[keep], vectors[keep]

    norm_q, norm_v = np.sqrt((queries * queries).sum(1)), np.sqrt((vectors * vectors).sum(1))
    # Very large or small components are brought near 1 before their lengths are taken; scores are of the vectors as they are.
    unit = lambda v: (lambda w: w / np.sqrt((w * w).sum(1))[:, None])(v / np.abs(v).max(1)[:, None])
    q8, scale_q, long_q, lost_q = _rounded(unit(queries))
    v8, scale_v, long_v, lost_v = _rounded(unit(vectors))
    odd_q, odd_v = (~np.isfinite(n) | (n < 1e-150) for n in (norm_q, norm_v))
    out = []
    for a in range(0, len(queries), 256):
        b = slice(a, a + 256)
        near = _products(q8[b], v8) * scale_q[b, None] * scale_v
        error = lost_q[b, None] * long_v + long_q[b, None] * lost_v + lost_q[b, None] * lost_v + 1e-9
        own = query_ids[b, None] == ids
        lower = np.where(own, -np.inf, near - error)
        if lower.shape[1] > k:
            bound = np.partition(lower, -k, axis=1)[:, -k]
        else:
            bound = np.full(len(lower), -np.inf)
        i, j = np.nonzero((near + error >= bound[:, None]) & ~own)
        for c in range(0, len(i), 1 << 16):
            p, r = i[c : c + (1 << 16)] + a, j[c : c + (1 << 16)]
            with np.errstate(all="ignore"):
                score = (queries[p] * vectors[r]).sum(1) / (norm_q[p] * norm_v[r])
            far = np.flatnonzero(odd_q[p] | odd_v[r])  # squares overflow or vanish: of the vectors at unit length instead
            score[far] = (unit(queries[p[far]]) * unit(vectors[r[far]])).sum(1) if len(far) else 0.0
            out.append(pd.DataFrame({"q": query_ids[p], "v": ids[r], "s": score}))
    if not out:
        return []
    found = pd.concat(out).sort_values(["q", "s", "v"], ascending=[True, False, True])
    return list(found.groupby("q", sort=False).head(k).itertuples(index=False, name=None))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest cosines of each query to the other rows; ties go to the smaller id.

    Vectors that are null, empty or all zero, or that have a null or a non-finite component, take no part, nor do rows without
    an id; vectors of different length are not compared. Of rows that repeat an id the one with the smallest vector stands.
    Other columns are ignored. Each candidate is sent once for each block of queries, each query once for each block of candidates.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").alias("v"), is_query.alias("q"))
    n, m = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0))).first()
    by_q, by_v = max(1, -(-m // QUERIES)), max(1, -(-n // CANDIDATES))
    of = lambda blocks, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.where("q").select("vec_id", "v", F.lit(True).alias("q"), of(by_q, 1).alias("bq")).select("*", every(by_v).alias("bv"))
    right = rows.select("vec_id", "v", F.lit(False).alias("q"), of(by_v, 2).alias("bv")).select("*", every(by_q).alias("bq"))

    def best(t: pd.DataFrame) -> pd.DataFrame:
        reuse_freed_memory()
        t = t.assign(n=t["v"].map(len)).sort_values("vec_id", kind="stable")
        again = t.duplicated(["q", "vec_id"], keep=False)
        if again.any():  # only rows that repeat an id are compared component by component
            some = t[again].assign(key=t["v"][again].map(tuple)).sort_values(["vec_id", "key"]).drop_duplicates(["q", "vec_id"])
            t = pd.concat([t[~again], some.drop(columns="key")]).sort_values("vec_id", kind="stable")
        out = []
        for _, same in t.groupby("n"):
            q, v = same[same["q"]], same[~same["q"]]
            if len(q) and len(v):
                out += tile(q["vec_id"].to_numpy(), np.stack(q["v"]).astype(float), v["vec_id"].to_numpy(), np.stack(v["v"]).astype(float), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Heaps of k over rows that come query by query."""
        now, heap = None, []
        done = lambda: pd.DataFrame([(now, r + 1, -v, s) for r, (s, v) in enumerate(sorted(heap, reverse=True))], columns=["query_id", "rank", "vec_id", "score"])
        for b in batches:
            for q, v, s in zip(b["query_id"].tolist(), b["vec_id"].tolist(), b["score"].tolist(), strict=True):
                if q != now:
                    if heap:
                        yield done()
                    now, heap = q, []
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (s, -v))
        if heap:
            yield done()

    tiles = left.unionByName(right).groupBy("bq", "bv").applyInPandas(best, FOUND)
    return tiles.repartition("query_id").sortWithinPartitions("query_id").mapInPandas(merged, "query_id long, rank int, vec_id long, score double")
