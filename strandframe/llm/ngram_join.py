"""Jaccard self-join of documents' word-shingle sets, and the components of its links.

Texts of equal sets form a class, which is joined once. Each class sends its shingles into buckets of the hash range, where
every shingle's frequency (in how many classes it is) is counted, and those that more than one class has come back. A class
that lacks a partner for more shingles than the threshold lets it miss can link with nothing and is done.

A shingle that many classes of one batch of texts have is not listed there: the batch reports its number once, and every class
takes it for as frequent as can be, so a shingle of all texts fills no bucket.

The rest order their shingles from rare to frequent. A set of n that links with another misses at most t = n - ceil(J n) of
its shingles, so a prefix of t + 1 has one that both have. Rare shingles of the prefix are indexed one by one. Frequent ones
fall, by their hash, into parts; the prefix is extended until no choice of t misses can leave fewer than two common shingles
in every part, and pairs of one part's shingles are indexed (``signatures``). Each class is first verified against one class
of each signature that it has (ROUNDS times, by different choices); what that links needs no further look. Of signatures
whose classes still lie in several components, the classes are compared in tiles of bounded size, every pair across
components exactly: first inside of blocks, then, where a group has several blocks and components still, between them. A tile
returns no more links than join its components, so copies are never listed pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, freed_after, join_one, reuse_freed_memory
from ..operators.graph import components
from .shingles import shingle_set

#: Shingles that more classes have are frequent, and are indexed in pairs.
FREQUENT = 64
#: Documents' worth of shingles in a bucket; the most buckets, enough for 30 billion documents; classes of a block of a tile.
BUCKET_DOCS, MOST_BUCKETS, BLOCK_SETS = 8000, 1 << 22, 512
#: Texts whose shingles are dealt together; classes of them from which on a shingle is only reported; bits of a shingle's hash, at most, that are kept beside its bucket.
TEXTS, HOT, KEPT_BITS = 2500, 100, 48
#: The frequency of shingles that are as frequent as can be told.
MOST = 65535
#: Rounds in which each class is verified against one of each of its signatures.
ROUNDS = 1
#: Ids of kept documents up to which they are broadcast, 8 bytes each.
BROADCAST_IDS = 4_000_000
#: Rows of classes that are handed on at once; products of a tile that are counted at once.
ROWS, COUNTED = 500, 1 << 20

# Ids travel as text, so that nulls do not turn them into floating-point numbers; other numbers are never null.
ROW = pa.schema([("at", pa.int32()), ("doc", pa.string()), ("n", pa.int32()), ("key", pa.int64()), ("part", pa.binary())])
ROW_DDL = "at int, doc string, n int, key long, part binary"
CHOSEN = pa.schema([("doc", pa.string()), ("n", pa.int32()), ("key", pa.int64()), ("signatures", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64()))])
CHOSEN_DDL = "doc string, n int, key long, signatures array<long>, shared array<long>"
CHOSEN_BY = np.uint64(0x9E3779B97F4A7C15)


def misses(n: int, percent: int) -> int:
    """Shingles of a set of n that a partner may lack."""
    return n - -(-percent * n // 100)


# A part of a message: for each class its key (8 bytes), set size (4), shingles here (4); then all shingles' hashes, 6 bytes each,
# as the rest is the bucket's number; or 8 bytes each and 2 for how many classes have the shingle.
def _pack(keys: np.ndarray, sizes: np.ndarray, many: np.ndarray, values: np.ndarray, frequency: np.ndarray | None) -> bytes:
    head = np.array([len(keys), len(values), frequency is not None], "<i8").tobytes() + keys.astype("<u8").tobytes() + sizes.astype("<i4").tobytes() + many.astype("<i4").tobytes()
    if frequency is not None:
        return head + values.astype("<u8").tobytes() + frequency.astype("<u2").tobytes()
    return head + (values & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (values >> np.uint64(32) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _unpack(bucket: int, blob: bytes, kept: int = KEPT_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k, v, whole = np.frombuffer(blob, "<i8", 3).tolist()
    kinds = [("<u8", k), ("<i4", k), ("<i4", k)] + ([("<u8", v), ("<u2", v)] if whole else [("<u4", v), ("<u2", v)])
    out, at = [], 24
    for kind, n in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    if whole:
        return tuple(out)
    values = np.uint64(bucket << kept) | out[4].astype(np.uint64) << np.uint64(32) | out[3]
    return *out[:3], values, np.zeros(0, "<u2")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _messages(to: np.ndarray, owner: np.ndarray, keys: np.ndarray, sizes: np.ndarray, values: np.ndarray, frequency: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """Values dealt to their buckets, each bucket's grouped by the class that owns them. owner ascends."""
    order = np.argsort(to, kind="stable")
    to, owner, values = to[order], owner[order], values[order]
    frequency = None if frequency is None else frequency[order]
    starts = np.flatnonzero(np.diff(to, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(to)), strict=True):
        of, many = np.unique(owner[a:b], return_counts=True)
        yield int(to[a]), _pack(keys[of], sizes[of], many, values[a:b], None if frequency is None else frequency[a:b])


def signatures(n: int, alone: int, values: np.ndarray, frequency: np.ndarray, percent: int, frequent: int = FREQUENT) -> np.ndarray:
    """Index entries of a set of n shingles, of which `alone` are in no other set and the rest are given with their frequency."""
    left = misses(n, percent) + 1 - alone
    order = np.lexsort((values, frequency))
    values, frequency = values[order], frequency[order]
    rare = values[frequency <= frequent]
    out = [rare[:left]]
    left -= len(rare)
    if left > 0:
        common = values[len(rare) :]
        low, high = -(-percent * n // 100), 100 * n // percent
        for band in range(int(math.log2(max(low, 1))), int(math.log2(high)) + 1):  # sizes of partners may fall into two bands
            parts = 1 << max(0, band - 5)
            part = (common * CHOSEN_BY >> np.uint64(40)).astype(np.int64) % parts
            # Each shingle of a part but its first stands for one miss that the part outlasts.
            rank = _ranks(part)
            enough = np.searchsorted(np.cumsum(rank > 0), left) + 1
            for p in range(parts):
                s = common[:enough][part[:enough] == p]
                i, j = np.triu_indices(len(s), 1)
                with np.errstate(over="ignore"):
                    out.append((np.minimum(s[i], s[j]) * CHOSEN_BY + np.maximum(s[i], s[j])) ^ np.uint64(band + 1) * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.unique(np.concatenate(out))


def _times(values: np.ndarray) -> np.ndarray:
    """How often each element comes."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    starts = np.flatnonzero(np.append(len(v) > 0, v[1:] != v[:-1])[: len(v)])
    times = np.diff(np.append(starts, len(v))).astype(np.int32)
    out = np.empty(len(v), np.int32)
    out[order] = np.repeat(times, times)
    return out


def _often(values: np.ndarray, least: int) -> np.ndarray:
    """The values that come `least` times, ascending."""
    v = np.sort(values)
    return np.unique(v[least - 1 :][v[least - 1 :] == v[: max(len(v) - least + 1, 0)]])


def _ranks(part: np.ndarray) -> np.ndarray:
    """How many earlier elements equal each."""
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.diff(part[order], prepend=-1))
    rank = np.empty(len(part), np.int64)
    rank[order] = np.arange(len(part)) - np.repeat(starts, np.diff(np.append(starts, len(part))))
    return rank


def candidates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """CHOSEN rows: one a document (doc, n, key), and one a class that may link (n, key, its signatures and shared shingles)."""
    n_docs = docs.count()
    buckets = min(MOST_BUCKETS, 1 << max(6, math.ceil(math.log2(max(n_docs, 1) / BUCKET_DOCS + 1))))
    kept = min(KEPT_BITS, 64 - int(math.log2(buckets)))
    shift = np.uint64(64 - kept - int(math.log2(buckets)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed_memory()
        seen: set[int] = set()
        for b in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
            rows, keys, sets = [], [], []
            for doc, text in zip(b["doc"].to_pylist(), b["text"], strict=True):
                s = shingle_set(text.as_py(), words)
                key = xxhash.xxh64_intdigest(s.tobytes())
                rows.append((key % buckets, doc, len(s), key - (1 << 64) if key >> 63 else key, None))
                if key not in seen and 100 * len(s) >= percent * (len(s) + 1):
                    seen.add(key)  # smaller sets link with equal ones alone
                    keys.append(key)
                    sets.append(s)
            if sets:
                sizes, keys = np.array([len(s) for s in sets]), np.array(keys, np.uint64)
                values, owner = np.concatenate(sets) >> shift, np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
                sets.clear()
                reported = _often(values, HOT)
                if len(reported):  # straight to their classes; to the bucket, once, under a class of no shingles
                    hot = np.isin(values, reported)
                    to = (keys % np.uint64(buckets)).astype(np.int32)[owner[hot]]
                    rows += [(at, None, 0, 0, part) for at, part in _messages(to, owner[hot], keys, sizes, values[hot], np.full(hot.sum(), MOST, np.int32))]
                    none = np.zeros(len(reported), np.int32)
                    rows += [(-1 - to, None, 0, 0, part) for to, part in _messages((reported >> np.uint64(kept)).astype(np.int32), none, np.zeros(1, np.uint64), np.zeros(1, np.int64), reported)]
                    values, owner = values[~hot], owner[~hot]
                rows += [(-1 - to, None, 0, 0, part) for to, part in _messages((values >> np.uint64(kept)).astype(np.int32), owner, keys, sizes, values)]
            yield _batch(rows, ROW)

    def by_bucket(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
        """Documents' rows as they are, then work's rows from the parts of each bucket; buckets come one after another."""
        now, parts = None, []
        for b in batches:
            plain = b["part"].is_null()
            if plain.true_count:
                yield from work(None, b.filter(plain))
            at, part = b["at"].to_numpy(), b["part"]
            for k in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist():
                if at[k] != now:
                    if parts:
                        yield from work(now, parts)
                    now, parts = int(at[k]), []
                parts.append(part[k].as_buffer())  # of the batch, not a copy
        if parts:
            yield from work(now, parts)

    def counted(now: int | None, parts) -> Iterator[pa.RecordBatch]:
        """Buckets of shingles have numbers below 0; what goes to a class's bucket already passes."""
        if now is None:
            yield parts
            return
        if now >= 0:
            yield _batch([(now, None, 0, 0, part.to_pybytes()) for part in parts], ROW)
            return
        keys, sizes, many, values, _ = (np.concatenate(x) for x in zip(*(_unpack(-1 - now, p, kept) for p in parts), strict=True))
        # Shingles under a class of size 0 are reports. A class that several tasks sent counts once.
        reported = np.unique(values[np.repeat(sizes == 0, many)])
        if len(reported):
            values = values[np.repeat(sizes > 0, many)]
            keys, sizes, many = keys[sizes > 0], sizes[sizes > 0], many[sizes > 0]
        unique, first, owner = np.unique(keys, return_index=True, return_inverse=True)
        owner = np.repeat(owner.astype(np.int32), many)
        if len(unique) < len(keys):
            sent = np.zeros(len(keys), bool)
            sent[first] = True
            use = np.repeat(sent, many)
            owner, values = owner[use], values[use]
        frequency = np.minimum(_times(values), MOST)
        frequency[np.isin(values, reported)] = MOST
        shared = frequency > 1
        if shared.any():
            owner, values, frequency = owner[shared], values[shared], frequency[shared]
            order = np.argsort(owner, kind="stable")
            owner, values, frequency = owner[order], values[order], frequency[order]
            to = (unique % np.uint64(buckets)).astype(np.int32)[owner]
            yield _batch([(at, None, 0, 0, part) for at, part in _messages(to, owner, unique, sizes[first], values, frequency)], ROW)

    def chosen(now: int | None, parts) -> Iterator[pa.RecordBatch]:
        if now is None:
            none = pa.nulls(parts.num_rows, CHOSEN.field("shared").type)
            yield pa.RecordBatch.from_arrays([parts["doc"], parts["n"], parts["key"], none, none], schema=CHOSEN)
            return
        keys, sizes, many, values, frequency = (np.concatenate(x) for x in zip(*(_unpack(now, p) for p in parts), strict=True))
        unique, first, owner = np.unique(keys, return_index=True, return_inverse=True)
        sizes, owner = sizes[first], np.repeat(owner.astype(np.int32), many)
        order = np.lexsort((values, owner))
        owner, values, frequency = owner[order], values[order], frequency[order]
        again = (owner[1:] == owner[:-1]) & (values[1:] == values[:-1])  # reported by a batch and listed, or reported by several
        once = np.append(True, ~again)[: len(owner)]
        owner, values, frequency = owner[once], values[once], frequency[once]
        total = np.bincount(owner, minlength=len(unique))
        may = sizes - total <= np.array([misses(n, percent) for n in sizes.tolist()])
        use = may[owner]
        values, frequency = values[use], frequency[use]
        ends = np.cumsum(np.where(may, total, 0))
        rows = []
        for k in np.flatnonzero(may).tolist():
            a, b = int(ends[k] - total[k]), int(ends[k])
            found = signatures(int(sizes[k]), int(sizes[k] - total[k]), values[a:b], frequency[a:b], percent)
            rows.append((None, int(sizes[k]), int(unique[k : k + 1].view(np.int64)[0]), found.view(np.int64), values[a:b].view(np.int64)))
            if len(rows) == ROWS:
                yield _batch(rows, CHOSEN)
                rows = []
        if rows:
            yield _batch(rows, CHOSEN)

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = docs.select(F.col("doc_id").cast("string").alias("doc"), "text").mapInArrow(lambda x: freed_after(deal(x)), ROW_DDL)
    back = dealt.repartition(tasks, "at").sortWithinPartitions("at").mapInArrow(lambda x: freed_after(by_bucket(x, counted)), ROW_DDL)
    return back.repartition(tasks, "at").sortWithinPartitions("at").mapInArrow(lambda x: freed_after(by_bucket(x, chosen)), CHOSEN_DDL)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs (a, b) of 0..n-1 first join two components."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            keep[k] = True
    return keep


def linked(sizes: np.ndarray, many: np.ndarray, values: np.ndarray, label: np.ndarray, block: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of different labels whose Jaccard similarity reaches the threshold, as far as they join components: pairs
    across the two blocks, or all pairs where there is one block. values: the sets' shared shingles one after another, `many` of each."""
    n = len(sizes)
    owner = np.repeat(np.arange(n, dtype=np.int32 if n * n < 1 << 31 else np.int64), many)
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    times = np.diff(np.append(starts, len(v)))
    starts, times = starts[times > 1], times[times > 1]
    common = np.zeros((n, n), np.int32)
    for t in np.unique(times).tolist():  # all shingles that t sets have
        members = o[starts[times == t][:, None] + np.arange(t)]  # ascending
        i, j = np.triu_indices(t, 1)
        step = max(1, COUNTED // len(i))
        for c in range(0, len(members), step):
            pair = members[c : c + step][:, i]
            pair *= n
            pair += members[c : c + step][:, j]
            common += np.bincount(pair.ravel(), minlength=n * n).reshape(n, n)
    a, b = np.nonzero(100 * common.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - common))
    use = (a < b) & (label[a] != label[b])
    if (block != block[0]).any():
        use &= block[a] != block[b]
    a, b = a[use], b[use]
    labels, of = np.unique(label, return_inverse=True)
    keep = _forest(of[a], of[b], len(labels))  # sets of one label are joined already
    return a[keep], b[keep]


def _shared_signatures(sets: DataFrame) -> DataFrame:
    """(key, signature) of signatures that several classes have; of those that the same classes have, one."""
    index = sets.select("key", F.explode("signatures").alias("signature"))
    # Classes are summed up by their number and two sums of their hashes.
    of = index.groupBy("signature").agg(F.count(F.lit(1)).alias("classes"), F.bit_xor("key").alias("x"), F.bit_xor(F.xxhash64("key", F.lit(43))).alias("y")).where("classes > 1")
    once = of.groupBy("classes", "x", "y").agg(F.min("signature").alias("signature")).select("signature")
    return checkpointed(join_one(index, once, "signature", by="key").select("key", "signature"))


def _labelled(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """rows with the label of their key's component, which is its own key until it has links."""
    if found is None:
        return rows.withColumn("label", F.col("key"))
    return rows.join(found.select(F.col("node").alias("key"), F.col("label").alias("__l")), "key", "left").withColumn("label", F.coalesce("__l", "key")).drop("__l")


def _verified(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), one of each a, whose sets' similarity reaches the threshold."""
    side = lambda c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("shared").alias(f"s{c}"))
    seconds = side("b").join(near.select("b").distinct(), "b", "left_semi")
    both = join_one(near.join(side("a"), "a"), seconds, "b", by="a").withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _groups(index: DataFrame) -> DataFrame:
    """(level, tile, key, label, blocks): classes of the signatures that are still open, put together so that all pairs of a signature meet.

    Signatures that share classes make a group. A group that fits one tile, or has no more pairs than its signatures have all
    in all, is put together as a whole, so that each of its pairs meets once, not once for each signature of both. In others small signatures are
    taken by themselves, and the larger ones are grouped anew without them.
    """
    out, small, level = None, 1, 0
    while True:
        first = index.groupBy("signature").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("size"))
        index = checkpointed(join_one(index, first, "signature", by="key"))
        groups = components(index.where("key <> b").select(F.col("key").alias("a"), "b"))
        index = join_one(index, groups.select(F.col("node").alias("b"), F.col("label").alias("tile")), "b", by="key")
        # Each class of a signature counts its size, which makes its square in all.
        classes = index.groupBy("tile", "key").agg(F.sum("size").alias("pairs")).groupBy("tile").agg(F.count(F.lit(1)).alias("classes"), F.sum("pairs").alias("pairs"))
        index = checkpointed(join_one(index, classes, "tile", by="key"))
        whole = (F.col("classes") <= BLOCK_SETS) | (F.col("classes") * F.col("classes") <= F.col("pairs"))
        blocks = lambda n: F.ceil(F.col(n) / BLOCK_SETS).cast("int").alias("blocks")
        dealt = index.where(whole).select(F.lit(level).alias("level"), "tile", "key", "label", blocks("classes")).distinct()
        out = dealt if out is None else out.unionByName(dealt)
        rest, small = index.where(~whole), small * 8
        if rest.isEmpty():
            return out
        alone = F.col("size") <= small if small < BLOCK_SETS else F.lit(True)
        out = out.unionByName(rest.where(alone).select(F.lit(level + 1).alias("level"), F.col("signature").alias("tile"), "key", "label", blocks("size")))
        index, level = rest.where(~alone).select("key", "signature", "label"), level + 2
        if index.isEmpty():
            return out


def _tiles(sets: DataFrame, groups: DataFrame, across: bool) -> DataFrame:
    """(level, tile, i, j, key, n, shared, label, block): groups in blocks of bounded size, each block by itself or each with each other."""
    rows = groups.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    if across:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
    else:
        rows = rows.withColumn("other", F.col("block"))
    rows = rows.select("level", "tile", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "label", "block")
    return rows.join(sets.select("key", "n", "shared"), "key")


def links(chosen: DataFrame, percent: int) -> DataFrame:
    """(node, label): the components of the links between classes."""
    sets = chosen.where(F.col("shared").isNotNull()).select("key", "n", "shared", "signatures")
    index = _shared_signatures(sets)
    pairs, found = None, None
    for r in range(ROUNDS):
        open_ = _labelled(index, found)
        order = F.xxhash64("key", F.lit(61 + r))
        pivot = open_.groupBy("signature").agg(F.min(F.struct(order.alias("o"), "key", "label")).alias("p"))
        near = join_one(open_, pivot, "signature", by="key").where(F.col("label") != F.col("p.label"))
        near = near.groupBy(F.col("key").alias("a")).agg(F.min("p").alias("p")).select("a", F.col("p.key").alias("b"))
        got = checkpointed(_verified(near, sets, percent))
        pairs = got if pairs is None else pairs.unionByName(got)
        found = components(pairs)

    open_ = _labelled(index, found)
    several = open_.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("signature")
    groups = checkpointed(_groups(checkpointed(join_one(open_, several, "signature", by="key").select("key", "signature", "label"))))

    at = ["level", "tile", "i", "j"]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tiles come one after another."""
        now, held = None, []

        def done() -> pd.DataFrame:
            key, n, shared, label, block = zip(*held, strict=True)
            a, b = linked(np.array(n, np.int64), np.array([len(s) for s in shared]), np.concatenate(shared), np.array(label), np.array(block), percent)
            key = np.array(key)
            return pd.DataFrame({"a": key[a], "b": key[b]})

        for t in batches:
            for level, tile, i, j, key, n, shared, label, block in t[[*at, "key", "n", "shared", "label", "block"]].itertuples(index=False):
                if (level, tile, i, j) != now:
                    if len(held) > 1:
                        yield done()
                    now, held = (level, tile, i, j), []
                held.append((key, n, np.asarray(shared), label, block))
        if len(held) > 1:
            yield done()

    tasks = max(int(chosen.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def verified(groups: DataFrame, across: bool) -> DataFrame:
        return _tiles(sets, groups, across).repartition(tasks, *at).sortWithinPartitions(*at).mapInPandas(lambda x: freed_after(verify(x)), "a long, b long")

    found = components(pairs.unionByName(verified(groups, False)))
    # What blocks have joined needs no further look between them.
    large = checkpointed(_labelled(groups.where("blocks > 1").drop("label"), found).withColumn("group", F.struct("level", "tile")))
    several = large.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("group")
    large = checkpointed(join_one(large, several, "group", by="key").drop("group"))
    if large.isEmpty():
        return found
    return components(found.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(verified(large, True)))


def join(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, of each document.

    Null texts and texts without a word have no shingles and link with nothing, not even each other; texts of fewer words
    than a shingle are one shingle. Equal sets are linked. Repeated rows give repeated rows; a null doc_id is never a
    component's id unless it stands alone. Extra columns are ignored; an empty table gives no rows.
    """
    chosen = checkpointed(candidates(docs, words, percent))
    rows = chosen.where(F.col("shared").isNull()).select(F.col("doc").cast("long").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "key")
    found = links(chosen, percent)
    classes = rows.where(F.col("n_shingles") > 0).groupBy("key").agg(F.min("doc_id").alias("first"))
    # Only classes with links meet their component's smallest id; of a large component in several tasks.
    several = checkpointed(classes.join(found.select(F.col("node").alias("key"), "label"), "key"))
    smallest = several.groupBy("label").agg(F.min("first").alias("least"))
    several = join_one(several, smallest, "label", by="key").select("key", "least")
    classes = classes.join(several, "key", "left").select("key", F.coalesce("least", "first").alias("component_id"))
    rows = rows.join(classes, "key", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, that of the smallest id; of rows that repeat its id, one.

    Texts without a word are kept, and so are rows without an id, which nothing tells apart.
    """
    found = checkpointed(join(docs, words, percent))
    keep = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    n, repeated = keep.agg(F.count(F.lit(1)), F.count(F.when(F.col("rows") > 1, 1))).first()
    once = keep.where(F.col("rows") == 1).select("doc_id")
    kept = docs.where(F.col("doc_id").isNull()).unionByName(docs.join(F.broadcast(once) if n <= BROADCAST_IDS else once, "doc_id", "left_semi").select(*docs.columns))
    if repeated:
        again = docs.join(keep.where(F.col("rows") > 1).select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
        kept = kept.unionByName(again.dropDuplicates(["doc_id"]))
    return kept
