"""k-mers of sequences as numbers of two bits a base, the smaller of each and its reverse complement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bases of a sequence that one row holds while its k-mers are listed.
STRETCH = 1 << 20
#: Bases that one row brings to Python, k-mers that a task sorts at a time, and the bits of a k-mer's hash that name its share.
PIECE, SORTED, SHARE_BITS = 1 << 16, 1 << 22, 12
#: Codes of bytes: A, C, G, T of either case; 4 for all others.
CODES = np.full(256, 4, np.uint8)
for _x, _pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
    CODES[list(_pair.encode())] = _x


def canonical_kmers(sequences: DataFrame, k: int, by: list[str], seq: str = "seq") -> DataFrame:
    """(by, kmer): one row for each k bases in a row, A, C, G and T as 0 to 3, the first base highest; k at most 31. Small letters count as
    capitals; k-mers with any other letter are left out, and sequences that are null or shorter than k have none."""
    if not 1 <= k <= 31:
        raise ValueError("k must be 1 to 31: two bits a base in 64")
    stretch = sequences.select(*by, F.translate(seq, "acgt", "ACGT").alias("__s")).where(F.length("__s") >= k)
    # Stretches overlap by k - 1 bases, so each k-mer lies in one of them alone.
    stretch = stretch.select(*by, F.explode(F.sequence(F.lit(1), F.length("__s") - (k - 1), F.lit(STRETCH))).alias("__at"), "__s")
    stretch = stretch.select(*by, F.substring("__s", F.col("__at"), F.lit(STRETCH + k - 1)).alias("__s"))
    word = stretch.select(*by, "__s", F.explode(F.sequence(F.lit(1), F.length("__s") - (k - 1))).alias("__at")).select(*by, F.substring("__s", F.col("__at"), F.lit(k)).alias("__w"))
    word = word.where(~F.col("__w").rlike("[^ACGT]"))
    number = lambda text, digits: F.conv(F.translate(text, "ACGT", digits), 4, 10).cast("long")
    return word.select(*by, F.least(number(F.col("__w"), "0123"), number(F.reverse("__w"), "3210")).alias("kmer"))


def venn(kmers: DataFrame, samples: list, by: str = "sample") -> DataFrame:
    """(mask, n): how many distinct k-mers each set of samples has and no other; bit j of the mask is the j-th sample."""
    bit = F.coalesce(*[F.when(F.col(by) == s, F.lit(1 << j)) for j, s in enumerate(samples)], F.lit(0))
    masks = kmers.withColumn("__m", bit).where("__m > 0").groupBy("kmer").agg(F.bit_or("__m").alias("mask"))
    return masks.groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


def numbered(text: bytes, k: int) -> np.ndarray:
    """The canonical k-mers of a text in order, as canonical_kmers numbers them; those with another letter are left out."""
    code = CODES[np.frombuffer(text, np.uint8)]
    if len(code) < k:
        return np.empty(0, np.uint64)
    other = np.concatenate(([0], np.cumsum(code > 3, dtype=np.int64)))
    fine = other[k:] == other[:-k]
    # Words of 1, 2, 4, ... bases from each place, and of those the k bases, front to back and as the reverse complement.
    ahead, back = (code & 3).astype(np.uint64), (3 - (code & 3)).astype(np.uint64)
    front = rear = None
    size, done = 1, 0
    bits = lambda n: np.uint64(2 * n)
    while True:
        if k & size:
            if front is None:
                front, rear = ahead, back
            else:
                n = len(code) - done - size + 1
                front, rear = (front[:n] << bits(size)) | ahead[done : done + n], rear[:n] | (back[done : done + n] << bits(done))
            done += size
        if done == k:
            return np.minimum(front, rear)[fine]
        n = len(ahead) - size
        ahead, back = (ahead[:n] << bits(size)) | ahead[size:], back[:n] | (back[size:] << bits(size))
        size *= 2


def _unique(parts: list[np.ndarray]) -> np.ndarray:
    x = np.sort(np.concatenate(parts))
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def venn_of(sequences: DataFrame, k: int, samples: list, by: str = "sample", seq: str = "seq") -> DataFrame:
    """venn of the canonical k-mers of sequences, without a row a k-mer: tasks send arrays of the distinct ones, in shares by hash. The hash
    (times an odd number, within 2k bits) takes no two k-mers to one number. At most 31 samples."""
    if not 1 <= k <= 31 or len(samples) > 31:
        raise ValueError("k must be 1 to 31: two bits a base in 64; samples at most 31")
    high = min(SHARE_BITS, 2 * k)
    low = 2 * k - high
    narrow, odd, whole = np.uint32 if low <= 32 else np.uint64, np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 2 * k) - 1)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}
        many = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for bit, parts in waiting.items():
                x = _unique(parts)
                if not len(x):
                    continue
                share = (x >> np.uint64(low)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate(([True], share[1:] != share[:-1])))
                keys = (x & np.uint64((1 << low) - 1)).astype(narrow)
                ends = np.append(cuts[1:], len(x))
                yield pa.RecordBatch.from_pydict({"share": pa.array(share[cuts], pa.int32()), "bit": pa.array([bit] * len(cuts), pa.int32()), "keys": pa.array([keys[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary())})
            waiting.clear()

        for batch in batches:
            bits, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for bit in np.unique(bits):
                at, size = [], 0
                mine = np.flatnonzero(bits == bit)
                for i in mine:
                    at.append(texts[int(i)].as_py().encode())
                    size += len(at[-1])
                    if size >= STRETCH or i == mine[-1]:
                        x = (numbered(b"\n".join(at), k) * odd) & whole
                        waiting.setdefault(int(bit), []).append(x)
                        many, at, size = many + len(x), [], 0
                        if many >= SORTED:
                            yield from flush()
                            many = 0
        yield from flush()

    def counted(group: pa.Table) -> pa.Table:
        by_bit: dict[int, list[np.ndarray]] = {}
        for bit, keys in zip(group["bit"].to_pylist(), group["keys"], strict=True):
            by_bit.setdefault(bit, []).append(np.frombuffer(keys.as_buffer(), narrow))
        each = {bit: _unique(parts) for bit, parts in by_bit.items()}
        x, mask = np.concatenate(list(each.values())), np.concatenate([np.full(len(v), 1 << bit, np.int64) for bit, v in each.items()])
        order = np.argsort(x, kind="stable")
        x, mask = x[order], mask[order]
        masks = np.bitwise_or.reduceat(mask, np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))))
        value, n = np.unique(masks, return_counts=True)
        return pa.table({"mask": pa.array(value, pa.int32()), "n": pa.array(n, pa.int64())})

    bit = F.coalesce(*[F.when(F.col(by) == s, F.lit(j)) for j, s in enumerate(samples)])
    rows = sequences.select(bit.alias("bit"), F.col(seq).alias("__s")).where((F.length("__s") >= k) & F.col("bit").isNotNull())
    # Pieces overlap by k - 1 bases, so each k-mer lies in one of them alone.
    rows = rows.select("bit", "__s", F.explode(F.sequence(F.lit(1), F.length("__s") - (k - 1), F.lit(PIECE))).alias("__at"))
    rows = rows.select("bit", F.substring("__s", F.col("__at"), F.lit(PIECE + k - 1)).alias("__s"))
    arrays = rows.mapInArrow(sent, "share int, bit int, keys binary")
    return arrays.groupBy("share").applyInArrow(counted, "mask int, n long").groupBy("mask").agg(F.sum("n").alias("n"))
