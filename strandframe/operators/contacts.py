"""Contact pairs and sparse contact matrices: pixels (bin1 <= bin2, n) in long form, never dense."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .genes import running_total
from .graph import checkpointed

#: Bins up to which their biases may be broadcast, 16 bytes each.
BROADCAST_BINS = 1_000_000


def cis(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("chr1") == F.col("chr2"))


def trans(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("chr1") != F.col("chr2"))


def distance(pairs: DataFrame) -> DataFrame:
    """pairs with ``distance``, 0 across chromosomes."""
    return pairs.withColumn("distance", F.when(F.col("chr1") == F.col("chr2"), F.abs(F.col("pos1") - F.col("pos2"))).otherwise(0))


def decay(pairs: DataFrame, scale: int, low: int, high: int, by: list[str] = ["chr1"]) -> DataFrame:  # noqa: B006
    """Contacts by distance bin within [low, high]."""
    dist = (F.floor(F.abs(F.col("pos1") - F.col("pos2")) / scale) * scale).cast("long")
    return cis(pairs).withColumn("dist", dist).where(F.col("dist").between(low, high)).groupBy(*by, "dist").agg(F.count(F.lit(1)).alias("n"))


def decay_slope(histogram: DataFrame, by: list[str] = ["chr1"]) -> DataFrame:  # noqa: B006
    """Slope of log count against log distance; null for fewer than two distances."""
    h = histogram.where("dist > 0").withColumn("y", F.log10("n")).withColumn("x", F.log10("dist"))
    return h.groupBy(*by).agg(F.when(F.countDistinct("dist") >= 2, F.round(F.regr_slope("y", "x"), 6)).alias("slope"))


def pixels(pairs: DataFrame, size: int) -> DataFrame:
    """Upper-triangle pixels within chromosomes."""
    b1, b2 = (F.floor(F.col(c) / size).cast("long") for c in ("pos1", "pos2"))
    return cis(pairs).groupBy(F.col("chr1").alias("chrom"), F.least(b1, b2).alias("bin1"), F.greatest(b1, b2).alias("bin2")).agg(F.count(F.lit(1)).alias("n"))


def contig_offsets(contigs: DataFrame, size: int) -> DataFrame:
    """contigs with the number of their bins and of those before them, by id. One row a contig is put in order."""
    bins = contigs.withColumn("bins", F.ceil(F.col("length") / size).cast("long"))
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return bins.withColumn("offset", F.coalesce(F.sum("bins").over(w), F.lit(0)))


def pixels_from_alignments(alignments: DataFrame, offsets: DataFrame, size: int, quality: int) -> DataFrame:
    """Pixels over all contigs' bins: mapped first reads of at least a quality."""
    o1, o2 = (offsets.select(F.col("id").alias(f"ref{k}"), F.col("offset").alias(f"offset{k}")) for k in (1, 2))
    rows = alignments.where(~F.col("is_unmapped") & F.col("is_read1") & (F.col("mapq") >= quality)).join(o1, "ref1").join(o2, "ref2")
    b1, b2 = (F.col(f"offset{k}") + F.floor(F.col(f"p{k}") / size).cast("long") for k in (1, 2))
    return rows.groupBy(F.least(b1, b2).alias("bin1"), F.greatest(b1, b2).alias("bin2")).agg(F.count(F.lit(1)).alias("n"))


def symmetric(p: DataFrame) -> DataFrame:
    """Both triangles; the diagonal once."""
    rest = [c for c in p.columns if c not in ("bin1", "bin2")]
    flipped = p.where("bin1 <> bin2").select(*rest, F.col("bin2").alias("bin1"), F.col("bin1").alias("bin2"))
    return p.unionByName(flipped.select(*p.columns))


def bin_sums(p: DataFrame, by: list[str]) -> DataFrame:
    """Sum over the symmetric matrix by bin."""
    both = p.select(*by, F.explode(F.when(F.col("bin1") == F.col("bin2"), F.array("bin1")).otherwise(F.array("bin1", "bin2"))).alias("bin"), "n")
    return both.groupBy(*by, "bin").agg(F.sum("n").alias("total"))


def drop_diagonals(p: DataFrame, most: int) -> DataFrame:
    """Pixels further than `most` from the diagonal."""
    return p.where(F.abs(F.col("bin2") - F.col("bin1")) > most)


def pairs_by_distance(valid: DataFrame, by: str) -> DataFrame:
    """(by, d, pairs): how many pairs of a group's bins lie at each distance, from the mask of bins convolved with itself.

    A group is a chromosome, whose mask is as long as its bins are many; pairs are counted, never listed.
    """

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["bin"].to_numpy(np.int64)
        mask = np.zeros(int(at.max() - at.min()) + 1)
        mask[at - at.min()] = 1
        f = np.fft.rfft(mask, 1 << (2 * len(mask)).bit_length())
        n = np.rint(np.fft.irfft(f * f.conj())[: len(mask)]).astype(np.int64)
        d = np.flatnonzero(n)
        return pd.DataFrame({by: rows[by].iloc[0], "d": d, "pairs": n[d]})

    kind = valid.schema[by].dataType.simpleString()
    return valid.groupBy(by).applyInPandas(count, f"{by} {kind}, d long, pairs long")


def expected(p: DataFrame, by: str = "chrom") -> DataFrame:
    """Mean count by distance over pairs of bins that have any contact: (by, d, pairs, expected)."""
    at = pairs_by_distance(bin_sums(p, [by]).where("total > 0").select(by, "bin"), by)
    total = p.groupBy(by, (F.col("bin2") - F.col("bin1")).alias("d")).agg(F.sum("n").alias("total"))
    return at.join(total, [by, "d"], "left").select(by, "d", "pairs", (F.coalesce("total", F.lit(0)).cast("double") / F.col("pairs")).alias("expected"))


def observed_over_expected(p: DataFrame, by: str = "chrom") -> DataFrame:
    """Pixels with ``oe``; 0 where nothing is expected."""
    e = expected(p, by).select(by, "d", "expected")
    rows = p.withColumn("d", F.col("bin2") - F.col("bin1")).join(e, [by, "d"])
    return rows.select(by, "bin1", "bin2", "n", F.when(F.col("expected") > 0, F.col("n") / F.col("expected")).otherwise(0.0).alias("oe"))


def interaction_score(p: DataFrame, by: str = "chrom") -> DataFrame:
    """Mean observed/expected of each bin over all bins of its chromosome up to the last with a contact."""
    oe = observed_over_expected(p, by).select(by, "bin1", "bin2", F.col("oe").alias("n"))
    bins = p.groupBy(by).agg((F.max("bin2") + 1).alias("bins"))
    return bin_sums(oe, [by]).join(bins, by).select(by, "bin", (F.col("total") / F.col("bins")).alias("score"))


def asymmetry(p: DataFrame) -> DataFrame:
    """The largest difference between a pixel and its mirror, in a matrix given by both triangles."""
    mirror = p.select(F.col("bin2").alias("bin1"), F.col("bin1").alias("bin2"), F.col("n").alias("m"))
    return p.join(mirror, ["bin1", "bin2"], "full_outer").agg(F.max(F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0)))).alias("difference"))


def coarsen(p: DataFrame, factor: int, by: list[str]) -> DataFrame:
    """Pixels of bins `factor` times as wide."""
    b1, b2 = (F.floor(F.col(c) / factor).cast("long") for c in ("bin1", "bin2"))
    return p.groupBy(*by, b1.alias("bin1"), b2.alias("bin2")).agg(F.sum("n").alias("n"))


def reorder(p: DataFrame, places: DataFrame) -> DataFrame:
    """Pixels under new bin numbers, given as (bin, place); bins without a place are dropped."""
    first, second = (places.select(F.col("bin").alias(f"bin{k}"), F.col("place").alias(f"place{k}")) for k in (1, 2))
    rows = p.join(first, "bin1").join(second, "bin2")
    return rows.groupBy(F.least("place1", "place2").alias("bin1"), F.greatest("place1", "place2").alias("bin2")).agg(F.sum("n").alias("n"))


def counted_both_ways(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Contacts of each with each: a pair counts in both directions, one with itself twice."""
    a, b = F.col(first), F.col(second)
    return pairs.select(F.explode(F.array(F.struct(a.alias("x"), b.alias("y")), F.struct(b.alias("x"), a.alias("y")))).alias("p")).groupBy("p.x", "p.y").agg(F.count(F.lit(1)).alias("n"))


def territories(pairs: DataFrame) -> DataFrame:
    """log2 of observed to expected contacts between chromosomes, expected from their totals."""
    n = counted_both_ways(trans(pairs), "chr1", "chr2")
    total = n.groupBy("x").agg(F.sum("n").alias("t"))
    whole = n.agg(F.sum("n").alias("whole"))
    other = total.select(F.col("x").alias("y"), F.col("t").alias("u"))
    rows = n.join(total, "x").join(other, "y").crossJoin(F.broadcast(whole))  # one row
    expected = F.col("t").cast("double") * F.col("u") / F.col("whole")
    return rows.select("x", "y", "n", F.log2(F.col("n") / expected).alias("score"))


def chromosome_shares(pairs: DataFrame) -> DataFrame:
    """Cis and trans pairs of each chromosome and the ratio of the two."""
    sides = pairs.select(F.explode(F.when(F.col("chr1") == F.col("chr2"), F.array("chr1")).otherwise(F.array("chr1", "chr2"))).alias("chrom"), (F.col("chr1") == F.col("chr2")).alias("cis"))
    n = sides.groupBy("chrom").agg(F.count(F.when(F.col("cis"), 1)).alias("cis"), F.count(F.when(~F.col("cis"), 1)).alias("trans"))
    return n.withColumn("ratio", F.when(F.col("trans") > 0, F.col("cis").cast("double") / F.col("trans")))


def log_bins(bins: int, ratio: float = 1.03) -> list[tuple[int, int]]:
    """Ranges [low, high) of distances below `bins`: 0 alone, then between points that are evenly spaced on a logarithmic scale."""
    points = np.unique(np.rint(np.logspace(0, np.log10(bins), max(2, int(np.log(bins) / np.log(ratio))))).astype(int)) if bins > 1 else np.array([1])
    return [(0, 1), *zip(points[:-1].tolist(), points[1:].tolist(), strict=True)]


def expected_by_log_bins(p: DataFrame, bins: int, by: str = "chrom", ratio: float = 1.03) -> DataFrame:
    """(by, d, expected): mean over all pairs of `bins` bins, with contacts or without, in the logarithmic range of each distance.

    The ranges, a few hundred, are broadcast; sums by distance meet them, not the pixels.
    """
    ranges = [(k, a, b, sum(bins - d for d in range(a, b))) for k, (a, b) in enumerate(log_bins(bins, ratio))]
    edges = p.sparkSession.createDataFrame([(k, d, n) for k, a, b, n in ranges for d in range(a, b)], "part int, d long, pairs long")
    total = p.groupBy(by, (F.col("bin2") - F.col("bin1")).alias("d")).agg(F.sum("n").alias("n"))
    means = total.join(edges, "d").groupBy(by, "part").agg((F.sum("n").cast("double") / F.first("pairs")).alias("expected"))
    return means.join(edges, "part").select(by, "d", "expected")


def observed_over_log_bins(p: DataFrame, bins: int, by: str = "chrom", ratio: float = 1.03) -> DataFrame:
    """Pixels with ``oe``, the count over the mean of its logarithmic range of distances; as it is where that mean is 0."""
    rows = p.withColumn("d", F.col("bin2") - F.col("bin1")).join(expected_by_log_bins(p, bins, by, ratio), [by, "d"])
    return rows.select(by, "bin1", "bin2", "n", F.when(F.col("expected") != 0, F.col("n") / F.col("expected")).otherwise(F.col("n")).alias("oe"))


def _side_sums(p: DataFrame, ids: np.ndarray, left: np.ndarray, right: np.ndarray, sides: tuple[bool, bool], drop: int | None) -> np.ndarray:
    """Sums over bins (in the order of ids) of n times both its bins' factors, by one job: each task adds up its own pixels. sides: whether
    bin1 and bin2 get a pixel's value; a pixel on the diagonal gives it once. drop: diagonals up to this one count as 0."""
    shared = p.sparkSession.sparkContext.broadcast((ids, left, right))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, left, right = shared.value
        total = np.zeros(len(ids))
        for batch in batches:
            bin1, bin2, n = (batch[c].to_numpy() for c in ("bin1", "bin2", "n"))
            k1, k2 = np.searchsorted(ids, bin1), np.searchsorted(ids, bin2)
            x = n * left[k1] * right[k2]
            if drop is not None:
                x[bin2 - bin1 <= drop] = 0
            if sides[0]:
                total += np.bincount(k1, x, len(ids))
            if sides[1]:
                apart = k1 != k2 if sides[0] else slice(None)
                total += np.bincount(k2[apart], x[apart], len(ids))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "s"])

    got = p.mapInArrow(add, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toArrow()  # one row a bin
    out = np.zeros(len(ids))
    out[got["k"].to_numpy()] = got["s"].to_numpy()
    shared.unpersist()
    return out


def _scaled(p: DataFrame, ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> DataFrame:
    """(bin1, bin2, n, balanced): n times both its bins' factors."""
    shared = p.sparkSession.sparkContext.broadcast((ids, left, right))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, left, right = shared.value
        for batch in batches:
            k1, k2 = (np.searchsorted(ids, batch[c].to_numpy()) for c in ("bin1", "bin2"))
            yield pa.RecordBatch.from_arrays([batch["bin1"], batch["bin2"], batch["n"], pa.array(batch["n"].to_numpy() * left[k1] * right[k2])], ["bin1", "bin2", "n", "balanced"])

    return p.mapInArrow(scale, "bin1 long, bin2 long, n double, balanced double")


def _written(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixels that are not 0, and their bins, both written: what every round reads."""
    p = checkpointed(p.select(F.col("bin1").cast("long").alias("bin1"), F.col("bin2").cast("long").alias("bin2"), F.col("n").cast("double").alias("n")).where("n <> 0 and bin1 is not null and bin2 is not null"))
    return p, checkpointed(p.select(F.explode(F.array("bin1", "bin2")).alias("bin")).distinct())


def balanced(p: DataFrame, rounds: int = 599, tolerance: float = 1e-5, damping: float = 0.8, drop: int = -1) -> DataFrame:
    """Iterative correction of upper-triangle pixels (bin1, bin2, n): in each round every bin's bias takes up `damping` of how far
    its sum lies from the mean sum, until none lies further than `tolerance` or the rounds are over. ``balanced`` is the count
    over both biases, rescaled by the squared mean bias. drop: diagonals up to this one count in no sum; their pixels stay.

    Where the bins were counted to be few, their biases are one array, and a round is one job over the pixels, whose tasks send
    sums; beyond BROADCAST_BINS the biases are a table that the pixels meet in joins.
    """
    p, bins = _written(p)
    if bins.count() > BROADCAST_BINS:
        return _balanced_by_joins(p, bins, rounds, tolerance, damping, drop)
    ids = np.sort(bins.toArrow()["bin"].to_numpy())
    bias = np.ones(len(ids))
    for _ in range(rounds):
        total = _side_sums(p, ids, 1 / bias, 1 / bias, (True, True), drop)
        mean = total.mean() if len(total) else 0
        if not mean:
            break
        step = 1 + damping * (total / mean - 1)
        bias *= step
        if np.abs(step - 1).max() < tolerance:
            break
    corr = bias.mean() if len(bias) else 1.0
    return _scaled(p, ids, corr / bias, corr / bias)


def _balanced_by_joins(p: DataFrame, bins: DataFrame, rounds: int, tolerance: float, damping: float, drop: int) -> DataFrame:
    """balanced() with the biases in a table."""
    bias = bins.select("bin", F.lit(1.0).alias("bias"))

    def corrected(bias: DataFrame) -> DataFrame:
        u, v = (bias.select(F.col("bin").alias(f"bin{k}"), F.col("bias").alias(c)) for k, c in ((1, "u"), (2, "v")))
        return p.join(u, "bin1").join(v, "bin2").select("bin1", "bin2", "n", (F.col("n") / (F.col("u") * F.col("v"))).alias("x"))

    for k in range(rounds):
        counted = corrected(bias).withColumn("n", F.when(F.col("bin2") - F.col("bin1") > drop, F.col("x")).otherwise(0.0))
        sums = checkpointed(bin_sums(counted, []))
        mean, low, high = sums.agg(F.avg("total"), F.min("total"), F.max("total")).first()
        if not mean:
            break
        step = sums.select("bin", (1 + damping * (F.col("total") / mean - 1)).alias("s"))
        bias = bias.join(step, "bin").select("bin", (F.col("bias") * F.col("s")).alias("bias"))
        bias = checkpointed(bias) if k % 3 == 2 else bias  # its sums are checkpointed, so it is cheap to work out again
        if damping * max(high / mean - 1, 1 - low / mean) < tolerance:
            break
    scale = (bias.agg(F.avg("bias")).first()[0] or 1.0) ** 2
    return corrected(bias).select("bin1", "bin2", "n", (F.col("x") * scale).alias("balanced"))


def corrected_safely(p: DataFrame, bins: int, least_sum: float = 40, diagonals: int = 2, least_cells: int = 10, least_share: float = 0.1, tolerance: float = 1e-6) -> DataFrame:
    """Iterative correction without thin bins: (bin1, bin2, balanced) of upper-triangle pixels of `bins` bins.

    The first `diagonals` diagonals are left out; bins stay whose other contacts sum to more than least_sum and lie in more
    cells than least_cells (or least_share of the bins, if that is less). After the correction the diagonals left out are
    filled, between bins that stayed, with the median of the first diagonal kept, its empty cells counting as 0.
    """
    p = p.where((F.abs(F.col("bin2") - F.col("bin1")) >= diagonals) & (F.col("n") > 0))
    sides = p.select(F.explode(F.array("bin1", "bin2")).alias("bin"), "n")
    enough = sides.groupBy("bin").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cells"))
    kept = checkpointed(enough.where((F.col("total") > least_sum) & (F.col("cells") > min(bins * least_share, least_cells))).select("bin"))
    of = lambda k: kept.select(F.col("bin").alias(f"bin{k}"))
    x = checkpointed(balanced(p.join(of(1), "bin1", "left_semi").join(of(2), "bin2", "left_semi"), tolerance=tolerance, drop=diagonals).select("bin1", "bin2", "balanced"))
    first = x.where(F.col("bin2") - F.col("bin1") == diagonals).select(F.col("balanced").alias("v"), F.lit(1).cast("long").alias("times"))
    empty = first.agg((F.lit(bins - diagonals) - F.count(F.lit(1))).alias("times")).select(F.lit(0.0).alias("v"), "times")
    median = first.unionByName(empty).where("times > 0").agg(F.percentile("v", F.lit(0.5), F.col("times")).alias("median"))
    near = kept.select(F.col("bin").alias("bin1"), F.explode(F.sequence(F.col("bin"), F.col("bin") + diagonals - 1)).alias("bin2")).join(of(2), "bin2", "left_semi")
    fill = near.crossJoin(F.broadcast(median)).where(F.lit(x.isEmpty()) == F.lit(False))  # one row
    return x.unionByName(fill.select("bin1", "bin2", F.col("median").alias("balanced")))


def balanced_both_ways(p: DataFrame, rounds: int = 50) -> DataFrame:
    """Iterative correction of pixels (bin1, bin2, n) of a matrix that is not symmetric: each round divides by the rows' sums, then
    by the columns', each over their mean. ``balanced`` keeps the matrix's total. Bins as in balanced()."""
    p, bins = _written(p)
    if bins.count() > BROADCAST_BINS:
        return _both_ways_by_joins(p, rounds)
    ids = np.sort(bins.toArrow()["bin"].to_numpy())
    factors, whole = [np.ones(len(ids)), np.ones(len(ids))], None
    for k in range(2 * rounds):
        total = _side_sums(p, ids, *factors, (k % 2 == 0, k % 2 == 1), None)
        there = total != 0
        if not there.any():
            break
        whole = total.sum() if whole is None else whole
        factors[k % 2][there] *= total[there].mean() / total[there]
    last = _side_sums(p, ids, *factors, (True, False), None).sum() if len(ids) else 0
    return _scaled(p, ids, factors[0] * ((whole or 1.0) / (last or 1.0)), factors[1]).select("bin1", "bin2", "balanced")


def _both_ways_by_joins(p: DataFrame, rounds: int) -> DataFrame:
    """balanced_both_ways() with the sums in tables."""
    x = p.select("bin1", "bin2", F.col("n").alias("x"))
    total = x.agg(F.sum("x")).first()[0]
    for k in range(2 * rounds):
        side = "bin1" if k % 2 == 0 else "bin2"
        sums = x.groupBy(side).agg(F.sum("x").alias("s"))
        mean = sums.agg(F.avg("s").alias("mean"))
        x = x.join(sums, side).crossJoin(F.broadcast(mean)).select("bin1", "bin2", (F.col("x") * F.col("mean") / F.col("s")).alias("x"))  # one row
        if k % 4 == 3:
            x = checkpointed(x)
    left = x.agg(F.sum("x")).first()[0]
    return x.select("bin1", "bin2", (F.col("x") * F.lit((total or 1.0) / (left or 1.0))).alias("balanced"))


def resolutions(pairs: DataFrame, sizes: DataFrame, factors: list[int], base: int = 100, least: int = 1000) -> DataFrame:
    """(factor, bins, covered, share): of all windows of factor * base bases, those whose ends of reads exceed `least`.

    Reads are counted once, by base bins. Windows tile each chromosome (sizes: chrom, size) and one window beyond, whether
    they have reads or not; the last base bin of each counts in none.
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.col("chr1").alias("chrom"), F.col("pos1").alias("pos")), F.struct(F.col("chr2").alias("chrom"), F.col("pos2").alias("pos")))).alias("e"))
    small = checkpointed(ends.groupBy("e.chrom", F.floor(F.col("e.pos") / base).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n")))
    each = small.join(sizes.select("chrom"), "chrom", "left_semi").select("chrom", "k", "n", F.explode(F.array(*map(F.lit, factors))).alias("factor")).where("k % factor <> factor - 1")
    wide = each.groupBy("factor", "chrom", F.floor(F.col("k") / F.col("factor")).alias("bin")).agg(F.sum("n").alias("n"))
    covered = wide.groupBy("factor").agg(F.count(F.when(F.col("n") > least, 1)).alias("covered"))
    whole = sizes.select(F.explode(F.array(*map(F.lit, factors))).alias("factor"), F.ceil((F.floor(F.col("size") / base) + F.col("factor")) / F.col("factor")).alias("bins")).groupBy("factor").agg(F.sum("bins").alias("bins"))
    rows = whole.join(covered, "factor", "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long")))
    return rows.select("factor", "bins", "covered", (F.col("covered").cast("double") / F.col("bins")).alias("share"))


def pair_medians(p: DataFrame, bins: DataFrame) -> DataFrame:
    """Median and mean over bins of the row sums between two groups of bins, rows without contacts counting as zero.

    p: symmetric pixels (bin1, bin2, n); bins: (bin, grp). Missing rows are counted, not made.
    """
    g1, g2 = (bins.select(F.col("bin").alias(f"bin{k}"), F.col("grp").alias(f"grp{k}")) for k in (1, 2))
    sums = p.join(g1, "bin1").join(g2, "bin2").groupBy("grp1", "grp2", "bin1").agg(F.sum("n").cast("double").alias("s"))
    size = bins.groupBy(F.col("grp").alias("grp1")).agg(F.count(F.lit(1)).alias("rows"))
    n = sums.groupBy("grp1", "grp2").agg(F.sort_array(F.collect_list("s")).alias("v"), F.sum("s").alias("total")).join(size, "grp1")
    value = lambda k: F.when(k <= F.col("rows") - F.size("v"), 0.0).otherwise(F.try_element_at("v", (k - F.col("rows") + F.size("v")).cast("int")))  # noqa: E731  the k-th smallest, from 1
    low, high = F.floor((F.col("rows") + 1) / 2), F.floor((F.col("rows") + 2) / 2)
    return n.select("grp1", "grp2", ((value(low) + value(high)) / 2).alias("median"), (F.col("total") / F.col("rows")).alias("mean"))


def _cells(pc1: DataFrame, by: str, parts: int) -> DataFrame:
    """(by, bin, cell): the quantile range that a bin's value lies strictly within, by group; bins on a border are in none."""
    q = pc1.groupBy(by).agg(F.percentile("pc1", F.array(*[F.lit(k / parts) for k in range(parts + 1)])).alias("q"))
    below = F.size(F.filter("q", lambda x: x < F.col("pc1")))
    return pc1.join(q, by).where(~F.array_contains("q", F.col("pc1"))).select(by, "bin", (below - 1).alias("cell"))


def strength(oe: DataFrame, pc1: DataFrame, by: str = "chrom", parts: int = 5) -> DataFrame:
    """(cell1, cell2, mean, n): mean observed/expected between the quantile ranges of bins' first components, empty cells of the
    matrix counting as 0; means of groups (chromosomes) add up. oe: upper-triangle pixels; pc1: (by, bin, pc1), bins with contacts count.
    """
    both = symmetric(oe.select(by, "bin1", "bin2", "oe"))
    cells = _cells(pc1.join(both.select(by, F.col("bin1").alias("bin")).distinct(), [by, "bin"], "left_semi"), by, parts)
    c1, c2 = (cells.select(by, F.col("bin").alias(f"bin{k}"), F.col("cell").alias(f"cell{k}")) for k in (1, 2))
    sums = both.join(c1, [by, "bin1"]).join(c2, [by, "bin2"]).groupBy(by, "cell1", "cell2").agg(F.sum("oe").alias("total"))
    size = cells.groupBy(by, "cell").agg(F.count(F.lit(1)).alias("bins"))
    s1, s2 = (size.select(by, F.col("cell").alias(f"cell{k}"), F.col("bins").alias(f"bins{k}")) for k in (1, 2))
    every = s1.join(s2, by).join(sums, [by, "cell1", "cell2"], "left")
    pairs = F.col("bins1") * F.col("bins2")
    return every.groupBy("cell1", "cell2").agg(F.sum(F.coalesce("total", F.lit(0.0)) / pairs).alias("mean"), F.sum(pairs).alias("n"))


def strength_draws(oe: DataFrame, pc1: DataFrame, draws: int = 100, seed: int = 5, by: str = "chrom", parts: int = 5) -> DataFrame:
    """(draw, score): log(AA * BB / AB**2) of resampled corner cells. Each pixel counts, by a hash, as often as a Poisson variable
    of mean 1 says, which is what drawing with replacement comes to; empty cells of the matrix stay 0 either way."""
    u = F.pmod(F.xxhash64(by, "bin1", "bin2", "draw", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    mass = np.cumsum([np.exp(-1) / float(math.factorial(k)) for k in range(9)])
    times = sum(F.when(u >= F.lit(float(m)), 1).otherwise(0) for m in mass)
    both = symmetric(oe.select(by, "bin1", "bin2", "oe"))
    cells = _cells(pc1.join(both.select(by, F.col("bin1").alias("bin")).distinct(), [by, "bin"], "left_semi"), by, parts).where(F.col("cell").isin(0, parts - 1))
    c1, c2 = (cells.select(by, F.col("bin").alias(f"bin{k}"), F.col("cell").alias(f"cell{k}")) for k in (1, 2))
    drawn = both.join(c1, [by, "bin1"]).join(c2, [by, "bin2"]).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("x", F.col("oe") * times)
    size = cells.groupBy(by, "cell").agg(F.count(F.lit(1)).alias("bins"))
    s1, s2 = (size.select(by, F.col("cell").alias(f"cell{k}"), F.col("bins").alias(f"bins{k}")) for k in (1, 2))
    means = drawn.groupBy("draw", by, "cell1", "cell2").agg(F.sum("x").alias("total")).join(s1, [by, "cell1"]).join(s2, [by, "cell2"])
    corner = lambda a, b: F.sum(F.when((F.col("cell1") == a) & (F.col("cell2") == b), F.col("total") / (F.col("bins1") * F.col("bins2"))))
    top = parts - 1
    return means.groupBy("draw").agg(F.log(corner(0, 0) * corner(top, top) / F.pow(corner(0, top), F.lit(2.0))).alias("score"))


def strength_score(cells: DataFrame, parts: int = 5) -> float | None:
    """log(AA * BB / AB**2) of the corner cells."""
    c = {(r["cell1"], r["cell2"]): r["mean"] for r in cells.collect()}  # parts * parts rows
    top, low = parts - 1, 0
    aa, bb, ab = c.get((top, top)), c.get((low, low)), c.get((low, top), c.get((top, low)))
    return float(np.log(aa * bb / ab**2)) if aa and bb and ab else None


def allelic_pairs(alleles: DataFrame) -> DataFrame:
    """Distinct pairs of contigs that stand in one allele row, the smaller first."""
    a, b = alleles.select("gene", F.col("contig").alias("x")), alleles.select("gene", F.col("contig").alias("y"))
    return a.join(b, "gene").where("x < y").select("x", "y").distinct()


def strongest(links: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The first link of each `by` in an order that must be total."""
    return links.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("__r = 1").drop("__r")


def territories_by_distance(pairs: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """(chrom1, chrom2, observed, expected, score) of pairs of chromosomes, chrom1 the one laid out first, by name: contacts between them, those to be
    expected from the mean of all bin pairs at each distance on the whole genome laid out in one line, and the logarithm to 2 of their ratio.

    A distance d has N - d bin pairs on a genome of N bins. Between two chromosomes the number of bin pairs at a distance rises, stays
    and falls as four ramps, so the expected sum needs prefix sums of the means at four distances a pair of chromosomes; no bin pairs are listed.
    """
    laid = contig_offsets(sizes.select(F.col("chrom").alias("id"), F.col("size").alias("length")), width)
    laid = checkpointed(laid.select(F.col("id").alias("chrom"), F.col("offset").alias("first"), "bins"))
    many = laid.agg(F.sum("bins").alias("n")).first()["n"] or 0
    side = lambda k: laid.select(F.col("chrom").alias(f"chr{k}"), F.col("first").alias(f"first{k}"), F.col("bins").alias(f"bins{k}"))
    bins = [F.floor(F.col(f"pos{k}") / width).cast("long").alias(f"b{k}") for k in (1, 2)]
    pixels = pairs.groupBy("chr1", "chr2", *bins).agg(F.count(F.lit(1)).alias("n")).join(side(1), "chr1").join(side(2), "chr2")
    pixels = checkpointed(pixels.withColumn("d", F.abs(F.col("first2") + F.col("b2") - F.col("first1") - F.col("b1"))))
    mean = pixels.groupBy(F.col("d").alias("line_no")).agg((F.sum("n").cast("double") / (F.lit(many) - F.first("d"))).alias("m"))
    turn = lambda a, b: F.when(F.col("first1") <= F.col("first2"), F.col(a)).otherwise(F.col(b)).alias(a)
    swapped = [turn(f"{c}{k}", f"{c}{3 - k}") for c in ("chr", "first", "bins") for k in (1, 2)]
    seen = checkpointed(pixels.where("chr1 <> chr2").select(*swapped, "n").groupBy("chr1", "chr2", "first1", "first2", "bins1", "bins2").agg(F.sum("n").alias("observed")))
    gap = F.col("first2") - F.col("first1")
    ramps = F.array(*[F.struct(F.lit(sign).alias("sign"), at.alias("t")) for sign, at in ((1, gap - F.col("bins1")), (-1, gap), (-1, gap + F.col("bins2") - F.col("bins1")), (1, gap + F.col("bins2")))])
    ramps = seen.select("chr1", "chr2", F.explode(ramps).alias("r")).select("chr1", "chr2", "r.sign", F.col("r.t").alias("line_no"))
    lines = ramps.select("line_no").distinct().join(mean, "line_no", "full_outer").select("line_no", F.coalesce("m", F.lit(0.0)).alias("m"))
    lines = lines.withColumn("md", F.col("m") * F.col("line_no"))
    sums = running_total(running_total(lines, "m").withColumnRenamed("total", "m_to"), "md").withColumnRenamed("total", "md_to")
    whole = mean.agg(F.sum("m").alias("m_all"), F.sum(F.col("m") * F.col("line_no")).alias("md_all"))
    ramps = ramps.join(sums, "line_no").crossJoin(F.broadcast(whole))  # one row
    above = (F.col("md_all") - F.col("md_to")) - F.col("line_no") * (F.col("m_all") - F.col("m_to"))
    expected = ramps.groupBy("chr1", "chr2").agg(F.sum(F.col("sign") * above).alias("expected"))
    out = seen.select("chr1", "chr2", "observed").join(expected, ["chr1", "chr2"])
    return out.select(F.col("chr1").alias("chrom1"), F.col("chr2").alias("chrom2"), "observed", "expected", F.log2(F.col("observed") / F.col("expected")).alias("score"))


def homolog(chrom: Column, letters: int = 1) -> Column:
    """A chromosome's name without its haplotype letters: that of its homologous group."""
    return chrom.substr(F.lit(1), F.greatest(F.length(chrom) - letters, F.lit(0)))


def placed_log_matrices(pairs: DataFrame, sizes: DataFrame, width: int, whole: str = "genome") -> DataFrame:
    """(matrix, x, y, score) of pairs (chr1, pos1, chr2, pos2): one matrix a chromosome, of its own pairs, and one of all chromosomes laid out in one line by
    name. A pair counts at (x, y) and at (y, x), on the diagonal twice; score is the count's logarithm to 2, and empty cells have no row."""
    laid = contig_offsets(sizes.select(F.col("chrom").alias("id"), F.col("size").alias("length")), width)
    rows = pairs
    for k in (1, 2):
        rows = rows.join(laid.select(F.col("id").alias(f"chr{k}"), F.col("offset").alias(f"offset{k}")), f"chr{k}")
    b1, b2 = (F.floor(F.col(f"pos{k}") / width).cast("long") for k in (1, 2))
    cells = lambda name, x, y: F.array(*[F.struct(name.alias("matrix"), a.cast("long").alias("x"), b.cast("long").alias("y")) for a, b in ((x, y), (y, x))])
    own = F.when(F.col("chr1") == F.col("chr2"), cells(F.col("chr1"), b1, b2)).otherwise(F.array().cast("array<struct<matrix:string,x:bigint,y:bigint>>"))
    both = F.concat(own, cells(F.lit(whole), F.col("offset1") + b1, F.col("offset2") + b2))
    return rows.select(F.explode(both).alias("c")).groupBy("c.matrix", "c.x", "c.y").agg(F.log2(F.count(F.lit(1)).cast("double")).alias("score"))
