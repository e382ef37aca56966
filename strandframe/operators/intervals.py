"""Interval joins on genomic coordinates: half-open intervals (chrom, start, stop) unless said otherwise.

Joins run on buckets of ``width`` bases: an interval goes to each bucket that it touches, a pair is kept in the first bucket
that both touch, so nothing needs to be made distinct. Intervals that touch more than MOST_BUCKETS buckets go to one wide
level of buckets more each time, so no interval is copied more often than that. A pair meets at the wider of its two levels
alone, and an interval goes up only to levels that the other side has.

Where only counts or single hits are asked for, no pairs are made: sums run along the positions (running_at).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH, MOST_BUCKETS, LEVELS = 4096, 64, 5
#: Rows of a table up to which it may be broadcast, where it was counted.
BROADCAST_ROWS = 100_000
#: Width of buckets in which middles meet the intervals that hold them.
NARROW = 1024
#: Bases of a block whose positions one task sums up in order.
BLOCK = 1 << 16
#: Bases of a block whose rows one call matches with what overlaps them most.
SPAN = 1 << 16


def _level(start: str, stop: str, width: int) -> str:
    """SQL of the least k for which buckets of width * 64**k hold an interval in MOST_BUCKETS of them."""
    cases = " ".join(f"WHEN {stop} - {start} > {width * MOST_BUCKETS**k}L THEN {k}" for k in range(LEVELS - 1, 0, -1))
    return f"CASE {cases} ELSE 0 END"


def _width(level: str, width: int) -> str:
    """SQL of the width of a level's buckets."""
    return f"element_at(array({', '.join(f'{width * MOST_BUCKETS**k}L' for k in range(LEVELS))}), {level} + 1)"


def _in_buckets(df: DataFrame, levels: str, start: str, stop: str, width: int, mark: str) -> DataFrame:
    """df once for each bucket of each of the levels that its interval touches."""
    w = _width(f"__level{mark}", width)
    return df.selectExpr("*", f"explode({levels}) AS __level{mark}").selectExpr("*", f"explode(sequence({start} div {w}, (greatest({stop}, {start} + 1) - 1) div {w})) AS __k{mark}")


def bucket_pairs(a: DataFrame, b: DataFrame, width: int, points: bool = False, small: bool = False) -> DataFrame:
    """Pairs of a and b (columns prefixed b_) that meet in a bucket, before they are looked at. points: intervals of a are one
    base long. small: b was counted and may be broadcast."""
    a = a.selectExpr("*", f"{0 if points else _level('start', 'stop', width)} AS __la")
    b = b.selectExpr("*", f"{_level('b_start', 'b_stop', width)} AS __lb")
    on = F.expr("chrom = b_chrom AND __level = __level_b AND __k = __k_b")

    def up(df: DataFrame, other: DataFrame, others: str) -> DataFrame:
        """df with the levels that the other side has: one row of at most LEVELS numbers is broadcast."""
        return df.crossJoin(F.broadcast(other.agg(F.collect_set(others).alias("__there"))))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(F.broadcast(right) if small else right, on).drop("__there")

    # b at its own level, a there too if that is no finer than a's own; and a at its own level, b at that if it is coarser than b's.
    own_b = _in_buckets(b, "array(__lb)", "b_start", "b_stop", width, "_b")
    pairs = met(_in_buckets(up(a, b, "__lb"), "filter(__there, x -> x >= __la)", "start", "stop", width, ""), own_b)
    if points:
        return pairs
    wide = a.where("__la > 0")
    up_b = _in_buckets(up(b, wide, "__la"), "filter(__there, x -> x > __lb)", "b_start", "b_stop", width, "_b")
    return pairs.unionByName(met(_in_buckets(wide, "array(__la)", "start", "stop", width, ""), up_b))


def overlap_join(a: DataFrame, b: DataFrame, fraction_a: float = 0.0, fraction_b: float = 0.0, width: int = WIDTH, points: bool = False, small: bool = False) -> DataFrame:
    """Pairs of a and b on one chromosome that overlap by at least one base, with ``overlap`` and b's columns prefixed b_.

    fraction_a and fraction_b: the least share of either interval that the overlap must cover. points, small: see bucket_pairs.
    """
    if not (0 <= fraction_a <= 1 and 0 <= fraction_b <= 1):
        raise ValueError("a fraction lies between 0 and 1")
    b = b.select([F.col(c).alias(f"b_{c}") for c in b.columns])
    w, overlap = _width("__level", width), "(least(stop, b_stop) - greatest(start, b_start))"
    rule = f"start < b_stop AND stop > b_start AND __k = greatest(start div {w}, b_start div {w})"
    if fraction_a:
        rule += f" AND {overlap} >= {fraction_a}D * (stop - start)"
    if fraction_b:
        rule += f" AND {overlap} >= {fraction_b}D * (b_stop - b_start)"
    return bucket_pairs(a, b, width, points, small).where(rule).selectExpr(*a.columns, *b.columns, f"{overlap} AS overlap")


def held_join(a: DataFrame, b: DataFrame, fraction_b: float, width: int = NARROW) -> DataFrame:
    """overlap_join of a and b where more than half of b's interval must be covered. Then its middle lies in a's, so that b goes to one bucket
    a level, a pair meets once, and few meet that are not kept. a's copies are hashed by bucket in shuffled shares, not broadcast."""
    if not 0.5 < fraction_b <= 1:
        raise ValueError("a fraction above one half")
    b = b.select([F.col(c).alias(f"b_{c}") for c in b.columns]).selectExpr("*", f"{fraction_b}D * (b_stop - b_start) AS __least").selectExpr("*", "b_start + greatest(b_stop - b_start, 0) div 2 AS __at")
    a = a.selectExpr("*", f"{_level('start', 'stop', width)} AS __l").where("stop > start")
    there = a.agg(F.collect_set("__l").alias("__there"))
    w = _width("__level_b", width)
    points = b.crossJoin(F.broadcast(there)).selectExpr("*", "explode(__there) AS __level_b").selectExpr("*", f"cast(floor(__at / {w}) AS bigint) AS __k_b").drop("__there", "__at")
    w = _width("__level", width)
    copies = a.selectExpr("*", "__l AS __level").selectExpr("*", f"explode(sequence(cast(floor(start / {w}) AS bigint), cast(floor((stop - 1) / {w}) AS bigint))) AS __k")
    overlap = "(least(stop, b_stop) - greatest(start, b_start))"
    met = points.join(copies.hint("shuffle_hash"), F.expr(f"chrom = b_chrom AND __level = __level_b AND __k = __k_b AND start < b_stop AND stop > b_start AND {overlap} >= __least"))
    return met.selectExpr(*[c for c in a.columns if c != "__l"], *[c for c in b.columns if c not in ("__least", "__at")], f"{overlap} AS overlap")


def points_in(points: DataFrame, intervals: DataFrame, closed: bool = True, width: int = WIDTH, small: bool = False) -> DataFrame:
    """Pairs of points (chrom, pos) and the intervals that hold them, b_ before the intervals' columns; closed: stop is inside."""
    shifted = intervals.withColumn("stop", F.col("stop") + 1) if closed else intervals
    at = points.withColumn("start", F.col("pos")).withColumn("stop", F.col("pos") + 1)
    found = overlap_join(at, shifted, width=width, points=True, small=small).drop("start", "stop", "overlap")
    return found.withColumn("b_stop", F.col("b_stop") - 1) if closed else found


def running_at(steps: DataFrame, places: DataFrame) -> DataFrame:
    """Distinct places (chrom, pos) with each further column of steps (chrom, pos, ...) summed over the steps up to and with pos.

    A position is one row, whatever lies on it; blocks are summed first, one row a block, so that no task sorts a chromosome."""
    names = [c for c in steps.columns if c not in ("chrom", "pos")]
    none = [F.lit(0).cast("long").alias(c) for c in names]
    rows = steps.select("chrom", "pos", *names, F.lit(0).alias("__asked")).unionByName(places.select("chrom", "pos", *none, F.lit(1).alias("__asked")))
    sums = [F.sum(c).alias(c) for c in names]
    rows = rows.where("chrom is not null and pos is not null").groupBy("chrom", "pos").agg(*sums, F.max("__asked").alias("__asked")).withColumn("__block", F.floor(F.col("pos") / BLOCK))
    blocks = rows.groupBy("chrom", "__block").agg(*sums, F.max("__asked").alias("__any"))
    order = Window.partitionBy("chrom").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    before = blocks.select("chrom", "__block", "__any", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"__{c}") for c in names]).where("__any = 1").drop("__any")
    within = Window.partitionBy("chrom", "__block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(before, ["chrom", "__block"])
    return run.select("chrom", "pos", "__asked", *[(F.col(f"__{c}") + F.sum(c).over(within)).alias(c) for c in names]).where("__asked = 1").drop("__asked")


def depths(points: DataFrame, intervals: DataFrame, closed: bool = True) -> DataFrame:
    """Distinct points (chrom, pos) that lie in intervals, with ``depth``, in how many, and, where it is one, that one's ``b_start`` and
    ``b_stop``; closed: stop is inside. No pairs are made."""
    after = F.col("stop") + (1 if closed else 0)
    end = lambda pos, sign: F.struct(pos.cast("long").alias("pos"), F.lit(sign).cast("long").alias("depth"), *[(F.col(c) * sign).cast("long").alias(f"b_{c}") for c in ("start", "stop")])
    ends = intervals.where(after > F.col("start")).select("chrom", F.explode(F.array(end(F.col("start"), 1), end(after, -1))).alias("e")).select("chrom", "e.*")
    one = lambda c: F.when(F.col("depth") == 1, F.col(c)).alias(c)
    return running_at(ends, points).where("depth > 0").select("chrom", "pos", "depth", one("b_start"), one("b_stop"))


def lone_hits(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Points (chrom, pos) in exactly one interval, both its ends inside, that have their place to themselves, and that interval's
    columns prefixed b_. A lone interval has its ends to itself: any other with the same ones would hold the point too."""
    once = points.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select("chrom", "pos")
    named = intervals.select(F.col("chrom"), *[F.col(c).alias(f"b_{c}") for c in intervals.columns if c != "chrom"])
    return depths(once, intervals).where("depth = 1").drop("depth").join(named, ["chrom", "b_start", "b_stop"])


def count_points(intervals: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): how many points (chrom, pos) the intervals of each key hold, both ends inside; 0 where none. Points up to the stop
    less those before the start: no pairs are made."""
    before = F.col("start") - 1
    side = lambda pos, sign: F.struct(pos.alias("__pos"), F.lit(sign).cast("long").alias("__sign"))
    ends = intervals.select("chrom", *[k for k in keys if k != "chrom"], F.explode(F.array(side(before, -1), side(F.greatest("stop", before), 1))).alias("__e")).select("*", F.col("__e.__pos").alias("pos"), F.col("__e.__sign").alias("__sign")).drop("__e")
    n = running_at(points.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n")), ends.select("chrom", "pos"))
    return ends.join(n, ["chrom", "pos"], "left").groupBy(*keys).agg(F.sum(F.col("__sign") * F.coalesce("n", F.lit(0))).alias("n"))


def count_overlaps(windows: DataFrame, features: DataFrame, keys: list[str], **how) -> DataFrame:
    """windows with ``n``, how many features overlap each; 0 where none does."""
    n = overlap_join(windows.select("chrom", "start", "stop", *[k for k in keys if k not in ("chrom", "start", "stop")]), features, **how).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return windows.join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def _best(starts: np.ndarray, stops: np.ndarray, a: np.ndarray, b: np.ndarray, last: bool) -> np.ndarray:
    """For each interval (starts, stops) the place in (a, b), sorted by a, then b, of the one that overlaps it most; of equals the first, or with
    `last` the last; -1 where none does. No pair is looked at: steps of powers of two along the sorted intervals."""
    n = len(a)
    if not n:
        return np.full(len(starts), -1)
    highest, place = np.maximum.accumulate(b), np.arange(n)
    upto = np.searchsorted(a, starts, "right")  # those before begin at or before the start
    reach = np.searchsorted(highest, stops, "left")  # the first that goes to the stop or beyond
    run_end = np.searchsorted(a, a, "right") - 1  # of intervals of one start the one that stops last

    if last:  # the last before `upto` that goes to the stop: back over all stretches that do not
        tops, whole = [b], upto.copy()
        while 2 << (len(tops) - 1) <= n:
            t, w = tops[-1], 1 << (len(tops) - 1)
            tops.append(np.maximum(t[:-w], t[w:]))
        for j in range(len(tops) - 1, -1, -1):
            fits = whole >= 1 << j
            low = np.zeros(len(starts), bool)
            low[fits] = tops[j][whole[fits] - (1 << j)] < stops[fits]
            whole = np.where(low, whole - (1 << j), whole)
        whole = whole - 1
    else:
        whole = np.where(reach < upto, reach, -1)

    # None covers it. From the left: that which stops last.
    record = np.maximum.accumulate(np.where(b == highest, place, 0)) if last else np.searchsorted(highest, highest, "left")
    left = np.where(upto > 0, record[np.maximum(upto, 1) - 1], -1)
    # From inside on: each next that stops later, their lengths as long as they stop inside, then the one that goes to the stop.
    later = np.full(n + 1, n)
    stack: list[int] = []
    for i in range(n):
        while stack and b[stack[-1]] < b[i]:
            later[stack.pop()] = i
        stack.append(i)
    at = upto.copy()
    jumps, firsts = [later], [np.append(place, -1)]
    length = np.append(b - a, -1)
    better = lambda x, y: np.where((length[y] >= length[x]) if last else (length[y] > length[x]), y, x)
    while (jumps[-1][:n] < n).any():
        j, f = jumps[-1], firsts[-1]
        jumps.append(j[j])
        firsts.append(better(f, f[j]))
    stop_of = np.append(b, np.iinfo(np.int64).max)
    ends = [stop_of]  # the last stop of the stretch from each place
    for j in jumps[:-1]:
        ends.append(ends[-1][j])
    inner = np.full(len(starts), -1)
    for j in range(len(jumps) - 1, -1, -1):
        inside = (at < n) & (ends[j][at] < stops)
        inner = np.where(inside, better(inner, firsts[j][at]), inner)
        at = np.where(inside, jumps[j][at], at)
    right = np.where(at < n, at, -1)
    if last:
        right = np.where(right >= 0, run_end[right], -1)

    start_of, stop_of = np.append(a, 0), np.append(b, 0)
    best, most = np.full(len(starts), -1), np.zeros(len(starts), np.int64)
    for found in (whole, left, inner, right):
        over = np.where(found >= 0, np.minimum(stop_of[found], stops) - np.maximum(start_of[found], starts), 0)
        take = (found >= 0) & ((over > most) | ((over == most) & (over > 0) & ((found > best) if last else (found < best))))
        best, most = np.where(take, found, best), np.where(take, over, most)
    return best


def in_spans(a: DataFrame, b: DataFrame, width: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """a and b with ``__level`` and ``__block``: rows of a once, by their start, longer ones in wider blocks, so that they lie in their block
    and the next; rows of b in every block of a's levels in which rows of a may overlap them."""
    a = a.where("chrom is not null and stop >= start")
    level, w = _level("start", "stop", width // MOST_BUCKETS), _width("__level", width)  # the first whose width holds the row
    there = a.selectExpr(f"{level} AS l").distinct().agg(F.collect_set("l").alias("__there"))
    rows = a.selectExpr("*", f"{level} AS __level").selectExpr("*", f"cast(floor(start / {w}) AS bigint) AS __block")
    near = b.crossJoin(F.broadcast(there)).selectExpr("*", "explode(__there) AS __level").drop("__there")
    return rows, near.selectExpr("*", f"explode(sequence(cast(floor(start / {w}) AS bigint) - 1, cast(floor((stop - 1) / {w}) AS bigint))) AS __block")


def best_overlap(a: DataFrame, b: DataFrame, fraction_a: float, last: bool = False, width: int = SPAN) -> DataFrame:
    """a with ``b_start``, ``b_stop`` and ``overlap`` of the interval of b (chrom, start, stop) that overlaps each row most, where that covers at least
    a fraction of the row: of equals the first by start and stop, or with `last` the last. No pairs are made.

    Rows go by their start to blocks of `width` bases, longer rows to wider ones, and there lie in their block and the next. Of b's intervals that
    cover all of both, no more than one matters in a block.
    """
    w = _width("__level", width)
    ends = b.select("chrom", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).where("stop > start").distinct()
    rows, ends = in_spans(a, ends, width)
    whole = f"start < __block * {w} AND stop >= (__block + 2) * {w}"
    pick = (F.max if last else F.min)(F.struct("start", "stop")).alias("e")
    through = ends.where(whole).groupBy("chrom", "__level", "__block").agg(pick).select("chrom", "__level", "__block", "e.*")
    ends = ends.where(f"NOT ({whole})").select(*through.columns).unionByName(through)

    def choose(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values(["start", "stop"])
        starts, stops, s, e = (c.to_numpy(np.int64) for c in (x["start"], x["stop"], y["start"], y["stop"]))
        empty = starts == stops  # lies in what begins before it and ends after it
        found = _best(starts - empty, stops + empty, s, e, last)
        fits = (found >= 0) & ~(empty & ((s[found] >= starts) | (e[found] <= stops))) if len(s) else found >= 0
        x, found, starts, stops = x[fits], found[fits], starts[fits], stops[fits]
        return x.drop(columns=["__level", "__block"]).assign(b_start=s[found], b_stop=e[found], overlap=np.minimum(stops, e[found]) - np.maximum(starts, s[found]))

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in a.schema.fields) + ", b_start long, b_stop long, overlap long"
    by = ["chrom", "__level", "__block"]
    met = rows.groupBy(*by).cogroup(ends.groupBy(*by)).applyInPandas(choose, out)
    return met.where(F.col("overlap") >= F.lit(float(fraction_a)) * (F.col("stop") - F.col("start")))


def make_windows(sizes: DataFrame, size: int) -> DataFrame:
    """Windows of a size over each chromosome; the last is cut at its end, none is empty."""
    starts = sizes.where(F.col("size") > 0).select("chrom", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long"))).alias("start"))
    return starts.select("chrom", "start", F.least(F.col("start") + size, F.col("size")).alias("stop"))


def leaves(domains: DataFrame) -> DataFrame:
    """Domains that no strictly shorter domain overlaps."""
    d = domains.select("chrom", "start", "stop").distinct()
    shorter = overlap_join(d, d).where((F.col("b_stop") - F.col("b_start")) < (F.col("stop") - F.col("start"))).select("chrom", "start", "stop").distinct()
    return d.join(shorter, ["chrom", "start", "stop"], "left_anti")


def islands(domains: DataFrame) -> DataFrame:
    """domains with ``island``, where the run of overlapping domains that each is in begins."""
    w = Window.partitionBy("chrom").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (before <= F.col("start")), F.col("start"))
    return domains.withColumn("__begin", begins).withColumn("island", F.max("__begin").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__begin")


def fold_bottom(domains: DataFrame, order: str) -> DataFrame:
    """Domains left when each, in order, is added after those strictly longer that overlap it are removed.

    The result depends on the order, so each run of overlapping domains is folded in one task.
    """

    def fold(d: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, int]] = []
        for start, stop in d.sort_values(order)[["start", "stop"]].itertuples(index=False):
            kept = [(a, b) for a, b in kept if not (a < stop and b > start and b - a > stop - start)]
            if (start, stop) not in kept:
                kept.append((start, stop))
        return pd.DataFrame({"chrom": d["chrom"].iloc[0], "start": [k[0] for k in kept], "stop": [k[1] for k in kept]})

    return islands(domains).groupBy("chrom", "island").applyInPandas(fold, "chrom string, start long, stop long")


def merge_keep_smallest(domains: DataFrame) -> DataFrame:
    """Of overlapping domains the smaller stays: in order of (start, stop), each is held against the first kept one that it overlaps.

    Each run of overlapping domains is folded in one task.
    """

    def fold(d: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, int]] = []
        for start, stop in sorted(set(d[["start", "stop"]].itertuples(index=False, name=None))):
            hit = next((k for k in sorted(kept) if k[0] < stop and k[1] > start), None)
            if hit is None:
                kept.append((start, stop))
            elif hit[1] - hit[0] > stop - start:
                kept[kept.index(hit)] = (start, stop)
        return pd.DataFrame({"chrom": d["chrom"].iloc[0], "start": [k[0] for k in kept], "stop": [k[1] for k in kept]})

    return islands(domains).groupBy("chrom", "island").applyInPandas(fold, "chrom string, start long, stop long")


def boundaries(domains: DataFrame) -> DataFrame:
    """Distinct ends of domains: (chrom, pos)."""
    return domains.select("chrom", F.explode(F.array("start", "stop")).alias("pos")).distinct()


def flanked(points: DataFrame, sizes: DataFrame, flank: int) -> DataFrame:
    """Intervals of flank bases around points, cut at the chromosome's ends."""
    return points.join(F.broadcast(sizes), "chrom").select("chrom", F.greatest(F.col("pos") - flank, F.lit(0)).alias("start"), F.least(F.col("pos") + flank, F.col("size")).alias("stop"))


def mostly_inside(pairs: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Overlap pairs whose b interval lies inside a by at least a fraction of itself."""
    return pairs.where(F.col("overlap") >= F.lit(fraction) * (F.col("b_stop") - F.col("b_start")))


def split_regions(regions: DataFrame, size: int) -> DataFrame:
    """Regions (chrom, start, stop, orientation) cut into pieces of a size; on the minus strand the odd piece comes first."""
    length = F.col("stop") - F.col("start")
    odd = F.when(F.col("orientation") == "-", length % size).otherwise(F.lit(0).cast("long"))
    cuts = F.concat(F.when(odd > 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>")), F.when(length > odd, F.sequence(odd, length - 1, F.lit(size).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    pieces = regions.where(length > 0).select("*", F.posexplode(cuts).alias("piece", "at"), odd.alias("odd"))
    until = F.when((F.col("at") == 0) & (F.col("odd") > 0), F.col("odd")).otherwise(F.least(F.col("at") + size, F.col("stop") - F.col("start")))
    return pieces.withColumn("piece_start", F.col("start") + F.col("at")).withColumn("piece_stop", F.col("start") + until).drop("at", "odd")


def only_hit(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Pairs whose key has no other pair."""
    once = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    return pairs.join(once, key, "left_semi")
