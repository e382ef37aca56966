"""Contigs that a layout lacks, links from alignments, parts of sequence files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import strand_flag
from .intervals import depths
from .genes import running_total, with_line_before


def insert_positions(signals: DataFrame, tours: DataFrame) -> DataFrame:
    """(x, chrom, nearest, n, before, after): between which places of each tour a contig outside all of them goes.

    signals (x, y, n) holds each pair of contigs both ways, tours (chrom, id, number from 0) the orders. A contig goes beside the
    contig of the tour with the strongest signal (ties: the first in the tour), on the side of the neighbour with the stronger signal,
    and before it if neither neighbour has one or both are equal. Before the first place stands -1, after the last the tour's length.
    """
    free = signals.join(tours.select(F.col("id").alias("x")), "x", "left_anti").join(tours.select(F.col("id").alias("y"), "chrom", "number"), "y")
    best = free.groupBy("x", "chrom").agg(F.min(F.struct((-F.col("n")).alias("m"), "number", "y")).alias("b"))
    best = best.select("x", "chrom", F.col("b.y").alias("nearest"), (-F.col("b.m")).alias("n"), F.col("b.number").alias("at"))
    side = lambda d, name: free.select("x", "chrom", (F.col("number") + d).alias("at"), F.col("n").alias(name))
    both = best.join(side(1, "up"), ["x", "chrom", "at"], "left").join(side(-1, "down"), ["x", "chrom", "at"], "left")
    later = F.coalesce("down", F.lit(0)) > F.coalesce("up", F.lit(0))
    first = F.when(F.col("at") == 0, F.lit(-1)).when(later, F.col("at")).otherwise(F.col("at") - 1).cast("long")
    return both.select("x", "chrom", "nearest", "n", first.alias("before"), (first + 1).alias("after"))


def links_of_alignments(lines: DataFrame) -> DataFrame:
    """Read pairs of alignment records in file order (line_no, name, ref_id1, ref1, p1, strand1, ref_id2, ref2, p2, strand2,
    is_unmapped, is_paired): the first of neighbouring records of one name, if mapped and paired. order1 and order2 tell which
    end comes first by reference."""
    first = with_line_before(lines, "name").where(F.col("before").isNull() | ~F.col("name").eqNullSafe(F.col("before"))).where("not is_unmapped and is_paired")
    order1 = F.when(F.col("ref_id1") <= F.col("ref_id2"), 0).otherwise(1)
    return first.select("line_no", "name", strand_flag(F.col("strand1")).alias("flag1"), "ref1", "p1", order1.alias("order1"), strand_flag(F.col("strand2")).alias("flag2"), "ref2", "p2", (1 - order1).alias("order2"))


def fragment_pairs(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """pairs (read_id, chr1, pos1, strand1, chr2, pos2, strand2) with the restriction fragment of either end: (up1, down1) and (up2, down2), null for
    an end that lies in no fragment (chrom, start, stop; half open) or in several. Of both ends the first by chromosome and place comes first;
    strands are 1 and 0."""
    later = (F.col("chr1") > F.col("chr2")) | ((F.col("chr1") == F.col("chr2")) & (F.col("pos1") > F.col("pos2")))
    turned = [F.when(later, F.col(f"{c}{3 - k}")).otherwise(F.col(f"{c}{k}")).alias(f"{c}{k}") for k in (1, 2) for c in ("chr", "pos", "strand")]
    rows, read = pairs.select("read_id", *turned), Window.partitionBy("read_id")
    for k in (1, 2):
        held = depths(rows.select(F.col(f"chr{k}").alias("chrom"), F.col(f"pos{k}").alias("pos")), fragments.select("chrom", "start", "stop"), closed=False)
        held = held.withColumnsRenamed({"chrom": f"chr{k}", "pos": f"pos{k}", "depth": f"__n{k}", "b_start": f"__up{k}", "b_stop": f"__down{k}"})
        rows = rows.join(held, [f"chr{k}", f"pos{k}"], "left").withColumn(f"strand{k}", F.when(F.col(f"strand{k}") == "+", 1).otherwise(0))
    # A read's rows count together.
    one = lambda k, c: F.when((F.sum(f"__n{k}").over(read) == 1) & F.col("read_id").isNotNull(), F.max(f"__{c}{k}").over(read)).alias(f"{c}{k}")
    rows = rows.select("*", *[one(k, c) for k in (1, 2) for c in ("up", "down")])
    return rows.select("read_id", *[f"{c}{k}" for k in (1, 2) for c in ("chr", "pos", "strand", "up", "down")])


def parts_by_count(records: DataFrame, n: int) -> DataFrame:
    """records (line_no from 0) with ``part``, from 0: n records each."""
    return records.withColumn("part", F.floor(F.col("line_no") / n).cast("long"))


def parts_by_length(records: DataFrame, length: str, target: int) -> DataFrame:
    """records (line_no) with ``part``: the running length up to and with each, in whole multiples of the target."""
    return running_total(records, length).withColumn("part", F.floor(F.col("total") / target).cast("long")).drop("total")


def most_even(groups: DataFrame, by: list[str], length: str) -> DataFrame:
    """(by, score) of the parameter set whose group lengths differ least: (max - min) / sum; ties to the first set."""
    score = ((F.max(length) - F.min(length)).cast("double") / F.sum(length)).alias("score")
    return groups.groupBy(*by).agg(score).orderBy("score", *by).limit(1)


def inverted(lists: DataFrame, key: str, items: str) -> DataFrame:
    """(item, key) of a table with space-joined lists."""
    return lists.select(F.explode(F.split(items, " ")).alias("item"), key).where("item <> ''")


def listed(rows: DataFrame, ids: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows whose key is in a list of ids, or, with keep=False, those whose key is not."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi" if keep else "left_anti")
