"""Assembly layouts (AGP): 1-based closed coordinates, one row a contig in its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import BROADCAST_ROWS, points_in


def contigs(agp: DataFrame, gap: str = "U") -> DataFrame:
    return agp.where(F.col("type") != gap)


def moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """Contigs of an old layout that the same chromosome of a new one has too: (chrom, start, stop, sign, shift), by which the
    old position p goes to sign * p + shift.

    On the minus strand positions follow tig_stop - (pos - start + 1) one way and stop - tig_pos the other.
    """
    n = new.select("chrom", "id", F.col("start").alias("n_start"), F.col("stop").alias("n_stop"), F.col("tig_start").alias("n_tig"), F.col("orientation").alias("n_orientation"))
    rows = old.select("chrom", "start", "stop", "id", "tig_start", "tig_stop", "orientation").join(n, ["chrom", "id"])
    plus, n_plus = F.col("orientation") == "+", F.col("n_orientation") == "+"
    sign, shift = F.when(plus, 1).otherwise(-1), F.when(plus, F.col("tig_start") - F.col("start")).otherwise(F.col("tig_stop") + F.col("start") - 1)
    n_sign, n_shift = F.when(n_plus, 1).otherwise(-1), F.when(n_plus, F.col("n_start") - F.col("n_tig")).otherwise(F.col("n_stop"))
    return rows.select("chrom", "start", "stop", (sign * n_sign).alias("sign"), (n_sign * shift + n_shift).alias("shift"))


def lift_over(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Read pairs (read_id, chr1, pos1, chr2, pos2) moved from one layout to another; pairs with an end that has no place go.

    The layouts are counted: small ones are broadcast, so that pairs are not shuffled. Each end is looked up on its own row,
    so ids may repeat.
    """
    by_contig = moves(old, new)
    small = by_contig.count() <= BROADCAST_ROWS
    rows = pairs.select("read_id", "chr1", "pos1", "chr2", "pos2")
    for k in (1, 2):
        ends = rows.withColumnsRenamed({f"chr{k}": "chrom", f"pos{k}": "pos"})
        moved = points_in(ends, by_contig, small=small).withColumn(f"pos{k}", F.col("b_sign") * F.col("pos") + F.col("b_shift"))
        rows = moved.withColumnRenamed("chrom", f"chr{k}").select("read_id", "chr1", "pos1", "chr2", "pos2")
    return rows


def contig_pairs_to_chrom(pairs: DataFrame, agp: DataFrame) -> DataFrame:
    """Pairs (read_id, ref1, p1, ref2, p2) on contigs, positions from 0, at their 1-based places on chromosomes; pairs with an
    unplaced end go."""
    rows = pairs
    for k in (1, 2):
        a = agp.select(F.col("id").alias(f"ref{k}"), F.col("chrom").alias(f"chr{k}"), F.col("start").alias("__s"), F.col("stop").alias("__e"), F.col("orientation").alias("__o"))
        pos = F.when(F.col("__o") == "+", F.col("__s") + F.col(f"p{k}")).otherwise(F.col("__e") - F.col(f"p{k}"))
        rows = rows.join(a, f"ref{k}").withColumn(f"pos{k}", pos).drop("__s", "__e", "__o")
    return rows.select("read_id", "chr1", "pos1", "chr2", "pos2")


def features_to_chrom(features: DataFrame, agp: DataFrame) -> DataFrame:
    """Features on contigs (id, start, stop, strand), 1-based closed, on chromosomes; strands turn with the contig."""
    a = agp.select("chrom", "id", F.col("start").alias("c_start"), F.col("stop").alias("c_stop"), "orientation")
    rows = features.join(a, "id")
    plus = F.col("orientation") == "+"
    start = F.when(plus, F.col("c_start") + F.col("start") - 1).otherwise(F.col("c_stop") - F.col("stop") + 1)
    stop = F.when(plus, F.col("c_start") + F.col("stop") - 1).otherwise(F.col("c_stop") - F.col("start") + 1)
    strand = F.when(plus, F.col("strand")).otherwise(F.when(F.col("strand") == "+", "-").otherwise("+"))
    return rows.select("chrom", start.alias("start"), stop.alias("stop"), strand.alias("strand"), "id", *[c for c in features.columns if c not in ("id", "start", "stop", "strand")])


def bed_to_chrom(features: DataFrame, agp: DataFrame) -> DataFrame:
    """The same for BED rows, whatever the contig's orientation."""
    rows = features.join(agp.select("chrom", "id", F.col("start").alias("c_start")), "id")
    return rows.select("chrom", (F.col("c_start") - 1 + F.col("start")).alias("start"), (F.col("c_start") - 1 + F.col("stop")).alias("stop"), "id")


def tours(agp: DataFrame, mark_all: bool = True) -> DataFrame:
    """Contigs of each chromosome in order with their orientation, joined by spaces."""
    part = F.concat("id", "orientation") if mark_all else F.col("id")
    lists = agp.groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("number", part.alias("p")))).alias("l"))
    return lists.select("chrom", F.array_join(F.transform("l", lambda x: x["p"]), " ").alias("tour"))


def clusters(agp: DataFrame) -> DataFrame:
    """Contigs of each chromosome: their number and their names in order; a chromosome that is its own contig is left out."""
    lists = agp.where("chrom <> id").groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("number", "id"))).alias("l"))
    return lists.select("chrom", F.size("l").cast("long").alias("n"), F.array_join(F.transform("l", lambda x: x["id"]), " ").alias("contigs"))


def signed_order(agp: DataFrame) -> DataFrame:
    """Contigs numbered by name over the whole layout; by chromosome the numbers in order, negative on the minus strand.

    Names are numbered by counting those before them, one row a contig.
    """
    index = agp.select("id").distinct().withColumn("k", F.row_number().over(Window.orderBy("id")))
    signed = agp.join(index, "id").withColumn("s", F.when(F.col("orientation") == "-", -F.col("k")).otherwise(F.col("k")))
    lists = signed.groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("number", "s"))).alias("l"))
    return lists.select("chrom", F.array_join(F.transform("l", lambda x: x["s"].cast("string")), " ").alias("line"))


def neighbours(agp: DataFrame) -> DataFrame:
    """Each contig with those before and after it."""
    w = Window.partitionBy("chrom").orderBy("number")
    return agp.select("chrom", "id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))


def balance(groups: DataFrame, group: str, length: str) -> DataFrame:
    """(max - min) / sum of the groups' lengths."""
    return groups.groupBy(group).agg(F.sum(length).alias("l")).agg(((F.max("l") - F.min("l")).cast("double") / F.sum("l")).alias("score"))


def gc_windows(sequences: DataFrame, size: int) -> DataFrame:
    """(chrom, start, stop, gc) of consecutive windows of each whole sequence (chrom, seq); the last is cut at its end."""
    from ..functions.scalars import gc_percent

    at = F.explode(F.when(F.length("seq") > 0, F.sequence(F.lit(0), F.length("seq") - 1, F.lit(size)))).alias("at")
    cut = sequences.select("chrom", F.length("seq").alias("length"), at, "seq").select("chrom", "length", "at", F.substring("seq", F.col("at") + 1, F.lit(size)).alias("part"))
    return cut.select("chrom", F.col("at").cast("long").alias("start"), F.least(F.col("at") + size, F.col("length")).cast("long").alias("stop"), gc_percent(F.col("part")).alias("gc"))
