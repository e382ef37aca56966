"""Annotation trees: positions of a transcript's coding bases on the genome, and features renamed with all that lies below them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import attribute
from .graph import checkpointed


def coding_parts(gff: DataFrame, by_strand: bool = False) -> DataFrame:
    """(parent, chrom, strand, start, stop, first, last): CDS rows with the places, from 1, that their bases have in their transcript's
    coding sequence, by start; with by_strand, those of transcripts on the minus strand from the far end on."""
    c = gff.where("type = 'CDS'").select(attribute(F.col("attributes"), "Parent").alias("parent"), "chrom", "strand", "start", "stop").where("parent is not null")
    place = F.when(F.col("strand") == "-", -F.col("stop")).otherwise(F.col("start")) if by_strand else F.col("start")
    w = Window.partitionBy("parent").orderBy(place, "stop").rowsBetween(Window.unboundedPreceding, 0)  # a transcript's few exons
    size = F.col("stop") - F.col("start") + 1
    last = F.sum(size).over(w)
    return c.withColumn("last", last).withColumn("first", F.col("last") - size + 1).select("parent", "chrom", "strand", "start", "stop", "first", "last")


def gene_of_transcript(gff: DataFrame) -> DataFrame:
    """(parent, gene, gene_start, gene_stop) of each transcript."""
    m = gff.where("type = 'mRNA'").select(attribute(F.col("attributes"), "ID").alias("parent"), attribute(F.col("attributes"), "Parent").alias("gene"))
    g = gff.where("type = 'gene'").select(attribute(F.col("attributes"), "ID").alias("gene"), F.col("start").alias("gene_start"), F.col("stop").alias("gene_stop"))
    return m.join(g, "gene")


def genome_positions(gff: DataFrame, positions: DataFrame, by_strand: bool = False) -> DataFrame:
    """positions (parent, pos: a place, from 1, in the transcript's coding sequence) with the base that it is on the genome and where, in per
    cent, that lies in its gene. Within an exon both run alike, so a position meets its exon by range and moves by one offset.
    Places outside the coding sequence and transcripts without a gene are left out."""
    at = positions.join(coding_parts(gff, by_strand), "parent").where(F.col("pos").between(F.col("first"), F.col("last")))
    ahead = F.col("pos") - F.col("first")
    base = F.when(F.col("strand") == "-", F.col("stop") - ahead).otherwise(F.col("start") + ahead) if by_strand else F.col("start") + ahead
    at = at.withColumn("base", base).join(gene_of_transcript(gff), "parent")
    share = (F.col("base") - F.col("gene_start")).cast("double") / (F.col("gene_stop") - F.col("gene_start") + 1) * 100
    return at.select(*positions.columns, "chrom", "base", "gene", share.alias("percent"))


def subtrees(gff: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root): each root's id and the ids of all features below it by the Parent attribute, at any depth. roots: one column of ids."""
    parent = F.explode_outer(F.split(attribute(F.col("attributes"), "Parent"), ","))
    edges = checkpointed(gff.select(attribute(F.col("attributes"), "ID").alias("id"), parent.alias("parent")).where("id is not null and parent is not null").distinct())
    known = checkpointed(roots.select(F.col(roots.columns[0]).alias("id")).where("id is not null").distinct().withColumn("root", F.col("id")))
    fresh = known
    while not fresh.isEmpty():
        below = fresh.join(edges, fresh["id"] == edges["parent"]).select(edges["id"], "root").distinct()
        fresh = checkpointed(below.join(known, ["id", "root"], "left_anti"))  # what is known ends loops of parents
        known = checkpointed(known.unionByName(fresh))
    return known


def renamed_subtrees(gff: DataFrame, names: DataFrame) -> DataFrame:
    """Features named in (old, new) and all below them, with ``old`` and their attributes rewritten: the old name gives way to the new one
    wherever it stands whole in a value of ID, Parent or any other attribute, also before a suffix as in old.t1, but not in longer names such
    as old2. A feature below several renamed ones comes once for each."""
    ids = subtrees(gff, names.select("old"))
    own, above = attribute(F.col("attributes"), "ID"), F.split(attribute(F.col("attributes"), "Parent"), ",")
    rows = gff.withColumn("__up", F.array_distinct(F.array_compact(F.concat(F.array(own), F.coalesce(above, F.array().cast("array<string>"))))))
    rows = rows.withColumn("__key", F.xxhash64(*gff.columns)).withColumn("__id", F.explode("__up"))
    hit = rows.join(ids, rows["__id"] == ids["id"]).drop("__id", "id", "__up").dropDuplicates(["__key", "root"]).drop("__key")
    hit = hit.join(names.select(F.col("old").alias("root"), "new"), "root").withColumnRenamed("root", "old")
    pattern = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.col("old"), F.lit(r"\E(?![A-Za-z0-9_])"))
    return hit.withColumn("attributes", F.regexp_replace("attributes", pattern, F.regexp_replace("new", r"([\\$])", r"\\$1"))).select("old", *gff.columns)
