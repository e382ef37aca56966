"""Orthologous pairs, alignments of contigs, gene evidence and copy numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_hits(hits: DataFrame) -> DataFrame:
    """(qseqid, sseqid, bitscore, identity): each query's best hit by bit score, then identity, then the target's name."""
    best = F.min(F.struct((-F.col("bitscore")).alias("b"), (-F.col("identity")).alias("i"), F.col("sseqid").alias("s")))
    return hits.groupBy("qseqid").agg(best.alias("h")).select("qseqid", F.col("h.s").alias("sseqid"), (-F.col("h.b")).alias("bitscore"), (-F.col("h.i")).alias("identity"))


def orthologs(a_genes: DataFrame, b_genes: DataFrame, a_to_b: DataFrame, b_to_a: DataFrame) -> DataFrame:
    """(gene_a, gene_b, kind) of two gene sets (column gene): `reciprocal` for genes that are each other's best hit, then `best`
    for a gene of A left over whose best hit is left over too; of several with one best hit, the first by name takes it."""
    ab = best_hits(a_to_b).select(F.col("qseqid").alias("gene_a"), F.col("sseqid").alias("gene_b"))
    ab = ab.join(a_genes.select(F.col("gene").alias("gene_a")).distinct(), "gene_a", "left_semi").join(b_genes.select(F.col("gene").alias("gene_b")).distinct(), "gene_b", "left_semi")
    ba = best_hits(b_to_a).select(F.col("sseqid").alias("gene_a"), F.col("qseqid").alias("gene_b"))
    both = ab.join(ba, ["gene_a", "gene_b"], "left_semi")
    left = ab.join(both, "gene_a", "left_anti").join(both, "gene_b", "left_anti")
    one_way = left.groupBy("gene_b").agg(F.min("gene_a").alias("gene_a")).select("gene_a", "gene_b")
    return both.withColumn("kind", F.lit("reciprocal")).unionByName(one_way.withColumn("kind", F.lit("best")))


def with_paralogs(pairs: DataFrame, a_genes: DataFrame, b_genes: DataFrame, hits: DataFrame) -> DataFrame:
    """pairs with ``paralogs``, a sorted array, and rows of kind `none`, with one gene null, for genes that are nowhere else.

    hits lead from genes of pairs to genes of none. Of each gene's hits its best counts; a gene of none goes to the pair that
    has the most identical such hit to it, and of equals to the last by kind (best before reciprocal) and names.
    """
    paired = pairs.select(F.explode(F.array("gene_a", "gene_b")).alias("gene"))
    off = hits.join(paired.select(F.col("gene").alias("sseqid")), "sseqid", "left_anti").join(paired.select(F.col("gene").alias("qseqid")), "qseqid", "left_semi")
    best = best_hits(off).select(F.col("qseqid").alias("gene"), F.col("sseqid").alias("paralog"), "identity")
    rows = pairs.select("gene_a", "gene_b", "kind", F.explode(F.array("gene_a", "gene_b")).alias("gene"))
    where = F.max(F.struct("identity", F.when(F.col("kind") == "best", 1).otherwise(0).alias("k"), "gene_a", "gene_b")).alias("w")
    placed = rows.join(best, "gene").groupBy("paralog").agg(where)
    lists = placed.groupBy(F.col("w.gene_a").alias("gene_a"), F.col("w.gene_b").alias("gene_b")).agg(F.sort_array(F.collect_list("paralog")).alias("paralogs"))
    known = paired.unionByName(placed.select(F.col("paralog").alias("gene")))
    none = F.array().cast("array<string>")
    alone = [g.select("gene").distinct().join(known, "gene", "left_anti").select(a.alias("gene_a"), b.alias("gene_b"), F.lit("none").alias("kind"), none.alias("paralogs"))
             for g, a, b in ((a_genes, F.col("gene"), F.lit(None).cast("string")), (b_genes, F.lit(None).cast("string"), F.col("gene")))]
    table = pairs.join(lists, ["gene_a", "gene_b"], "left").withColumn("paralogs", F.coalesce("paralogs", none))
    return table.unionByName(alone[0]).unionByName(alone[1])


def suppressed(hits: DataFrame, most: float = 0.1) -> DataFrame:
    """Hits (q, t, score, start, stop on q) of a query to a target without those that overlap a better kept one by more than a
    fraction of their own length. Better: by score, start, stop, the larger first.

    Hits that no chain of overlaps joins do not touch each other, so each such island is worked through by itself; there may be
    millions, of a few hits each, so that is an expression, not a call of Python an island.
    """
    ordered = Window.partitionBy("q", "t").orderBy("start", "stop")
    before = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("start") >= before).cast("int"), F.lit(0))
    rows = hits.select("q", "t", F.col("score").cast("long").alias("score"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    rows = rows.withColumn("__new", begins).withColumn("__island", F.sum("__new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy("q", "t", "__island").agg(F.sort_array(F.collect_list(F.struct("score", "start", "stop")), asc=False).alias("__hits"))
    hides = lambda k, h: F.least(h["stop"], k["stop"]) - F.greatest(h["start"], k["start"]) > F.lit(float(most)) * (h["stop"] - h["start"])
    none = F.slice("__hits", 1, 0)
    kept = F.aggregate("__hits", none, lambda kept, h: F.when(F.exists(kept, lambda k: hides(k, h)), kept).otherwise(F.concat(kept, F.array(h))))
    one = F.when(F.size("__hits") == 1, F.col("__hits")).otherwise(kept)
    return islands.select("q", "t", F.explode(one).alias("h")).select("q", "t", "h.score", "h.start", "h.stop")


def contig_targets(hits: DataFrame, sizes: DataFrame, identity: float, overlap: float) -> DataFrame:
    """(q, t, score, aligned, identity, overlap): the best target of each contig q by the score summed over its hits, ties to the
    first by name, among targets of at least that identity and share of the contig (sizes: q, size)."""
    sums = hits.groupBy("q", "t").agg(F.sum("score").alias("score"), F.sum(F.col("stop") - F.col("start")).alias("total")).join(sizes.select("q", "size"), "q")
    same = (F.col("score") + (F.col("total") - F.col("score")) / 2) / F.col("total")
    aligned = F.least("total", "size")
    valid = sums.select("q", "t", "score", aligned.alias("aligned"), same.alias("identity"), (aligned / F.col("size")).alias("overlap")).where((F.col("identity") >= identity) & (F.col("overlap") >= overlap))
    best = valid.groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("s"), "t", "aligned", "identity", "overlap")).alias("h"))
    return best.select("q", "h.t", (-F.col("h.s")).alias("score"), "h.aligned", "h.identity", "h.overlap")


def gene_evidence(blast: DataFrame, domains: DataFrame, expression: DataFrame, coverage: DataFrame, support: DataFrame, fpkm: float = 1, cov: float = 0.5, share: float = 90) -> DataFrame:
    """Every gene of five tables with its evidence and a label, keep or remove.

    blast (gene, identity, length): hits of 30 percent and 100 residues count; domains (gene): a row a domain; expression
    (gene, fpkm), cut to whole numbers; coverage (gene, cov), two decimals; support (gene, support). Kept are genes with two
    hits, two domains, expression and coverage above their cuts, or support above its cut.
    """
    n = F.count(F.lit(1))
    tables = [
        blast.where("identity >= 30 and length >= 100").groupBy("gene").agg(n.alias("blast")),
        domains.groupBy("gene").agg(n.alias("pfam")),
        expression.groupBy("gene").agg(F.max("fpkm").cast("long").alias("fpkm")),
        coverage.groupBy("gene").agg(F.round(F.max("cov"), 2).alias("cov")),
        support.groupBy("gene").agg(F.max("support").alias("support")),
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, "gene", "full_outer")
    out = out.fillna(0, ["blast", "pfam", "fpkm", "cov", "support"])
    keep = (F.col("blast") > 1) | (F.col("pfam") > 1) | ((F.col("fpkm") > fpkm) & (F.col("cov") > cov)) | (F.col("support") > share)
    return out.withColumn("label", F.when(keep, "keep").otherwise("remove"))


def copy_numbers(depth: DataFrame, reads: DataFrame, read_length: int, genome_size: int) -> DataFrame:
    """(sample, gene, copies): a gene's coverage a base (depth: sample, gene, start, stop, coverage) over that of the genome by
    the sample's mapped reads (reads: sample, n)."""
    per_base = F.col("coverage") * read_length / F.abs(F.col("stop") - F.col("start"))
    return depth.join(reads.select("sample", "n"), "sample").select("sample", "gene", (per_base / (F.col("n") * F.lit(float(read_length)) / genome_size)).alias("copies"))


def ko_list(rows: DataFrame) -> DataFrame:
    """A row a gene and KO of (gene, kos): comma-joined, perhaps in quotes; genes without any keep one row with a null."""
    return rows.select("gene", F.explode(F.split(F.coalesce(F.regexp_replace("kos", '"', ""), F.lit("")), ",")).alias("ko")).withColumn("ko", F.nullif("ko", F.lit("")))
