"""Compartments: first-component values of bins, their signs, switches between samples and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import compartment, is_conserved, switch_type
from .graph import checkpointed
from .intervals import best_overlap, held_join, in_spans, overlap_join, points_in

#: Domains up to which the members of their classes may be broadcast, as counted; bytes of names that a task gives back at a time.
BROADCAST_DOMAINS, BYTES = 500_000, 1 << 23


def lengths(bg: DataFrame, zero_as: str = "A") -> DataFrame:
    """Bases and share of A and B by chromosome."""
    size = F.col("stop") - F.col("start")
    t = bg.withColumn("type", compartment(F.col("score"), zero_as)).withColumn("size", size)
    n = t.groupBy("chrom").agg(F.sum(F.when(F.col("type") == "A", F.col("size")).otherwise(0)).alias("a"), F.sum(F.when(F.col("type") == "B", F.col("size")).otherwise(0)).alias("b"))
    return n.withColumn("a_rate", F.when(F.col("a") + F.col("b") > 0, F.col("a").cast("double") / (F.col("a") + F.col("b"))))


def length_of_chromosome(bg: DataFrame) -> DataFrame:
    """A and B as percent of the chromosome's last position; zeros count as neither."""
    t = bg.withColumn("type", compartment(F.col("score"), "drop")).withColumn("size", F.col("stop") - F.col("start"))
    part = lambda k: F.sum(F.when(F.col("type") == k, F.col("size")).otherwise(0)).cast("double") * 100 / F.max("stop")
    return t.groupBy("chrom").agg(part("A").alias("a_percent"), part("B").alias("b_percent"))


def lengths_with_total(bg: DataFrame) -> DataFrame:
    """A and B bases by chromosome and, under a null chromosome, in all; zeros count as neither."""
    size = F.col("stop") - F.col("start")
    return bg.where("score <> 0").rollup("chrom").agg(F.sum(F.when(F.col("score") > 0, size).otherwise(0)).alias("a"), F.sum(F.when(F.col("score") < 0, size).otherwise(0)).alias("b"))


def genome_size(bg: DataFrame) -> DataFrame:
    return bg.groupBy("chrom").agg(F.max("stop").alias("last")).agg(F.sum("last").alias("size"))


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Bins of two samples side by side, by chromosome and start."""
    return first.select("chrom", "start", "stop", F.col("score").alias("v1")).join(second.select("chrom", "start", F.col("score").alias("v2")), ["chrom", "start"])


def switches(pairs: DataFrame, zero_as: str = "B") -> DataFrame:
    """Number and bases of bins by switch type."""
    return pairs.groupBy(switch_type(F.col("v1"), F.col("v2"), zero_as).alias("type")).agg(F.count(F.lit(1)).alias("bins"), F.sum(F.col("stop") - F.col("start")).alias("bases"))


def conserved(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(is_conserved(F.col("v1"), F.col("v2")).alias("conserved")).agg(F.count(F.lit(1)).alias("bins"))


def switch_links(pairs: DataFrame, types: list[str], shrink: int) -> DataFrame:
    """Links of bins whose compartment switches, each end drawn in by `shrink` at its start; both stops move outward."""
    t = pairs.withColumn("type", switch_type(F.col("v1"), F.col("v2"))).where(F.col("type").isin(types))
    return t.select("chrom", (F.col("start") + shrink).alias("start1"), (F.col("stop") - shrink).alias("stop1"), (F.col("start") + shrink).alias("start2"), (F.col("stop") + shrink).alias("stop2"), "type")


def correlation(pairs: DataFrame, by: list[Column | str]) -> DataFrame:
    """Pearson's r of two samples by group; null for fewer than two bins."""
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("bins"), F.when(F.count(F.lit(1)) >= 3, F.round(F.corr("v1", "v2"), 6)).alias("r"))


def sign_flips(pairs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Bins that go from A to B, and from B to A, by at least `least`."""
    far = pairs.where(F.abs(F.col("v1") - F.col("v2")) >= least)
    return far.where("v1 > 0 and v2 < 0"), far.where("v1 < 0 and v2 > 0")


def gene_pairs(anchors: DataFrame, genes1: DataFrame, bg1: DataFrame, genes2: DataFrame, bg2: DataFrame, fraction: float = 0.51) -> DataFrame:
    """Anchors (line_no, gene1, gene2) with the value of the bin that holds most of each gene; those of which either is missing go."""
    value = lambda genes, bg, k: overlap_join(genes.select("chrom", "start", "stop", "gene"), bg.select("chrom", "start", "stop", "score"), fraction_a=fraction).select(F.col("gene").alias(f"gene{k}"), F.col("b_score").alias(f"v{k}"))
    return anchors.select("line_no", "gene1", "gene2").join(value(genes1, bg1, 1), "gene1").join(value(genes2, bg2, 2), "gene2")


def beside(first: DataFrame, second: DataFrame, order: list[str]) -> DataFrame:
    """Rows of two tables side by side by position, in an order that must be total; the second's columns end in 2.

    Rows are numbered along ranges of the order, so no task sorts all of them; what one table has beyond the other goes.
    """
    return positioned(first, order).join(positioned(second.select(*[F.col(c).alias(f"{c}2") for c in second.columns]), [f"{c}2" for c in order]), "place")


def positioned(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``place``, their number from 0 in an order. Groups of the first column are counted first, one row a value."""
    w = Window.partitionBy(order[0]).orderBy(*order)
    n = rows.groupBy(order[0]).agg(F.count(F.lit(1)).alias("__n"))
    before = n.select(order[0], F.coalesce(F.sum("__n").over(Window.orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.withColumn("__k", F.row_number().over(w) - 1).join(before, order[0]).withColumn("place", F.col("__before") + F.col("__k")).drop("__before", "__k")


def flips_of_links(links: DataFrame, bg1: DataFrame, bg2: DataFrame, least: float = 0.005) -> DataFrame:
    """Links (chrom1, start1, stop1, chrom2, start2, stop2, ...) whose midpoints lie in bins of opposite signs that differ by at
    least `least`, with ``way``: a2b where the first is above zero. Links of which a midpoint is in no bin go."""
    rows = links
    for k, bg in ((1, bg1), (2, bg2)):
        middle = F.floor((F.col(f"stop{k}") - F.col(f"start{k}")) / 2) + F.col(f"start{k}")
        at = rows.withColumn("chrom", F.col(f"chrom{k}")).withColumn("pos", middle)
        rows = points_in(at, bg.select("chrom", "start", "stop", "score"), closed=False).withColumnRenamed("b_score", f"v{k}").drop("chrom", "pos", "b_chrom", "b_start", "b_stop")
    rows = rows.where((F.col("v1") * F.col("v2") < 0) & (F.abs(F.col("v1") - F.col("v2")) >= least))
    return rows.withColumn("way", F.when(F.col("v1") > F.col("v2"), "a2b").otherwise("b2a"))


def conserved_domains(domains1: DataFrame, genes1: DataFrame, domains2: DataFrame, genes2: DataFrame, anchors: DataFrame, fraction: float = 0.7, least_share: float = 0.0, least_genes: int = 0, least_anchored: int = 0) -> DataFrame:
    """Pairs of domains that anchors (gene1, gene2, line_no) join, a gene being of a domain that holds at least `fraction` of it (of several, the
    one with most of it, then the first): their genes, those of them in anchors, the joining anchors, their shares of either, and the genes' names
    in the anchors' order. Pairs whose counts or shares lie below the thresholds are left out; pairs that share nothing are never listed."""

    def side(domains: DataFrame, genes: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        held = best_overlap(genes.select("chrom", "start", "stop", "gene"), domains, fraction)
        one = held.groupBy("gene").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "chrom", "b_start", "b_stop")).alias("d")).select("gene", F.concat_ws(":", "d.chrom", "d.b_start", "d.b_stop").alias(f"domain{k}"))
        one = checkpointed(one)
        linked = anchors.select(F.col(f"gene{k}").alias("gene")).distinct().withColumn("__linked", F.lit(1))
        many = one.join(linked, "gene", "left").groupBy(f"domain{k}").agg(F.count(F.lit(1)).alias(f"genes{k}"), F.count("__linked").alias(f"anchored{k}"))
        return one.withColumnRenamed("gene", f"gene{k}"), many

    (of1, many1), (of2, many2) = side(domains1, genes1, 1), side(domains2, genes2, 2)
    pairs = anchors.select("gene1", "gene2", "line_no").join(of1, "gene1").join(of2, "gene2")
    pairs = pairs.groupBy("domain1", "domain2").agg(F.count(F.lit(1)).alias("pairs"), F.array_sort(F.collect_list(F.struct("line_no", "gene1", "gene2"))).alias("g"))
    names = [F.array_join(F.col(f"g.gene{k}"), ",").alias(f"names{k}") for k in (1, 2)]
    out = pairs.join(many1, "domain1").join(many2, "domain2")
    share = lambda c: F.col("pairs").cast("double") / F.col(c)
    out = out.select("domain1", "domain2", "pairs", "genes1", "genes2", "anchored1", "anchored2", share("genes1").alias("share1"), share("genes2").alias("share2"), share("anchored1").alias("anchored_share1"), share("anchored2").alias("anchored_share2"), *names)
    return out.where((F.least("share1", "share2") >= least_share) & (F.least("genes1", "genes2") >= least_genes) & (F.least("anchored1", "anchored2") >= least_anchored))


def domain_pairs(domains: DataFrame, genes: DataFrame, anchors: DataFrame, fraction: float = 0.7) -> DataFrame:
    """(s1, s2, pairs, genes): pairs of domains that anchors (gene1, gene2) join, a gene being of each domain that holds at least a fraction, above
    one half, of it: how many do, and their first genes by name, comma-joined. Rows that repeat count each time.

    Neither genes by domain nor pairs are shuffled. Domains that hold the same second genes are one class; each first domain meets its genes in a
    block of bases, names are put together once a class, and classes are dealt out to their domains at the end.
    """
    spot = F.concat_ws(":", "chrom", "start", "stop")
    counted = domains.groupBy("chrom", "start", "stop").agg(F.count(F.lit(1)).alias("times"))
    placed = genes.select("chrom", "start", "stop", "gene")
    second = placed.join(anchors.select(F.col("gene2").alias("gene")).distinct(), "gene", "left_semi")
    of2 = held_join(counted, second, fraction).select(spot.alias("s2"), F.col("b_gene").alias("gene"), "times").groupBy("s2", "gene").agg(F.sum("times").alias("w"))
    classes = of2.groupBy("s2").agg(F.sort_array(F.collect_list(F.struct("gene", "w"))).alias("c"))
    classes = checkpointed(classes.groupBy("c").agg(F.min("s2").alias("class"), F.collect_list("s2").alias("members")))
    members = classes.select("class", F.explode("members").alias("s2"))
    if members.count() <= BROADCAST_DOMAINS:
        members = F.broadcast(members)

    first = placed.withColumnRenamed("gene", "gene1").join(anchors.select("gene1", "gene2"), "gene1")
    rows, near = in_spans(counted, first.where("stop >= start"))
    block = ["chrom", "__level", "__block"]
    wanted = near.select(*block, "gene2").distinct().join(classes.select("class", F.explode("c.gene").alias("gene2")), "gene2").select(*block, "class").distinct()
    wanted = wanted.join(classes.select("class", "c"), "class")
    shape = [("start", "long"), ("stop", "long"), ("times", "long"), ("gene1", "string"), ("gene2", "string"), ("class", "string"), ("c", "array<struct<gene:string,w:bigint>>")]
    part = lambda df, k: df.select(*block, F.lit(k).alias("__part"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in shape])
    # Of a block the genes come first, then the classes that they lead to, then its domains, one after another.
    mixed = part(near, 0).unionByName(part(wanted, 1)).unionByName(part(rows, 2))
    tasks = int(domains.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = mixed.repartition(tasks, *block).sortWithinPartitions(*block, "__part")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, leads, table, out, size = None, [], [], None, [], 0

        def batch() -> pa.RecordBatch:
            s1, of, n, names = zip(*out, strict=True)
            return pa.RecordBatch.from_pydict({"s1": pa.array(s1, pa.string()), "class": pa.array(of, pa.string()), "pairs": pa.array(n, pa.int64()), "genes": pa.array(names, pa.string())})

        for b in batches:
            for r in b.to_pylist():
                key = (r["chrom"], r["__level"], r["__block"])
                if key != here:
                    here, held, leads, table = key, [], [], None
                if r["__part"] == 0:
                    held.append((r["gene1"], r["gene2"], r["start"], r["stop"]))
                elif r["__part"] == 1:
                    leads.append((r["class"], [(x["gene"], x["w"]) for x in r["c"]]))
                elif held and leads:
                    if table is None:
                        held.sort()
                        code = {g: k for k, g in enumerate(sorted({x[1] for x in held}))}
                        table = [x[0] for x in held], np.array([code[x[1]] for x in held]), np.array([x[2] for x in held]), np.array([x[3] for x in held])
                        leads = [(c, [(code[g], w) for g, w in gs if g in code]) for c, gs in leads]
                    names, gene2, starts, stops = table
                    over = np.minimum(stops, r["stop"]) - np.maximum(starts, r["start"])
                    mine = np.flatnonzero((starts < r["stop"]) & (stops > r["start"]) & (over >= fraction * (stops - starts)))
                    mine = mine[np.argsort(gene2[mine], kind="stable")]
                    cuts = np.searchsorted(gene2[mine], np.arange(len(code) + 1))
                    for name, gs in leads:
                        parts = [np.repeat(mine[cuts[g] : cuts[g + 1]], w * r["times"]) if w * r["times"] > 1 else mine[cuts[g] : cuts[g + 1]] for g, w in gs]
                        all_ = parts[0] if len(parts) == 1 else np.sort(np.concatenate(parts))
                        if len(all_):
                            text = ",".join([names[i] for i in all_.tolist()])
                            out.append((f"{r['chrom']}:{r['start']}:{r['stop']}", name, len(all_), text))
                            size += len(text) + 100
                            if size >= BYTES:
                                yield batch()
                                out, size = [], 0
        if out:
            yield batch()

    found = mixed.mapInArrow(joined, "s1 string, class string, pairs long, genes string")
    return found.join(members, "class").select("s1", "s2", "pairs", "genes")
