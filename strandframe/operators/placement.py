"""Unplaced contigs go to groups one after another; what a contig brings to its group counts for those after it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, components

PLACED = "id string, grp string, n long, shared long"


def placed_contigs(contigs: DataFrame, groups: DataFrame, signals: DataFrame, genes: DataFrame, barred: DataFrame | None = None, without: list[str] = [], least: int = 10) -> DataFrame:  # noqa: B006
    """(id, grp, n, shared): the group of each contig that none of `groups` (id, grp) has, where one is found.

    Contigs (id, length) come by length, longest first, then by id. Candidates are the groups of contigs that a contig has signals (x, y, n) with,
    at the strongest, but for groups in `without` and those that `barred` (grp, id) keeps from it. It goes to the candidate that shares
    fewest genes (id, gene) with it, then the one of the strongest signal, then the first by name, if that signal is at least `least`; its genes are
    then the group's too. Contigs depend on each other only through genes that two of them have: such components are worked
    through alone, all others are placed by one sort.
    """
    both = signals.select("x", "y", "n").unionByName(signals.select(F.col("y").alias("x"), F.col("x").alias("y"), "n"))
    free = contigs.select("id", "length").dropDuplicates(["id"]).join(groups.select("id"), "id", "left_anti")
    able = both.join(groups.select(F.col("id").alias("y"), "grp"), "y").groupBy(F.col("x").alias("id"), "grp").agg(F.max("n").cast("long").alias("n")).where(~F.col("grp").isin(without) if without else F.lit(True))
    if barred is not None:
        able = able.join(barred.select("grp", "id"), ["grp", "id"], "left_anti")
    genes = genes.select("id", "gene").distinct()
    held = checkpointed(groups.select("id", "grp").join(genes, "id").select("grp", "gene").distinct())
    able = able.join(free, "id")
    own = checkpointed(genes.join(able.select("id").distinct(), "id", "left_semi"))
    shared = own.join(held, "gene").groupBy("id", "grp").agg(F.count(F.lit(1)).alias("shared"))
    able = checkpointed(able.join(shared, ["id", "grp"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long")))

    several = own.groupBy("gene").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gene")
    edges = own.join(several, "gene").select(F.concat(F.lit("c"), "id").alias("a"), F.concat(F.lit("g"), "gene").alias("b"))
    label = components(edges)
    label = checkpointed(label.where("node like 'c%'").select(F.substring("node", 2, 1 << 20).alias("id"), "label"))

    alone = able.join(label, "id", "left_anti").groupBy("id").agg(F.min(F.struct("shared", (-F.col("n")).alias("m"), "grp")).alias("b"))
    alone = alone.select("id", "b.grp", (-F.col("b.m")).alias("n"), "b.shared").where(F.col("n") >= least)

    have = own.join(several, "gene", "left_semi").join(held.groupBy("gene").agg(F.collect_list("grp").alias("in")), "gene", "left")
    rows = able.join(label, "id").select("label", "id", "length", "grp", "n", "shared", F.lit(None).cast("string").alias("gene"), F.lit(None).cast("array<string>").alias("in"))
    none = {"length": "long", "grp": "string", "n": "long", "shared": "long"}
    rows = rows.withColumn("length", F.col("length").cast("long")).unionByName(have.join(label, "id").select("label", "id", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "gene", "in"))

    def place(part: pd.DataFrame) -> pd.DataFrame:
        candidates, of, there, out = part[part["grp"].notna()], {}, {}, []
        for contig, gene, groups_of_gene in part.loc[part["gene"].notna(), ["id", "gene", "in"]].itertuples(index=False):
            of.setdefault(contig, []).append(gene)
            there[gene] = set(() if groups_of_gene is None else groups_of_gene)
        lengths = candidates.drop_duplicates("id").sort_values(["length", "id"], ascending=[False, True])["id"]
        by_contig = dict(list(candidates.groupby("id")))
        brought: dict[str, set[str]] = {}
        for contig in lengths:
            found = min((int(s) + sum(g in brought.get(grp, ()) for g in of.get(contig, ())), -int(n), grp) for grp, n, s in by_contig[contig][["grp", "n", "shared"]].itertuples(index=False))
            if -found[1] >= least:
                out.append((contig, found[2], -found[1], found[0]))
                brought.setdefault(found[2], set()).update(g for g in of.get(contig, ()) if found[2] not in there[g])
        return pd.DataFrame(out, columns=["id", "grp", "n", "shared"])

    return alone.select("id", "grp", "n", "shared").unionByName(rows.groupBy("label").applyInPandas(place, PLACED))
