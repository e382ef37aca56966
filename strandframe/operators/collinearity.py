"""Allele tables from collinear gene pairs: chains of keyed merges, then duplicates, rescue and tandem genes.

Links are (gene1, gene2, hap1, hap2, line_no); line_no orders them as in their file. A wide table has a column ``gene<H>`` a haplotype.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, components

#: Kinds of links in the order in which they are worked in.
HOMOLOG, INTRA, ELSEWHERE, TANDEM = "homolog", "intra", "elsewhere", "tandem"


def kinds(links: DataFrame, chrom1: str = "chrom1", chrom2: str = "chrom2", hap_letters: int = 1) -> DataFrame:
    """links with ``kind``: intra on one chromosome, homolog between haplotypes of one chromosome, elsewhere on different ones. A
    chromosome's name without its last letters is that of the chromosome in all haplotypes."""
    base = lambda c: F.expr(f"substring({c}, 1, greatest(length({c}) - {hap_letters}, 0))")
    return links.withColumn("kind", F.when(F.col(chrom1) == F.col(chrom2), INTRA).when(base(chrom1) == base(chrom2), HOMOLOG).otherwise(ELSEWHERE))


def in_order(links: DataFrame, names: list[str]) -> DataFrame:
    """Links whose first gene is of the earlier haplotype; others turned round, links within a haplotype or of others left out."""
    place = lambda c: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    turned = links.select(F.col("gene2").alias("gene1"), F.col("gene1").alias("gene2"), F.col("hap2").alias("hap1"), F.col("hap1").alias("hap2"), "line_no")
    return links.select(*turned.columns).unionByName(turned).where((place("hap1") > 0) & (place("hap1") < place("hap2")))


def _pairs(links: DataFrame, first: str, second: str, keep_first: bool) -> DataFrame:
    found = links.where((F.col("hap1") == first) & (F.col("hap2") == second))
    if keep_first:
        return found.groupBy(F.col("gene1").alias(f"gene{first}")).agg(F.min_by("gene2", F.struct("line_no", "gene2")).alias(f"gene{second}"))
    return found.select(F.col("gene1").alias(f"gene{first}"), F.col("gene2").alias(f"gene{second}")).distinct()


def merged(table: DataFrame, pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer merge on a gene column: `value` comes from the pairs, null where they lack the key. Rows without a key, which may be
    most of them, go past the join."""
    rest = [c for c in table.columns if c != value]
    joined = table.where(F.col(key).isNotNull()).select(*rest).join(pairs, key, "full_outer")
    return joined.select(*table.columns).unionByName(table.where(F.col(key).isNull()).withColumn(value, F.lit(None).cast("string")))


def _empty(links: DataFrame, names: list[str]) -> DataFrame:
    return links.sparkSession.createDataFrame([], ", ".join(f"gene{n} string" for n in names))


def synteny_table(links: DataFrame, names: list[str], keep_first: bool = True) -> DataFrame:
    """Alleles from pairs of haplotypes by one chain of outer merges, each on the earlier haplotype's genes: A with B, C, D, then B with
    C, D, and so on; a later merge writes its column anew. Rows of two or more genes are kept, equal ones once."""
    links, out = in_order(links, names), _empty(links, names)
    for i, first in enumerate(names):
        for second in names[i + 1 :]:
            out = merged(out, _pairs(links, first, second, keep_first), f"gene{first}", f"gene{second}")
        out = checkpointed(out)  # else each merge's plan holds the plans of all before it twice
    filled = sum((F.col(c).isNotNull().cast("int") for c in out.columns), F.lit(0))
    return out.where(filled >= 2).distinct()


def first_of_each(table: DataFrame, columns: list[str]) -> DataFrame:
    """Column by column, of the rows with one gene only the first by all columns stays, nulls last; rows without a gene there stay."""
    order = [F.col(c).asc_nulls_last() for c in columns]
    for c in columns:
        # Rows without a gene are dealt out by all their columns, not to one task.
        key = F.when(F.col(c).isNull(), F.xxhash64(*columns)).otherwise(F.xxhash64(F.col(c)))
        w = Window.partitionBy(key, c).orderBy(*order)
        table = table.withColumn("__r", F.row_number().over(w)).where((F.col("__r") == 1) | F.col(c).isNull()).drop("__r")
    return table


def collinear_table(links: DataFrame, names: list[str], keep_first: bool = True) -> DataFrame:
    """Alleles from collinear pairs: the first haplotype's genes with their partners in all others; then the second's that are in no
    such row, with theirs, and so on; last, each gene once in its column (first_of_each). A gene's partner is that of its first line;
    with keep_first off the first haplotype's genes are merged with all partners, and their names decide."""
    links, columns, tables = in_order(links, names), [f"gene{n}" for n in names], []
    for i, first in enumerate(names[:-1]):
        one = reduce(lambda a, b: a.join(b, f"gene{first}", "full_outer"), [_pairs(links, first, second, keep_first or i > 0) for second in names[i + 1 :]])  # noqa: B023
        for known in tables:
            if f"gene{first}" in known.columns:
                one = one.join(known.select(f"gene{first}").where(F.col(f"gene{first}").isNotNull()).distinct(), f"gene{first}", "left_anti")
        tables.append(checkpointed(one))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else _empty(links, names)
    return first_of_each(whole.select(*columns), columns)


@dataclass(eq=False)
class Row:
    """An allele while links are worked in: a gene a slot, and further genes in order."""

    slots: dict[str, str]
    dups: list[str] = field(default_factory=list)

    def genes(self) -> set[str]:
        return {*self.slots.values(), *self.dups}

    def put(self, gene: str, hap: str | None) -> None:
        """Into the haplotype's slot if that is free, else among the further genes."""
        if gene in self.genes():
            return
        if hap and hap not in self.slots:
            self.slots[hap] = gene
        else:
            self.dups.append(gene)


def work_in(rows: list[Row], links: list[tuple[str, str, str | None, str | None, str]]) -> list[Row]:
    """The alleles after all links (gene1, gene2, hap1, hap2, kind), which come in order of their lines:

    1. a gene in no allele goes to all alleles whose slot holds a homolog of it, first genes, then second genes of the links;
    2. of the alleles that share a further gene the one with most genes takes in the others;
    3. homologs of which one is still in no allele: it joins the first allele of the other, or both found a new one;
    4. links within a haplotype, then those to other chromosomes: a gene joins the one allele of its partner; a pair in no allele founds one;
    5. tandem partners of an allele's genes become further genes; pairs in no allele found one.
    """
    of_kind = lambda kind: [x for x in links if x[4] == kind]
    holding: dict[str, list[Row]] = {}

    def note(row: Row, *genes: str) -> None:
        for g in genes:
            if row not in holding.setdefault(g, []):
                holding[g].append(row)

    def found(first: str, hap: str | None, *more: tuple[str, str | None]) -> None:
        row = Row({hap: first}) if hap else Row({}, [first])
        for gene, at in more:
            row.put(gene, at)
        rows.append(row)
        note(row, *row.genes())

    for row in rows:
        note(row, *row.genes())
    homologs = of_kind(HOMOLOG)
    unmapped = {g for x in homologs for g in x[:2]} - set(holding)
    for new, old in ((0, 1), (1, 0)):
        waiting = set(unmapped)
        for x in homologs:
            if x[new] in waiting and x[old] not in waiting:
                for row in list(holding.get(x[old], ())):
                    if row.slots.get(x[2 + old]) == x[old]:
                        row.put(x[new], x[2 + new])
                        note(row, x[new])
                        unmapped.discard(x[new])
    shared = dict.fromkeys(g for row in rows for g in row.dups)
    for gene in shared:
        holders = [r for r in holding[gene] if r in rows]
        if len([r for r in holders if gene in r.dups]) < 2:
            continue
        holders.sort(key=lambda r: -(len(r.slots) + len(r.dups)))  # equal ones as they stand
        for other in holders[1:]:
            rows.remove(other)
            for g in sorted(other.genes()):
                holding[g].remove(other)
                if g not in holders[0].genes():
                    holders[0].dups.append(g)
                    note(holders[0], g)
    for a, b, hap_a, hap_b, _ in homologs:
        if a in unmapped or b in unmapped:
            if holding.get(a):
                holding[a][0].put(b, hap_b)
                note(holding[a][0], b)
            elif holding.get(b):
                holding[b][0].put(a, hap_a)
                note(holding[b][0], a)
            else:
                found(a, hap_a, (b, hap_b))
    for kind in (INTRA, ELSEWHERE):
        for a, b, hap_a, hap_b, _ in of_kind(kind):
            if hap_a is None or (kind == ELSEWHERE and hap_b is None):
                continue
            held = [r for r in rows if r in holding.get(a, []) or r in holding.get(b, [])] if holding.get(a) or holding.get(b) else []
            if not held:
                found(a, hap_a, (b, None))
            elif len(held) == 1 and len({a, b} - held[0].genes()) == 1:
                (gene,) = {a, b} - held[0].genes()
                held[0].put(gene, (hap_b if gene == b else hap_a) if kind == INTRA else None)
                note(held[0], gene)
    tandem = of_kind(TANDEM)
    at_first = {g: list(r) for g, r in holding.items()}
    for a, b, hap_a, _, _ in tandem:
        for gene, partner in ((a, b), (b, a)):
            for row in at_first.get(partner, ()):
                row.put(gene, None)
                note(row, gene)
        if not holding.get(a) and not holding.get(b) and hap_a:
            found(a, hap_a, (b, None))
    return rows


def expanded_table(table: DataFrame, links: DataFrame, names: list[str]) -> DataFrame:
    """(allele_id, hap, gene, nth): the alleles of a wide table, with the genes that links (gene1, gene2, hap1, hap2, line_no, kind) add; hap
    is null for further genes, nth numbers them. See work_in for the rules.

    The rules take links in the order of their lines, but an allele is touched only by links that a chain of genes joins to it: each
    such component is worked through alone. A new allele is named after its first gene.
    """
    columns = [f"gene{n}" for n in names]
    table = table.select(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in columns]).alias("allele_id"), *columns)
    cells = checkpointed(table.select("allele_id", F.explode(F.array(*[F.struct(F.lit(n).alias("hap"), F.col(c).alias("gene")) for n, c in zip(names, columns, strict=True)])).alias("c")).select("allele_id", "c.hap", "c.gene").where("gene is not null"))
    g = lambda c: F.concat(F.lit("g"), F.col(c))
    links = links.where("gene1 is not null and gene2 is not null and gene1 <> gene2").select("gene1", "gene2", *[F.when(F.col(h).isin(names), F.col(h)).alias(h) for h in ("hap1", "hap2")], "line_no", "kind")
    edges = cells.select(F.concat(F.lit("a"), "allele_id").alias("a"), g("gene").alias("b")).unionByName(links.select(g("gene1").alias("a"), g("gene2").alias("b")))
    label = checkpointed(components(edges))
    cells = cells.join(label.withColumnRenamed("node", "__n"), F.col("__n") == g("gene")).select("label", "allele_id", F.col("hap").alias("hap1"), F.lit(None).cast("string").alias("hap2"), F.col("gene").alias("gene1"), F.lit(None).cast("string").alias("gene2"), F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("kind"))
    linked = links.join(label.withColumnRenamed("node", "__n"), F.col("__n") == g("gene1")).select("label", F.lit(None).cast("string").alias("allele_id"), "hap1", "hap2", "gene1", "gene2", F.col("line_no").cast("long"), "kind")

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.astype(object).where(part.notna(), None)
        alleles: dict[str, Row] = {}
        for r in part[part["allele_id"].notna()].sort_values(["allele_id", "hap1"]).itertuples():
            alleles.setdefault(r.allele_id, Row({})).slots[r.hap1] = r.gene1
        own = part[part["allele_id"].isna()].sort_values(["line_no", "gene1", "gene2"])
        id_of = {id(row): name for name, row in alleles.items()}
        rows = work_in(list(alleles.values()), list(own[["gene1", "gene2", "hap1", "hap2", "kind"]].itertuples(index=False, name=None)))
        out = []
        for row in rows:
            name = id_of.get(id(row)) or "+" + next(iter([*row.slots.values(), *row.dups]))
            out += [(name, hap, gene, None) for hap, gene in row.slots.items()] + [(name, None, gene, k) for k, gene in enumerate(row.dups, 1)]
        return pd.DataFrame(out, columns=["allele_id", "hap", "gene", "nth"]).astype({"nth": "Int64"})

    return cells.unionByName(linked).groupBy("label").applyInPandas(grow, "allele_id string, hap string, gene string, nth long")


def final_kinds(cells: DataFrame, genes: DataFrame, tandem: DataFrame, hap_letters: int = 1) -> DataFrame:
    """(allele_id, chrom, hap, gene, kind) of cells (allele_id, hap, gene, nth): chrom is the chromosome, haplotype letters cut, that most
    genes of an allele are on, the first by name where several are; kind is allele for genes in a slot, tandem for further
    genes that a tandem pair joins to one in a slot, else paralog."""
    on = genes.select("gene", F.expr(f"substring(chrom, 1, greatest(length(chrom) - {hap_letters}, 0))").alias("chrom"))
    n = cells.join(on, "gene").groupBy("allele_id", "chrom").agg(F.count(F.lit(1)).alias("n"))
    main = n.groupBy("allele_id").agg(F.min(F.struct(-F.col("n"), F.col("chrom"))).alias("m")).select("allele_id", F.col("m.chrom").alias("chrom"))
    both = tandem.select(F.col("gene1").alias("gene"), F.col("gene2").alias("main")).unionByName(tandem.select(F.col("gene2").alias("gene"), F.col("gene1").alias("main"))).distinct()
    slot = cells.where("hap is not null").select("allele_id", F.col("gene").alias("main"))
    near = cells.where("hap is null").join(both, "gene").join(slot, ["allele_id", "main"]).select("allele_id", "gene").distinct().withColumn("near", F.lit(True))
    out = cells.join(near, ["allele_id", "gene"], "left").join(main, "allele_id", "left")
    return out.select("allele_id", "chrom", "hap", "gene", F.when(F.col("hap").isNotNull(), "allele").when(F.col("near"), TANDEM).otherwise("paralog").alias("kind"))


def with_remaining_tandems(cells: DataFrame, tandem: DataFrame) -> DataFrame:
    """cells (allele_id, hap, gene, nth) and, as new alleles, tandem pairs (gene1, gene2, hap1) of which no gene is in one: the first gene in its
    haplotype's slot, the second a further gene. Pairs whose haplotype is not known are left out."""
    known = cells.select("gene").distinct()
    new = tandem.where("hap1 is not null").select("gene1", "gene2", "hap1").distinct()
    for c in ("gene1", "gene2"):
        new = new.join(known.withColumnRenamed("gene", c), c, "left_anti")
    both = F.array(F.struct(F.col("hap1").alias("hap"), F.col("gene1").alias("gene"), F.lit(None).cast("long").alias("nth")), F.struct(F.lit(None).cast("string").alias("hap"), F.col("gene2").alias("gene"), F.lit(1).cast("long").alias("nth")))
    return cells.unionByName(new.select(F.concat(F.lit("+"), "gene1", F.lit("|"), "gene2").alias("allele_id"), F.explode(both).alias("c")).select("allele_id", "c.*"))


def with_blast_genes(cells: DataFrame, hits: DataFrame, hap_of: DataFrame) -> DataFrame:
    """cells with genes that are in no allele but have hits (gene, hit) to genes of exactly one: in the slot of their haplotype (gene, hap) if
    it is free and they are the first by name to want it, else as paralogs after the further genes."""
    new = hits.select("gene", F.col("hit")).distinct().join(cells.select("gene").distinct(), "gene", "left_anti")
    to = new.join(cells.select(F.col("gene").alias("hit"), "allele_id"), "hit").groupBy("gene").agg(F.min("allele_id").alias("allele_id"), F.max("allele_id").alias("__last")).where("allele_id = __last").drop("__last")
    to = to.join(hap_of.select("gene", "hap"), "gene", "left")
    taken = cells.where("hap is not null").select("allele_id", "hap").distinct().withColumn("__taken", F.lit(True))
    w = Window.partitionBy("allele_id", "hap").orderBy("gene")
    to = to.join(taken, ["allele_id", "hap"], "left").withColumn("__free", F.col("hap").isNotNull() & F.col("__taken").isNull() & (F.row_number().over(w) == 1))
    after = cells.groupBy("allele_id").agg(F.coalesce(F.max("nth"), F.lit(0)).alias("__after"))
    rest = to.where(~F.col("__free")).join(after, "allele_id").select("allele_id", F.lit(None).cast("string").alias("hap"), "gene", (F.col("__after") + F.row_number().over(Window.partitionBy("allele_id").orderBy("gene"))).cast("long").alias("nth"))
    return cells.unionByName(to.where("__free").select("allele_id", "hap", "gene", F.lit(None).cast("long").alias("nth"))).unionByName(rest)


def merged_tables(first: DataFrame, second: DataFrame) -> DataFrame:
    """Cells of two tables under one another, rows of the second numbered apart by a prefix; alleles of the second whose genes are all in one
    allele of the first are left out."""
    inside = second.join(first.select("gene", F.col("allele_id").alias("__in")), "gene").groupBy("allele_id", "__in").agg(F.count_distinct("gene").alias("__n"))
    many = second.groupBy("allele_id").agg(F.count_distinct("gene").alias("__n"))
    gone = inside.join(many, ["allele_id", "__n"]).select("allele_id").distinct()
    return first.unionByName(second.join(gone, "allele_id", "left_anti").withColumn("allele_id", F.concat(F.lit("2:"), "allele_id")).select(*first.columns))
