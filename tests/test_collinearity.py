"""Allele tables against plain folds over whole lists."""

from __future__ import annotations

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandframe.operators import collinearity as L

NAMES = ["A", "B", "C", "D"]


def made(seed, genes=200):
    rng = random.Random(seed)
    hap = {f"g{k:03d}": NAMES[k % 4] for k in range(genes)}
    names, out = list(hap), []
    for line in range(genes):
        k = rng.randrange(genes)
        a, b = names[k], names[(k // 8 * 8 + rng.randrange(10)) % genes]
        if a != b:
            kind = L.HOMOLOG if hap[a] != hap[b] and rng.random() < 0.8 else L.INTRA if hap[a] == hap[b] else rng.choice([L.ELSEWHERE, L.TANDEM])
            out.append((a, b, hap[a], hap[b], line, kind))
    return out


def frame(spark, links):
    return spark.createDataFrame(links, "gene1 string, gene2 string, hap1 string, hap2 string, line_no long, kind string").repartition(3)


def ordered(links):
    out = []
    for a, b, x, y, line, _ in sorted(links, key=lambda r: r[4]):
        if x != y:
            out.append((a, b, x, y, line) if x < y else (b, a, y, x, line))
    return out


def firsts(links, x, y):
    found = {}
    for a, b, p, q, _ in ordered(links):
        if (p, q) == (x, y):
            found.setdefault(a, b)
    return found


def plain_chain(links):
    """The merges in pandas."""
    table = pd.DataFrame(columns=[f"gene{n}" for n in NAMES], dtype=object)
    for i, x in enumerate(NAMES):
        for y in NAMES[i + 1 :]:
            pairs = pd.DataFrame(list(firsts(links, x, y).items()), columns=[f"gene{x}", f"gene{y}"], dtype=object)
            table = table.drop(columns=f"gene{y}").merge(pairs, on=f"gene{x}", how="outer")[[f"gene{n}" for n in NAMES]]
    rows = {tuple(None if pd.isna(v) else v for v in r) for r in table.itertuples(index=False)}
    return {r for r in rows if sum(v is not None for v in r) >= 2}


def plain_collinear(links):
    rows, seen = [], {n: set() for n in NAMES}
    for i, x in enumerate(NAMES[:-1]):
        maps = {y: firsts(links, x, y) for y in NAMES[i + 1 :]}
        new = []
        for gene in sorted(set().union(*maps.values()) - seen[x]):
            new.append({x: gene} | {y: m[gene] for y, m in maps.items() if gene in m})
        rows += new
        for r in new:
            for n, gene in r.items():
                seen[n].add(gene)
    rows = [tuple(r.get(n) for n in NAMES) for r in rows]
    rows.sort(key=lambda r: [(v is None, v or "") for v in r])
    for k in range(4):
        had, kept = set(), []
        for r in rows:
            if r[k] is None or r[k] not in had:
                kept.append(r)
                had.add(r[k])
        rows = kept
    return set(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_chains(spark, seed):
    links = made(seed)
    assert {tuple(r) for r in L.synteny_table(frame(spark, links), NAMES).collect()} == plain_chain(links)
    assert {tuple(r) for r in L.collinear_table(frame(spark, links), NAMES).collect()} == plain_collinear(links)


def test_first_line_or_first_name(spark):
    links = frame(spark, [("a", "y", "A", "B", 1, None), ("a", "x", "A", "B", 2, None), ("z", "y", "C", "B", 3, None)])
    assert [tuple(r) for r in L.collinear_table(links, NAMES[:3]).collect()] == [("a", "y", None)]
    assert {tuple(r) for r in L.collinear_table(links, NAMES[:3], keep_first=False).collect()} == {("a", "x", None)}
    assert L.collinear_table(links.limit(0), NAMES).count() == L.synteny_table(links.limit(0), NAMES).count() == 0


def plain_expanded(table, links):
    """All alleles and all links at once, every row searched for every gene."""
    rows = [({n: g for n, g in zip(NAMES, r, strict=True) if g}, []) for r in sorted(table, key=lambda r: "|".join(v or "" for v in r))]
    has = lambda row, g: g in row[0].values() or g in row[1]

    def put(row, g, hap):
        if not has(row, g):
            if hap and hap not in row[0]:
                row[0][hap] = g
            else:
                row[1].append(g)

    homologs = [x for x in links if x[5] == L.HOMOLOG]
    mapped = {g for r in rows for g in r[0].values()}
    unmapped = {g for x in homologs for g in x[:2]} - mapped
    for new, old in ((0, 1), (1, 0)):
        waiting = set(unmapped)
        for x in homologs:
            if x[new] in waiting and x[old] not in waiting:
                for r in rows:
                    if r[0].get(x[2 + old]) == x[old]:
                        put(r, x[new], x[2 + new])
                        unmapped.discard(x[new])
    for g in list(dict.fromkeys(g for r in rows for g in r[1])):
        if sum(g in r[1] for r in rows) >= 2:
            holders = sorted((r for r in rows if has(r, g)), key=lambda r: -(len(r[0]) + len(r[1])))
            for other in holders[1:]:
                rows = [r for r in rows if r is not other]
                for h in sorted({*other[0].values(), *other[1]}):
                    if not has(holders[0], h):
                        holders[0][1].append(h)
    for a, b, x, y, _, _ in homologs:
        if a in unmapped or b in unmapped:
            at_a, at_b = [r for r in rows if has(r, a)], [r for r in rows if has(r, b)]
            if at_a:
                put(at_a[0], b, y)
            elif at_b:
                put(at_b[0], a, x)
            else:
                rows.append(({x: a}, []))
                put(rows[-1], b, y)
    for kind in (L.INTRA, L.ELSEWHERE):
        for a, b, x, y, _, _ in [z for z in links if z[5] == kind]:
            held = [r for r in rows if has(r, a) or has(r, b)]
            if not held:
                rows.append(({x: a}, [b]))
            elif len(held) == 1 and has(held[0], a) != has(held[0], b):
                gene, hap = (b, y) if has(held[0], a) else (a, x)
                put(held[0], gene, hap if kind == L.INTRA else None)
    before = [(r, {*r[0].values(), *r[1]}) for r in rows]
    for a, b, x, _, _, _ in [z for z in links if z[5] == L.TANDEM]:
        for g, partner in ((a, b), (b, a)):
            for r, genes in before:
                if partner in genes:
                    put(r, g, None)
        if not any(has(r, a) or has(r, b) for r in rows):
            rows.append(({x: a}, [b]))
    return Counter((frozenset(r[0].items()), frozenset(r[1])) for r in rows)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_links_worked_in(spark, seed):
    links = made(seed)
    wide = plain_collinear([x for x in links if x[5] == L.HOMOLOG and x[4] % 3])
    table = spark.createDataFrame([r for r in wide], ", ".join(f"gene{n} string" for n in NAMES))
    got = {}
    for r in L.expanded_table(table, frame(spark, links), NAMES).collect():
        slots, dups = got.setdefault(r["allele_id"], ({}, []))
        if r["hap"]:
            slots[r["hap"]] = r["gene"]
        else:
            dups.append(r["gene"])
    want = plain_expanded(wide, links)
    got = Counter((frozenset(s.items()), frozenset(d)) for s, d in got.values())
    assert sum(got.values()) == sum(want.values()) and {frozenset({g for _, g in s} | d) for s, d in got} == {frozenset({g for _, g in s} | d) for s, d in want}
    assert got == want


def test_final_tables(spark):
    cells = spark.createDataFrame([("a", "A", "g1", None), ("a", "B", "g2", None), ("a", None, "g3", 1), ("a", None, "g4", 2), ("b", "A", "g5", None), ("b", "B", "g6", None)], "allele_id string, hap string, gene string, nth long")
    genes = spark.createDataFrame([("g1", "Chr1A"), ("g2", "Chr2B"), ("g3", "Chr2C"), ("g5", "Chr3A"), ("g6", "Chr1B")], "gene string, chrom string")
    tandem = spark.createDataFrame([("g3", "g1", "C"), ("g4", "g3", None), ("t1", "t2", "B"), ("t3", "t4", None), ("t5", "g6", "A")], "gene1 string, gene2 string, hap1 string")
    kinds = {r["gene"]: (r["chrom"], r["kind"]) for r in L.final_kinds(cells, genes, tandem).collect()}
    assert kinds == {"g1": ("Chr2", "allele"), "g2": ("Chr2", "allele"), "g3": ("Chr2", "tandem"), "g4": ("Chr2", "paralog"), "g5": ("Chr1", "allele"), "g6": ("Chr1", "allele")}
    more = L.with_remaining_tandems(cells, tandem)
    assert {tuple(r) for r in more.exceptAll(cells).collect()} == {("+t1|t2", "B", "t1", None), ("+t1|t2", None, "t2", 1)}
    hits = spark.createDataFrame([("n1", "g1"), ("n1", "g2"), ("n2", "g1"), ("n3", "g1"), ("n3", "g5"), ("n4", "g2"), ("g5", "g1")], "gene string, hit string")
    haps = spark.createDataFrame([("n1", "C"), ("n2", "C"), ("n4", "A")], "gene string, hap string")
    assert {tuple(r) for r in L.with_blast_genes(cells, hits, haps).exceptAll(cells).collect()} == {("a", "C", "n1", None), ("a", None, "n2", 3), ("a", None, "n4", 4)}
    second = spark.createDataFrame([("x", "A", "g1", None), ("x", "B", "g3", None), ("y", "A", "g1", None), ("y", "B", "g5", None)], cells.schema)
    assert {tuple(r) for r in L.merged_tables(cells, second).exceptAll(cells).collect()} == {("2:y", "A", "g1", None), ("2:y", "B", "g5", None)}
    links = spark.createDataFrame([("Chr1A", "Chr1A"), ("Chr1A", "Chr1B"), ("Chr1A", "Chr2A")], "chrom1 string, chrom2 string")
    assert [r["kind"] for r in L.kinds(links).orderBy("chrom2").collect()] == [L.INTRA, L.HOMOLOG, L.ELSEWHERE]
    assert L.final_kinds(cells.where(F.lit(False)), genes, tandem).count() == 0
