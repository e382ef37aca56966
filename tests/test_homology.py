"""Pairs of genes, alignments of contigs, places of contigs: small cases worked out by hand."""

import random

from pyspark.sql import functions as F

from strandframe.operators import homology, rescue

HIT = "qseqid string, sseqid string, bitscore double, identity double"


def test_orthologs(spark):
    genes = lambda *g: spark.createDataFrame([(x,) for x in g], "gene string")
    a, b = genes("a1", "a2", "a3", "a4", "a5"), genes("b1", "b2", "b3", "b4")
    ab = spark.createDataFrame([("a1", "b1", 90.0, 90.0), ("a1", "b2", 80.0, 99.0), ("a2", "b2", 50.0, 80.0), ("a3", "b2", 60.0, 80.0), ("a4", "b1", 70.0, 80.0)], HIT)
    ba = spark.createDataFrame([("b1", "a1", 90.0, 90.0), ("b2", "a9", 99.0, 90.0)], HIT)
    pairs = homology.orthologs(a, b, ab, ba)
    assert {tuple(r) for r in pairs.collect()} == {("a1", "b1", "reciprocal"), ("a2", "b2", "best")}
    within = spark.createDataFrame([("a1", "a3", 50.0, 70.0), ("b2", "a3", 40.0, 95.0), ("a1", "b3", 10.0, 99.0)], HIT)
    got = {(r["gene_a"], r["gene_b"], r["kind"], tuple(r["paralogs"])) for r in homology.with_paralogs(pairs, a, b, within).collect()}
    assert got == {("a1", "b1", "reciprocal", ()), ("a2", "b2", "best", ("a3",)), ("a4", None, "none", ()), ("a5", None, "none", ()), (None, "b3", "none", ()), (None, "b4", "none", ())}


def test_suppressed_hits_as_by_hand(spark):
    random.seed(3)
    rows = [(f"q{random.randrange(3)}", "t", random.randrange(100), s := random.randrange(900), s + random.randrange(1, 90)) for _ in range(300)]
    want = []
    for q in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: r[2:], reverse=True):
            if all(min(r[4], k[4]) - max(r[3], k[3]) <= 0.1 * (r[4] - r[3]) for k in kept):
                kept.append(r)
        want += kept
    hits = spark.createDataFrame(rows, "q string, t string, score long, start long, stop long")
    got = homology.suppressed(hits)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    sizes = spark.createDataFrame([("q0", 50)], "q string, size long")
    (row,) = homology.contig_targets(got, sizes, 0, 0).collect()
    assert row["q"] == "q0" and row["aligned"] == 50 and row["score"] == sum(w[2] for w in want if w[0] == "q0")


def test_evidence_and_copies(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    blast = t([("g1", 50.0, 200), ("g1", 31.0, 100), ("g2", 50.0, 99)], "gene string, identity double, length long")
    got = homology.gene_evidence(blast, t([("g3",), ("g3",)], "gene string"), t([("g4", 2.5), ("g5", 1.9)], "gene string, fpkm double"), t([("g4", 0.7), ("g5", 0.7)], "gene string, cov double"), t([("g6", 95), ("g7", 90)], "gene string, support long"))
    assert {r["gene"]: r["label"] for r in got.collect()} == {"g1": "keep", "g3": "keep", "g4": "keep", "g5": "remove", "g6": "keep", "g7": "remove"}
    (c,) = homology.copy_numbers(t([("s", "g", 100, 200, 30.0)], "sample string, gene string, start long, stop long, coverage double"), t([("s", 1000)], "sample string, n long"), 100, 10_000).collect()
    assert abs(c["copies"] - 3.0) < 1e-12


def test_links_of_alignments(spark):
    rows = [(0, "r1", 1, 2, False), (1, "r1", 1, 2, False), (2, "r2", 3, 2, False), (3, "r1", 1, 1, False), (4, "r3", 1, 1, True), (5, "r3", 1, 1, False)]
    lines = spark.createDataFrame(rows, "line_no long, name string, ref_id1 int, ref_id2 int, is_unmapped boolean")
    lines = lines.withColumns({"ref1": F.lit("c"), "p1": F.lit(1), "strand1": F.lit("+"), "ref2": F.lit("d"), "p2": F.lit(2), "strand2": F.lit("-"), "is_paired": F.lit(True)})
    got = rescue.links_of_alignments(lines).orderBy("line_no").collect()
    assert [(r["line_no"], r["order1"], r["flag1"], r["flag2"]) for r in got] == [(0, 0, 0, 16), (2, 1, 0, 16), (3, 0, 0, 16)]


def test_insert_positions(spark):
    tours = spark.createDataFrame([("c", x, k) for k, x in enumerate("pqr")], "chrom string, id string, number long")
    signals = spark.createDataFrame([("u", "q", 9), ("u", "r", 2), ("u", "p", 2), ("v", "q", 9), ("v", "r", 1), ("w", "p", 5), ("w", "q", 4), ("x", "r", 3), ("p", "q", 99), ("y", "z", 1)], "x string, y string, n long")
    got = {r["x"]: (r["nearest"], r["before"], r["after"]) for r in rescue.insert_positions(signals, tours).collect()}
    assert got == {"u": ("q", 0, 1), "v": ("q", 1, 2), "w": ("p", -1, 0), "x": ("r", 1, 2)}


def test_ko_list(spark):
    rows = spark.createDataFrame([("g", '"K1,K2"'), ("h", None), ("i", "")], "gene string, kos string")
    assert sorted((r["gene"], r["ko"] or "") for r in homology.ko_list(rows).collect()) == [("g", "K1"), ("g", "K2"), ("h", ""), ("i", "")]
