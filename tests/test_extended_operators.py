"""Annotation trees, k-mers, placement of contigs, distributions and written parts, on cases worked out by hand or by plain loops."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandframe.operators import annotation as AN
from strandframe.operators import compartments as AB
from strandframe.operators import contacts as C
from strandframe.operators import kmers as K
from strandframe.operators import placement as P
from strandframe.operators import stats as T
from strandframe.sources import readers, writers

GFF = "chrom string, type string, start long, stop long, strand string, attributes string"


def test_coding_positions_on_both_strands(spark):
    exons = [(101, 110), (201, 205), (301, 320)]
    rows = [("c", "gene", 51, 450, s, f"ID=g{s}") for s in "+-"] + [("c", "mRNA", 51, 450, s, f"ID=t{s};Parent=g{s}") for s in "+-"]
    rows += [("c", "CDS", a, b, s, f"Parent=t{s}") for s in "+-" for a, b in exons]
    gff = spark.createDataFrame(rows, GFF)
    at = spark.createDataFrame([(f"t{s}", p) for s in "+-" for p in range(0, 37)], "parent string, pos long")
    bases = [b for a, z in exons for b in range(a, z + 1)]
    for by_strand in (False, True):
        got = {(r["parent"], r["pos"]): (r["base"], r["gene"], r["percent"]) for r in AN.genome_positions(gff, at, by_strand).collect()}
        assert len(got) == 70  # 35 bases each; 0 and 36 lie outside
        for s in "+-":
            for p, base in enumerate(bases[::-1] if by_strand and s == "-" else bases, 1):
                assert got[f"t{s}", p][:2] == (base, f"g{s}") and abs(got[f"t{s}", p][2] - (base - 51) / 400 * 100) < 1e-9


def test_subtree_of_five_levels_is_renamed(spark):
    up = ["", ";Parent=a1", ";Parent=a1.t", ";Parent=a1.t.e", ";Parent=a1.t.e.x,a12"]
    ids = ["a1", "a1.t", "a1.t.e", "a1.t.e.x", "deep"]
    rows = [("c", "f", k, k + 9, "+", f"ID={i}{p};Note=a1 a12 xa1") for k, (i, p) in enumerate(zip(ids, up, strict=True))]
    rows += [("c", "f", 50, 59, "+", "Parent=deep"), ("c", "f", 60, 69, "+", "ID=a12"), ("c", "f", 61, 69, "+", "ID=a12.t;Parent=a12"), ("c", "f", 70, 79, "+", "ID=l1;Parent=l2"), ("c", "f", 71, 79, "+", "ID=l2;Parent=l1"), ("c", "f", 90, 99, "+", None)]
    names = spark.createDataFrame([("a1", r"B$1\x"), ("l1", "m"), ("nothing", "y")], "old string, new string")
    got = {(r["old"], r["start"]): r["attributes"] for r in AN.renamed_subtrees(spark.createDataFrame(rows, GFF), names).collect()}
    assert set(got) == {("a1", k) for k in (0, 1, 2, 3, 4, 50)} | {("l1", 70), ("l1", 71)}
    assert got["a1", 0] == r"ID=B$1\x;Note=B$1\x a12 xa1" and got["a1", 3] == r"ID=B$1\x.t.e.x;Parent=B$1\x.t.e;Note=B$1\x a12 xa1"
    assert got["a1", 4] == r"ID=deep;Parent=B$1\x.t.e.x,a12;Note=B$1\x a12 xa1" and got["a1", 50] == "Parent=deep" and got["l1", 71] == "ID=l2;Parent=m"


@pytest.mark.parametrize("k", [1, 4, 31])
def test_kmers(spark, k, monkeypatch):
    monkeypatch.setattr(K, "STRETCH", 50)
    rng = random.Random(k)
    seqs = [(j % 3, "".join(rng.choice("ACGTacgtACGTNé" if j % 2 else "ACGT") for _ in range(rng.choice([0, 3, k, 49 + k, 50 + k, 170])))) for j in range(40)] + [(1, None)]
    want, plain = Counter(), {}
    for sample, s in seqs:
        s = (s or "").translate(str.maketrans("acgt", "ACGT"))
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                w = min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))
                n = sum("ACGT".index(c) * 4 ** (k - 1 - j) for j, c in enumerate(w))
                want[sample, n] += 1
                plain[n] = plain.get(n, 0) | 1 << sample
    got = K.canonical_kmers(spark.createDataFrame(seqs, "sample int, seq string"), k, ["sample"]).cache()
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {r["mask"]: r["n"] for r in K.venn(got, [0, 1, 2]).collect()} == dict(Counter(plain.values()))


@pytest.mark.parametrize("seed", range(4))
def test_contigs_are_placed_one_after_another(spark, seed):
    rng = random.Random(seed)
    contigs = [(f"c{k}", rng.choice([500, 700, 900, 1000 + k])) for k in range(60)]
    groups = {f"c{k}": f"g{rng.randrange(4)}" for k in range(0, 60, 3)}
    genes = [(f"c{k}", f"x{rng.randrange(90 if seed % 2 else 25)}") for k in range(60) for _ in range(rng.randrange(4))]
    signals = [(f"c{rng.randrange(60)}", f"c{rng.randrange(60)}", rng.choice([3, 9, 10, 11, 20])) for _ in range(300)]
    barred, without = {("g0", "c1"), ("g1", "c2"), ("g2", "c4")}, ["g3"] if seed > 1 else []
    of, held, strongest, want = {}, {}, {}, {}
    for c, g in genes:
        of.setdefault(c, set()).add(g)
    for c, g in groups.items():
        held.setdefault(g, set()).update(of.get(c, ()))
    for a, b, n in signals:
        for x, y in ((a, b), (b, a)):
            if y in groups:
                strongest[x, groups[y]] = max(n, strongest.get((x, groups[y]), 0))
    for c, _ in sorted(contigs, key=lambda r: (-r[1], r[0])):
        if c in groups:
            continue
        options = [(len(of.get(c, set()) & held.get(g, set())), -n, g) for (x, g), n in strongest.items() if x == c and g not in without and (g, c) not in barred]
        if options and -min(options)[1] >= 10:
            shared, n, g = min(options)
            want[c] = (g, -n, shared)
            held.setdefault(g, set()).update(of.get(c, ()))
    got = P.placed_contigs(spark.createDataFrame(contigs, "id string, length long"), spark.createDataFrame(list(groups.items()), "id string, grp string"), spark.createDataFrame(signals, "x string, y string, n long"), spark.createDataFrame(genes, "id string, gene string"), spark.createDataFrame(list(barred), "grp string, id string"), without)
    assert {r["id"]: (r["grp"], r["n"], r["shared"]) for r in got.collect()} == want and want


def test_students_p(spark):
    exact = {1: lambda t: 1 - 2 / math.pi * math.atan(t), 2: lambda t: 1 - t / math.sqrt(2 + t * t), 4: lambda t: 1 - t / math.sqrt(4 + t * t) * (1 + 0.5 * 4 / (4 + t * t))}

    def summed(t, df, n=20_000):
        f = lambda u: math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - (df + 1) / 2 * math.log1p(u * u / df)) / math.sqrt(math.pi * df)
        h = t / n
        return 1 - 2 * h / 3 * (f(0) + f(t) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, n)))

    cases = [(t, df) for df in (1, 2, 3, 4, 5, 7, 30, 101, 1000, 10_000) for t in (0.001, 0.3, 1.0, 2.2, 6.5)]
    got = spark.createDataFrame([(*c, k) for k, c in enumerate(cases)], "t double, df long, k int").select("k", T.student_p(F.col("t"), F.col("df")).alias("p"), T.student_p(-F.col("t"), F.col("df")).alias("q")).collect()
    for r in got:
        t, df = cases[r["k"]]
        assert abs(r["p"] - (exact[df](t) if df in exact else summed(t, df))) < 1e-9 and r["p"] == r["q"], (t, df)
    # Published points of 5 per cent.
    points = [(12.7062047362, 1), (2.5705818356, 5), (2.0422724563, 30), (1.9623390808, 1000)]
    assert all(abs(r["p"] - 0.05) < 1e-9 for r in spark.createDataFrame(points, "t double, df long").select(T.student_p(F.col("t"), F.col("df")).alias("p")).collect())
    odd = spark.createDataFrame([(0.0, 5), (float("inf"), 5), (None, 5), (1.0, 0), (1e-200, 3), (50.0, 200), (3.0, 3_000_000)], "t double, df long")
    p = [r["p"] for r in odd.select(T.student_p(F.col("t"), F.col("df")).alias("p")).collect()]
    assert p[:5] == [1.0, 0.0, None, None, 1.0] and 0 < p[5] < 1e-100 and abs(p[6] - math.erfc(3 / math.sqrt(2))) < 1e-7


def test_density_sums_to_one(spark):
    rng = random.Random(2)
    rows = [("a", rng.gauss(100, 9)) for _ in range(800)] + [("b", 5.0 * rng.randrange(4)) for _ in range(50)] + [("c", 3.0)] * 4 + [("a", None), ("d", 1.0)]
    got = T.density(spark.createDataFrame(rows, "k string, x double"), "x", ["k"], 200).collect()
    assert {r["k"] for r in got} == {"a", "b"}
    for k in "ab":
        at = sorted((r["x"], r["density"]) for r in got if r["k"] == k)
        assert len(at) == 200 and abs(sum(d for _, d in at) * (at[1][0] - at[0][0]) - 1) < 0.01
    values = [x for k, x in rows if k == "a" and x is not None]
    h = (sum((x - sum(values) / 800) ** 2 for x in values) / 799) ** 0.5 * 800**-0.2
    for x, d in sorted((r["x"], r["density"]) for r in got if r["k"] == "a")[::20]:
        assert abs(d - sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in values) / (800 * h * math.sqrt(2 * math.pi))) < 2e-4


def test_territories_by_distance(spark):
    rng = random.Random(7)
    sizes = {"k1": 95, "k2": 230, "k3": 10, "k4": 61}
    pairs = [(a, rng.randrange(sizes[a]), b, rng.randrange(sizes[b])) for a, b in ((rng.choice(list(sizes)), rng.choice(list(sizes))) for _ in range(900))]
    first, at = {}, 0
    for c, n in sizes.items():
        first[c], at = at, at + -(-n // 10)
    total, seen = Counter(), Counter()
    for a, p, b, q in pairs:
        total[abs(first[a] + p // 10 - first[b] - q // 10)] += 1
        if a != b:
            seen[min(a, b), max(a, b)] += 1
    got = {(r["chrom1"], r["chrom2"]): (r["observed"], r["expected"], r["score"]) for r in C.territories_by_distance(spark.createDataFrame(pairs, "chr1 string, pos1 long, chr2 string, pos2 long"), spark.createDataFrame(list(sizes.items()), "chrom string, size long"), 10).collect()}
    assert set(got) == set(seen)
    for (a, b), n in seen.items():
        e = sum(total[y - x] / (at - (y - x)) for x in range(first[a], first[a] + -(-sizes[a] // 10)) for y in range(first[b], first[b] + -(-sizes[b] // 10)))
        assert got[a, b][0] == n and abs(got[a, b][1] - e) < 1e-8 and abs(got[a, b][2] - math.log2(n / e)) < 1e-8


def test_conserved_domains(spark):
    domains = spark.createDataFrame([("c", 0, 100, 1), ("c", 0, 100, 2), ("c", 100, 200, 1)], "chrom string, start long, stop long, level int")
    genes = spark.createDataFrame([("c", 10, 20, "a"), ("c", 30, 40, "b"), ("c", 95, 105, "edge"), ("c", 120, 130, "d"), ("c", 90, 102, "e")], "chrom string, start long, stop long, gene string")
    anchors = spark.createDataFrame([("b", "d", 1), ("a", "d", 0), ("edge", "d", 2), ("e", "a", 3)], "gene1 string, gene2 string, line_no long")
    got = {(r["domain1"], r["domain2"]): r for r in AB.conserved_domains(domains, genes, domains, genes, anchors).collect()}
    assert set(got) == {("c:0:100", "c:100:200"), ("c:0:100", "c:0:100")}
    r = got["c:0:100", "c:100:200"]
    assert (r["pairs"], r["genes1"], r["genes2"], r["anchored1"], r["anchored2"], r["names1"], r["names2"]) == (2, 3, 1, 3, 1, "a,b", "d,d")
    assert abs(r["share1"] - 2 / 3) < 1e-12 and r["anchored_share2"] == 2.0
    assert AB.conserved_domains(domains, genes, domains, genes, anchors, least_genes=2).count() == 1 and AB.conserved_domains(domains, genes, domains, genes, anchors, least_share=0.9).count() == 0


def test_written_parts(spark, tmp_path):
    reads = spark.createDataFrame([(k, f"r{k}", "ACGT"[: 1 + k % 4], "@III"[: 1 + k % 4]) for k in range(25)], "read_no long, name string, seq string, quality string").repartition(4)
    writers.fastq_parts(reads, str(tmp_path / "fq"), 10)
    for part, many in ((0, 10), (1, 10), (2, 5)):
        files = list((tmp_path / "fq" / f"part={part}").glob("*.txt"))
        assert len(files) == 1
        got = sorted(readers.fastq(spark, str(files[0])).collect(), key=lambda r: r["read_no"])
        assert [(r["name"], r["seq"]) for r in got] == [(f"r{10 * part + k}", "ACGT"[: 1 + (10 * part + k) % 4]) for k in range(many)]
    seqs = spark.createDataFrame([(k, f"s{k}", "ACGTA" * (k + 1)) for k in range(9)], "line_no long, chrom string, seq string").repartition(3)
    writers.fasta_parts(seqs, str(tmp_path / "fa"), 60, 7)
    before, want = 0, {}
    for k in range(9):
        want.setdefault(before // 60, []).append((f"s{k}", "ACGTA" * (k + 1)))
        before += 5 * (k + 1)
    for part, rows in want.items():
        (file,) = (tmp_path / "fa" / f"part={part}").glob("*.txt")
        assert [x[1:] for x in file.read_text().splitlines() if x[0] == ">"] == [n for n, _ in rows]
        assert {(r["chrom"], r["seq"]) for r in readers.fasta(spark, str(file)).collect()} == set(rows)
    agp = spark.createDataFrame([("g1", 3, "W", "s2"), ("g1", 1, "W", "s0"), ("g1", 2, "U", "100"), ("g2", 1, "W", "s5"), ("g2", 2, "W", "lost")], "chrom string, number long, type string, id string")
    writers.fasta_of_groups(agp, seqs, str(tmp_path / "groups"))
    (file,) = (tmp_path / "groups" / "part=g1").glob("*.txt")
    assert file.read_text() == ">s0\nACGTA\n>s2\nACGTAACGTAACGTA\n" and (tmp_path / "groups" / "part=g2").exists()
