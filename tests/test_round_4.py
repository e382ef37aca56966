"""Findings of round 4: results at sizes that the catalogue's small tables do not reach."""

import random
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from strandframe.functions import scalars as S
from strandframe.operators import compartments as AB
from strandframe.operators import genes as G
from strandframe.operators import homology as H
from strandframe.operators import intervals as I
from strandframe.operators import kmers as K
from strandframe.operators import rescue as R
from strandframe.plans import catalogue, extended  # noqa: F401  registers its queries


def test_labels_round_as_printf(spark):
    sizes = [*range(400_010, 9_000_010, 9_990), *range(450_000, 30_000_000, 50_000), *range(750_000, 9_000_000_000, 777_750_000)]
    got = {r["x"]: r["label"] for r in spark.createDataFrame([(x,) for x in sizes], "x long").select("x", S.size_label(F.col("x")).alias("label")).collect()}
    want = {x: duckdb.execute("SELECT printf('%.1f', cast(? AS bigint)/1000000.0) || ' Mbp'", [x]).fetchone()[0] for x in set(sizes)}
    assert got == want and want[850_000] == "0.8 Mbp"


def test_names_beyond_five_digits_as_in_sql(spark):
    genes = spark.range(100_003).select(F.lit("Chr2").alias("chrom"), F.col("id").alias("start"), F.format_string("G%06d", "id").alias("gene"))
    got = {r["gene"]: r["new_name"] for r in G.renamed(genes, "AT").where("start < 2 or start > 99997").collect()}
    (want,) = duckdb.execute("SELECT map(list(g), list(w)) FROM (SELECT printf('G%06d', i - 1) AS g, 'AT2' || lpad(cast(i AS varchar), 5, '0') AS w FROM unnest([1, 2, 99999, 100000, 100001, 100002, 100003]) t(i)) x").fetchone()
    assert got == dict(want)


def crowded(spark, n: int = 60, seed: int = 5):
    """Intervals that lie on one another, empty and equal ones among them, and points that share places, as lists and as tables."""
    r = random.Random(seed)
    i = [("c" if k % 3 else "d", a := r.randrange(-5, 70_000 if k % 2 else 200), a + r.randrange(-1, 40 if k % 2 else 400), f"g{k}") for k in range(n)]
    i += [("c", 65_530, 65_540, "edge"), ("c", 7, 300, "twin"), ("c", 7, 300, "twin"), ("e", 3, 4, "alone")]
    p = [(r.choice("cd"), r.randrange(-6, 600)) for _ in range(3 * n)] + [("c", x) for x in range(65_525, 65_545)] + [("c", 7), ("c", 300), (None, 7), ("c", None), ("f", 1)]
    p += [(c, x) for c, a, b, _ in i for x in (a, b)]
    return i, p, spark.createDataFrame(i, "chrom string, start long, stop long, gene string"), spark.createDataFrame(p, "chrom string, pos long")


def no_pairs(*args, **how):
    raise AssertionError("pairs of points and intervals were made")


def test_points_are_counted_without_pairs(spark, monkeypatch):
    i, p, intervals, points = crowded(spark)
    hits = Counter()
    for c, a, b, g in i:
        hits[g, a, b] += sum(c == d and x is not None and a <= x <= b for d, x in p)
    got = I.count_points(intervals, points, ["gene", "start", "stop"]).collect()
    assert {(r["gene"], r["start"], r["stop"]): r["n"] for r in got} == hits and len(got) == len(hits)
    monkeypatch.setattr(I, "bucket_pairs", no_pairs)
    assert catalogue.QUERIES["snp_rate_per_gene"](spark, "/root/testdata/sf0.001").count() > 0


def test_lone_hits_without_pairs(spark, monkeypatch):
    i, p, intervals, points = crowded(spark, 40)
    pairs = Counter((c, x) for c, x in p for d, a, b, _ in i if c == d and x is not None and a <= x <= b)
    want = sorted((c, x, g) for c, x in p for d, a, b, g in i if c == d and x is not None and a <= x <= b and pairs[c, x] == 1)
    assert sorted(tuple(r) for r in I.lone_hits(points, intervals).select("chrom", "pos", "b_gene").collect()) == want and len(want) > 5
    monkeypatch.setattr(I, "bucket_pairs", no_pairs)
    assert catalogue.QUERIES["points_in_one_gene"](spark, "/root/testdata/sf0.001").count() > 0


def test_fragments_of_pairs_without_pairs(spark, monkeypatch):
    i, p, intervals, _ = crowded(spark, 40)
    ends = [x for x in p if None not in x]
    rows = [(k // 2 if k % 5 == 0 else k, *ends[k], "+", *ends[-k], "-") for k in range(len(ends))]
    turned = [(r, c1, x1, c2, x2) if (c1, x1) <= (c2, x2) else (r, c2, x2, c1, x1) for r, c1, x1, _, c2, x2, _ in rows]
    held = [defaultdict(list), defaultdict(list)]
    for r, *e in turned:
        for k in (0, 1):
            held[k][r] += [(a, b) for c, a, b, _ in i if c == e[2 * k] and a <= e[2 * k + 1] < b]
    one = lambda k, r: held[k][r][0] if len(held[k][r]) == 1 else (None, None)
    want = Counter((r, c1, x1, *one(0, r), c2, x2, *one(1, r)) for r, c1, x1, c2, x2 in turned)
    pairs = spark.createDataFrame(rows, "read_id long, chr1 string, pos1 long, strand1 string, chr2 string, pos2 long, strand2 string")
    monkeypatch.setattr(I, "bucket_pairs", no_pairs)
    got = R.fragment_pairs(pairs, intervals).drop("strand1", "strand2")
    assert got.columns == ["read_id", "chr1", "pos1", "up1", "down1", "chr2", "pos2", "up2", "down2"]
    assert Counter(tuple(r) for r in got.collect()) == want and any(r[3] is not None for r in want)


def test_hits_of_many_islands_without_python(spark):
    r = random.Random(11)
    rows = [(f"q{r.randrange(40)}", f"t{r.randrange(3)}", r.randrange(50), s := r.randrange(400), s + r.randrange(0, 60)) for _ in range(1500)]
    want = []
    for key in {x[:2] for x in rows}:
        kept = []
        for x in sorted((x for x in rows if x[:2] == key), key=lambda x: x[2:], reverse=True):
            if not any(min(x[4], k[4]) - max(x[3], k[3]) > 0.1 * (x[4] - x[3]) for k in kept):
                kept.append(x)
        want += kept
    got = H.suppressed(spark.createDataFrame(rows, "q string, t string, score long, start long, stop long"))
    assert Counter(tuple(x) for x in got.collect()) == Counter(want)
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_slots_of_one_wide_allele_without_pairs_of_its_genes(spark):
    n = 1000
    genes = [("R", "AB"[k % 2], f"g{k:04d}") for k in range(n)] + [("S", "C", "g0001"), ("S", "C", "g0002"), ("T", "A", "alone"), ("T", "B", "alone"), ("U", "A", "u1"), ("U", "A", "u2")]
    hits = [("g0003", "g0010"), ("g0010", "g0003"), ("g0500", "g0007"), ("g0004", "g0004"), ("g0002", "g0001"), ("u1", "g0001"), ("alone", "u2")]
    alleles, blast = spark.createDataFrame(genes, "allele_id string, slot string, gene string"), spark.createDataFrame(hits, "qseqid string, sseqid string")
    slots = G.supported_slots(alleles, blast, list("ABC"))
    got = {x["allele_id"]: (x["geneA"], x["geneB"], x["geneC"], x["dup_gene"]) for x in slots.collect()}
    assert got == {"R": ("g0002", "g0001", None, "g0003,g0007,g0010,g0500"), "S": (None, None, "g0001", "g0002"), "T": ("alone", "alone", None, "")}
    plan = slots._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x]
    assert joins and not any(x.count("=") == 1 and "allele_id" in x for x in joins)


def test_components_of_alleles_are_not_broadcast(spark, monkeypatch):
    from strandframe.operators import graph

    written, plain = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: (written.append(df._jdf.queryExecution().executedPlan().toString()), plain(df))[1])
    rows = [("c", f"x{k}", f"g{j}") for k in range(30) for j in (k, k * k % 30, 40 + k)]
    got = G.fold_shared(spark.createDataFrame(rows, "chrom string, allele_id string, gene string"))
    plans = [*written, got._jdf.queryExecution().executedPlan().toString()]
    assert sum("Join" in p for p in plans) >= 3 and not any("BroadcastHashJoin" in p for p in plans)
    assert {r["gene"] for r in got.collect()} == {r[2] for r in rows}


def test_kmers_are_counted_without_a_row_each(spark, monkeypatch):
    r = random.Random(2)
    seqs = [(k % 4, "".join(r.choice("ACGTacgtN." if k % 5 else "AC") for _ in range(r.randrange(0, 90)))) for k in range(200)] + [(0, None), (None, "ACGTACGT"), (1, "ACGTTGCA" * 30)]
    table = spark.createDataFrame(seqs, "sample int, seq string")
    monkeypatch.setattr(K, "PIECE", 16)
    for k in (1, 2, 5, 8, 21, 31):
        sets = defaultdict(int)
        for sample, text in seqs:
            for i in range(len(text or "") - k + 1):
                w = text[i : i + k].upper()
                if set(w) <= set("ACGT") and sample in (0, 1, 2):
                    sets[min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))] |= 1 << sample
        assert {x["mask"]: x["n"] for x in K.venn_of(table, k, [0, 1, 2]).collect()} == dict(Counter(sets.values()))
    plan = catalogue.QUERIES["kmer_sets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "conv(" not in plan


def test_kmers_have_the_numbers_of_the_plan(spark):
    text = "ACGTTGCANACGGTTTACGACCAGTacgtttgacc"
    for k in (3, 7, 12):
        got = [x["kmer"] for x in K.canonical_kmers(spark.createDataFrame([("s", text)], "sample string, seq string"), k, ["sample"]).collect()]
        assert sorted(K.numbered(text.encode(), k).tolist()) == sorted(got)


def test_best_overlaps_without_pairs(spark, monkeypatch):
    r = random.Random(8)
    span = lambda most: (x := r.randrange(-40, 900), x + r.choice([0, 1, r.randrange(1, most), r.randrange(1, most)]))
    rows = [("cd"[k % 2], *span(40 if k % 9 else 800), f"g{k}") for k in range(500)] + [("x", 1, 5, "nowhere"), ("c", 64, 64, "edge")]
    domains = [("cd"[k % 2], *span(60 if k % 4 else 900)) for k in range(220)] + [("c", 64, 500), ("c", -3, 500), ("c", -3, 500), ("y", 1, 5)]
    a, b = spark.createDataFrame(rows, "chrom string, start long, stop long, gene string"), spark.createDataFrame(domains, "chrom string, start long, stop long")
    for last in (False, True):
        want = {}
        for c, s, e, g in rows:
            over = [(min(q, e) - max(p, s), p, q) for d, p, q in domains if d == c and p < e and q > s and min(q, e) - max(p, s) >= 0.7 * (e - s)]
            if over:
                top = [(p, q) for o, p, q in over if o == max(over)[0]]
                want[g] = (*(max(top) if last else min(top)), max(over)[0])
        got = {x["gene"]: (x["b_start"], x["b_stop"], x["overlap"]) for x in I.best_overlap(a, b, 0.7, last, width=64).collect()}
        assert got == want and len(want) > 300
    monkeypatch.setattr(I, "bucket_pairs", no_pairs)
    assert catalogue.QUERIES["domain_of_gene"](spark, "/root/testdata/sf0.001").count() > 0


def test_domains_are_conserved_without_pairs_of_genes_and_domains(spark, monkeypatch):
    monkeypatch.setattr(I, "bucket_pairs", no_pairs)
    assert catalogue.QUERIES["domain_conservation"](spark, "/root/testdata/sf0.01").count() > 0


def test_held_intervals_meet_once(spark):
    r = random.Random(4)
    span = lambda most: (x := r.randrange(-40, 400), x + r.choice([-1, 0, 1, 2, 3, r.randrange(1, most)]))
    rows, domains = [("cd"[k % 2], *span(40), f"g{k}") for k in range(300)], [("cd"[k % 2], *span(30 if k % 5 else 5000), k) for k in range(150)]
    a, b = spark.createDataFrame(domains, "chrom string, start long, stop long, k long"), spark.createDataFrame(rows, "chrom string, start long, stop long, gene string")
    for share in (0.51, 0.7, 1.0):
        want = Counter((k, g, min(q, e) - max(p, s)) for c, s, e, g in rows for d, p, q, k in domains if c == d and p < e and q > s and min(q, e) - max(p, s) >= share * (e - s))
        found = I.held_join(a, b, share, width=8)
        assert Counter((x["k"], x["b_gene"], x["overlap"]) for x in found.collect()) == want and len(want) > 100
    plan = catalogue.QUERIES["domain_gene_overlap_f70"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=shuffle_hash" in plan and plan.count("explode(sequence") == 1


def test_pairs_of_domains_are_not_shuffled(spark):
    r = random.Random(6)
    span = lambda most: (x := r.randrange(0, 900), x + r.choice([0, r.randrange(1, most), r.randrange(1, most)]))
    rows = [("cd"[k % 2], *span(40), f"g{k % 110}") for k in range(120)]
    domains = [("cd"[k % 2], *span(300 if k % 9 else 300_000)) for k in range(40)] + [("c", 100, 700), ("c", 100, 700)]
    anchors = [(f"g{r.randrange(115)}", f"g{r.randrange(12)}") for _ in range(90)]
    of = defaultdict(list)
    for c, s, e, g in rows:
        of[g] += [f"{d}:{p}:{q}" for d, p, q in domains if c == d and p < e and q > s and min(q, e) - max(p, s) >= 0.7 * (e - s)]
    want = defaultdict(list)
    for g, h in anchors:
        for x in of[g]:
            for y in of[h]:
                want[x, y].append(g)
    make = lambda x, schema: spark.createDataFrame(x, schema)
    got = AB.domain_pairs(make(domains, "chrom string, start long, stop long"), make(rows, "chrom string, start long, stop long, gene string"), make(anchors, "gene1 string, gene2 string"))
    assert sorted(tuple(x) for x in got.collect()) == sorted((*k, len(v), ",".join(sorted(v))) for k, v in want.items()) and len(want) > 200
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan.split("MapInArrow")[0] and "collect_list(gene1" not in plan
