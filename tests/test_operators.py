"""Small cases with known answers, and properties."""

import math

import pytest
from pyspark.sql import functions as F

from strandframe.functions import scalars as S
from strandframe.operators import assembly, contacts, intervals, stats
from strandframe.sources import readers, writers
from strandframe.streaming import contacts as streaming


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_switch_types(spark):
    t = lambda a, b, z="B": one(spark, S.switch_type(F.lit(a), F.lit(b), z))
    assert t(-0.1, 0.2) == "BA" and t(0.1, 0.1) == "AA" and t(0.0, 1.0) == "BA" and t(0.0, 1.0, "A") == "AA"


def test_labels(spark):
    assert one(spark, S.size_label(F.lit(100000))) == "100 Kbp" and one(spark, S.size_label(F.lit(1000000))) == "1.0 Mbp"
    assert one(spark, S.bin_size(F.lit("1.5M"))) == 1500000 and one(spark, S.bin_size(F.lit("x"))) is None
    assert one(spark, S.gc_percent(F.lit("GGNN"))) == 100.0 and one(spark, S.gc_percent(F.lit("NN"))) == -1.0


def test_overlaps_of_any_length(spark):
    a = spark.createDataFrame([("c", 0, 5_000_000, "x"), ("c", 10, 20, "y"), ("c", 20, 30, "z"), ("d", 0, 9, "w")], "chrom string, start long, stop long, id string")
    got = {(r["id"], r["b_id"]) for r in intervals.overlap_join(a, a, width=16).collect()}
    assert got == {("x", "x"), ("x", "y"), ("y", "x"), ("x", "z"), ("z", "x"), ("y", "y"), ("z", "z"), ("w", "w")}
    assert intervals.overlap_join(a, a, width=16).count() == len(got)
    with pytest.raises(ValueError):
        intervals.overlap_join(a, a, fraction_a=2)


def test_folds(spark):
    d = spark.createDataFrame([("c", 0, 100, 1), ("c", 10, 20, 2)], "chrom string, start long, stop long, k long")
    assert [tuple(r) for r in intervals.fold_bottom(d, "k").collect()] == [("c", 10, 20)]
    assert intervals.fold_bottom(d.withColumn("k", -F.col("k")), "k").count() == 2
    assert intervals.leaves(d).count() == 1 and intervals.merge_keep_smallest(d).count() == 1


def test_t_test(spark):
    # t = 2.776 at four degrees of freedom has p = 0.05
    row = spark.createDataFrame([(0.0, 1.0, 2.0, 0.0, 1.0, 2.0), (1.0, 1.0, 1.0, 2.0, 2.0, 2.0)], "a1 double, a2 double, a3 double, b1 double, b2 double, b3 double")
    p = [r["p"] for r in stats.t_test(row, ["a1", "a2", "a3"], ["b1", "b2", "b3"]).collect()]
    assert p == [1.0, 0.0]
    d = 2.776 * math.sqrt(2 / 3)
    got = stats.t_test(spark.createDataFrame([(0.0, 1.0, 2.0, d, 1.0 + d, 2.0 + d)], row.schema), ["a1", "a2", "a3"], ["b1", "b2", "b3"]).first()["p"]
    assert abs(got - 0.05) < 1e-4


def test_normal_p(spark):
    for z in (0.0, 0.5, 1.96, 4.0):
        assert abs(one(spark, stats.normal_p(F.lit(z))) - math.erfc(z / math.sqrt(2))) < 2e-7


def test_balancing_evens_out_rows(spark):
    p = spark.createDataFrame([(0, 0, 4), (0, 1, 8), (0, 2, 2), (1, 1, 6), (1, 2, 3), (2, 2, 5)], "bin1 long, bin2 long, n long")
    sums = [r["total"] for r in contacts.bin_sums(contacts.balanced(p, rounds=12).select("bin1", "bin2", F.col("balanced").alias("n")), []).collect()]
    assert max(sums) / min(sums) < 1.01


def test_lift_over_between_equal_layouts(spark):
    agp = spark.createDataFrame([("c", 1, 100, 1, "W", "t", 1, 100, "+")], "chrom string, start long, stop long, number long, type string, id string, tig_start long, tig_stop long, orientation string")
    pairs = spark.createDataFrame([(1, "c", 5, "c", 90), (2, "c", 5, "c", 101)], "read_id long, chr1 string, pos1 long, chr2 string, pos2 long")
    assert [tuple(r) for r in assembly.lift_over(pairs, agp, agp).collect()] == [(1, "c", 5, "c", 90)]


def test_features_turn_with_their_contig(spark):
    agp = spark.createDataFrame([("c", 101, 200, "t", "-")], "chrom string, start long, stop long, id string, orientation string")
    f = spark.createDataFrame([("t", 1, 10, "-")], "id string, start long, stop long, strand string")
    assert tuple(assembly.features_to_chrom(f, agp).first())[:4] == ("c", 191, 200, "+")


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first a->b\nACGT\nAC\n>tig2\nGG\n")
    assert {(r["chrom"], r["seq"]) for r in readers.fasta(spark, str(tmp_path / "a.fa")).collect()} == {("s1", "ACGTAC"), ("tig2", "GG")}
    assert readers.fasta(spark, str(tmp_path / "a.fa"), ["tig"]).count() == 1
    (tmp_path / "x.agp").write_text("#c\nChr1\t1\t10\t1\tW\tctg1\t1\t10\t+\nChr1\t11\t20\t2\tU\t10\tcontig\tyes\tmap\n")
    placed, gaps = readers.agp(spark, str(tmp_path / "x.agp"))
    assert placed.first()["id"] == "ctg1" and gaps.first()["length"] == 10
    (tmp_path / "t.tour").write_text(">old\na+ b-\n>new\nb+ a-\n")
    assert [tuple(r) for r in readers.tour(spark, str(tmp_path / "t.tour")).collect()] == [(0, "b", "+"), (1, "a", "-")]
    (tmp_path / "r.fq").write_text("@r1\nACGT\n+\n@III\n@r2\nAC\n+\n@I\n@r3\nACG\n+\nIII\n")
    assert tuple(readers.fastq_counts(spark, str(tmp_path / "r.fq")).first()) == (3, 9)
    assert sorted((r["name"], r["seq"], r["quality"]) for r in readers.fastq(spark, str(tmp_path / "r.fq")).collect())[0] == ("r1", "ACGT", "@III")
    (tmp_path / "m.txt").write_text("1\t1\t3\n1\t2\t4\n")
    assert readers.sparse_matrix(spark, str(tmp_path / "m.txt")).agg(F.min("bin1")).first()[0] == 0
    writers.tsv(spark.createDataFrame([("a", None, ["x", "y"])], "a string, b string, c array<string>"), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a\t.\tx,y"]
    writers.fasta(spark.createDataFrame([("s", "ACGTA")], "chrom string, seq string"), str(tmp_path / "fa"), 2)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "fa")).collect()] == [">s", "AC", "GT", "A"]


def test_streams_count_as_batches_do(spark, sf, tmp_path):
    spark.createDataFrame([("c", 5, "c", 25), ("c", 7, "c", 29), ("c", 7, "d", 29)], "chr1 string, pos1 long, chr2 string, pos2 long").write.parquet(str(tmp_path / "p"))
    q = streaming.to_memory(streaming.pixel_counts(spark.readStream.schema("chr1 string, pos1 long, chr2 string, pos2 long").parquet(str(tmp_path / "p")), 10), "pixel_counts")
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("pixel_counts").collect()] == [("c", 0, 2, 2)]


def test_alleles_that_share_genes_are_folded(spark):
    from strandframe.operators import genes

    d = spark.createDataFrame([("c", "a", "g1"), ("c", "a", "g2"), ("c", "b", "g2"), ("c", "b", "g3"), ("c", "b", "g4"), ("c", "d", "g9"), ("e", "z", "g1")], "chrom string, allele_id string, gene string")
    got = {tuple(r) for r in genes.fold_shared(d).collect()}
    assert got == {("c", "b", "g1"), ("c", "b", "g2"), ("c", "b", "g3"), ("c", "b", "g4"), ("c", "d", "g9"), ("e", "z", "g1")}


def test_pairs_meet_at_one_level(spark):
    a = spark.createDataFrame([("c", k * 100, k * 100 + 60, k) for k in range(400)], "chrom string, start long, stop long, id long")
    a = a.union(spark.createDataFrame([("c", 0, 40_000, 1000), ("c", 5, 9_000, 1001)], a.schema))
    b = a.select([F.col(c).alias(f"b_{c}") for c in a.columns])
    met = intervals.bucket_pairs(a, b, 16)
    assert met.where("__level > 0 and __la = 0 and __lb = 0").count() == 0  # short ones never meet in wide buckets
    rows = [tuple(r) for r in a.collect()]
    want = sorted((x[3], y[3]) for x in rows for y in rows if x[1] < y[2] and x[2] > y[1])
    assert sorted((r["id"], r["b_id"]) for r in intervals.overlap_join(a, a, width=16).collect()) == want


def test_logarithmic_expectation_counts_empty_pairs(spark):
    p = spark.createDataFrame([("c", 0, 0, 4), ("c", 0, 3, 2)], "chrom string, bin1 long, bin2 long, n long")
    got = {r["d"]: r["expected"] for r in contacts.expected_by_log_bins(p, 6).collect()}
    low, high = next(x for x in contacts.log_bins(6) if x[0] <= 3 < x[1])
    assert abs(got[0] - 4 / 6) < 1e-12 and abs(got[3] - 2 / sum(6 - d for d in range(low, high))) < 1e-12


def test_runs_of_lines_cross_ranges(spark, monkeypatch):
    from strandframe.operators import genes

    monkeypatch.setattr(genes._parts, "__defaults__", (10,))
    d = spark.createDataFrame([(k, "x" if 5 <= k < 27 else "y") for k in range(40)], "line_no long, v string")
    assert {r["line_no"] for r in genes.without_repeats(d, "v").collect()} == {0, 5, 27}
    assert {(r["line_no"], r["new_id"]) for r in genes.renumbered_runs(d, "v").collect()} == {(k, 1 if k < 5 else 6 if k < 27 else 28) for k in range(40)}


def test_anchors_and_collinearity(spark, tmp_path):
    (tmp_path / "a.anchors").write_text("###\ng1\tg2\t100\ng3\tg4\t90\n###\ng5\tg6\t80\n")
    assert sorted((r["gene1"], r["block"]) for r in readers.anchors(spark, str(tmp_path / "a.anchors")).collect()) == [("g1", 1), ("g3", 1), ("g5", 2)]
    (tmp_path / "c.collinearity").write_text("## Alignment 0: score=250.0 e_value=1e-9 N=2 Chr1&Chr2 minus\n  0-  0:\tg1\tg2\t1e-5\n  0-  1:\tg3\tg4\t0\n")
    got = sorted((r["block"], r["nth"], r["gene1"], r["score"], r["orientation"]) for r in readers.collinearity(spark, str(tmp_path / "c.collinearity")).collect())
    assert got == [(0, 0, "g1", 250.0, "-"), (0, 1, "g3", 250.0, "-")]


@pytest.mark.parametrize(("kind", "line", "want"), [
    ("bed4", "c\t1\t5\tg", ("c", 1, 5, "g")),
    ("bedgraph", "c\t1\t5\t0.5", ("c", 1, 5, 0.5)),
    ("bg5", "c\t1\t5\t0.5\t-1", ("c", 1, 5, 0.5, -1.0)),
    ("tad", "c\t1\t5\t2", ("c", 1, 5, 2)),
    ("mcscanx_gff", "c\tg\t1\t5", ("c", "g", 1, 5)),
    ("valid_pairs", "r\tc\t1\t+\td\t9\t-\t300\tF1\tF2", ("r", "c", 1, "+", "d", 9, "-", 300, "F1", "F2")),
    ("blast6", "q\ts\t99.5\t100\t1\t0\t1\t100\t5\t104\t1e-9\t180", ("q", "s", 99.5, 100, 1, 0, 1, 100, 5, 104, 1e-9, 180.0)),
    ("stat", "Total_pairs_processed\t12", ("Total_pairs_processed", 12)),
    ("mosdepth", "c\t1\t5\tg\t3.5", ("c", 1, 5, "g", 3.5)),
])
def test_tables_are_read(spark, tmp_path, kind, line, want):
    (tmp_path / "f").write_text("#comment\n" + line + "\n")
    assert tuple(readers.read(spark, str(tmp_path / "f"), kind).first()) == want


def test_p_values_share_rates_across_parts(spark):
    values = [0.0] * 40 + [k / 997 for k in range(1, 400)]
    d = spark.createDataFrame([(f"g{k}", v) for k, v in enumerate(values)], "gene string, p double")
    got = {r["p"]: r["fdr"] for r in stats.false_discovery(d, "p", "gene").collect()}
    order, m, least, want = sorted(values), len(values), 1.0, {}
    for rank in range(m, 0, -1):
        least = min(least, order[rank - 1] * m / rank)
        want[order[rank - 1]] = least
    assert len(got) == len(want) and all(abs(got[p] - want[p]) < 1e-12 for p in want)
