"""Each reader on a file of its format, and writers read back."""

from __future__ import annotations

from strandframe.operators import assembly, compartments
from strandframe.sources import readers, writers


def put(path, name, text):
    (path / name).write_text(text)
    return str(path / name)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_interval_readers(spark, tmp_path):
    bed = put(tmp_path, "a.bed", "#x\nc2\t5\t9\tn\t.\t+\nc1\t7\t9\tm\t3\t-\nc1\t1\t4\tk\t.\t.\n")
    assert rows(readers.bed(spark, bed, in_order=True)) == [("c1", 1, 4, "k", None, None), ("c1", 7, 9, "m", "3", "-"), ("c2", 5, 9, "n", None, "+")]
    gff = put(tmp_path, "a.gff", "##gff\nc1\ts\tgene\t1\t9\t.\t+\t.\tID=g\nc1\ts\tCDS\t2\t5\t.\t+\t0\tParent=g\n")
    assert rows(readers.gff(spark, gff, "CDS").select("chrom", "start", "stop", "attributes")) == [("c1", 2, 5, "Parent=g")] and readers.gff(spark, gff).count() == 2
    vcf = put(tmp_path, "a.vcf", "##v\n#CHROM\nc1\t5\ti\tA\tG\t9\tPASS\tDP=3\tGT\t0/1\nc1\t6\t.\tA\tG\t9\tPASS\tDP=3\tGT\t0/1\n")
    assert rows(readers.vcf(spark, vcf).select("pos", "info", "sample")) == [(5, "DP=3", "0/1")]
    assert rows(readers.read(spark, put(tmp_path, "s.sizes", "c1\t100\nc2\t7\n"), "chrom_sizes")) == [("c1", 100), ("c2", 7)]


def test_pair_readers(spark, tmp_path):
    blast = put(tmp_path, "a.blast", "q\tq\t100\t9\t0\t0\t1\t9\t1\t9\t0.0\t50\nq\ts\t98.5\t9\t0\t0\t1\t9\t1\t9\t1e-5\t40.5\n")
    assert rows(readers.blast(spark, blast, only_ids=True)) == [("q", "s")] and rows(readers.blast(spark, blast, keep_self=True).select("evalue")) == [(0.0,), (1e-5,)]
    link = put(tmp_path, "a.link", "c1\t1\t2\tc2\t3\t4\tg\th\nc1\t5\t6\tc2\t7\t8\n")
    assert rows(readers.links(spark, link).select("chrom1", "start2", "gene2")) == [("c1", 3, "h"), ("c1", 7, None)]
    assert rows(readers.links(spark, link, swapped=True).select("chrom1", "start1", "gene1"))[0] == ("c2", 3, "h")
    assert rows(readers.tandem(spark, put(tmp_path, "t.csv", "a,b\nc,d\n"))) == [("a", "b"), ("c", "d")]
    assert rows(readers.mcscanx_gff(spark, put(tmp_path, "m.gff", "c1\tg\t1\t5\ntig9\th\t1\t5\n"))) == [("c1", "g", 1, 5)]
    assert rows(readers.bad_pairs(spark, put(tmp_path, "p.pairs", " ".join("abcdefghijkl") + "\na b\n"))) == [("a b",)]
    assert dict(rows(readers.rename_list(spark, put(tmp_path, "r.txt", "a  b\n\nx\ty z\na c\n")))) == {"a": "c", "x": "y"}


def test_table_readers(spark, tmp_path):
    out = put(tmp_path, "r.out", "   SW  perc\nscore\n\n  1504   1.3  0.4  1.3  c1  10  90 (9) +  (CA)n  Simple_repeat 1 2 (0) 7\n 20 1 1 1 c2 5 6 (1) C L1 LINE/L1 1 2 (0)\n")
    assert rows(readers.repeats(spark, out)) == [(1504, "c1", 10, 90, "+", "(CA)n", "Simple_repeat", "7"), (20, "c2", 5, 6, "C", "L1", "LINE/L1", None)]
    (tmp_path / "x y").mkdir()
    a, b = put(tmp_path, "one.stat", "total\t10\ncis\t4\n"), put(tmp_path / "x y", "one.stat", "total\t7\n")
    assert sorted(rows(readers.stat(spark, {"s1": a, "s2": b}).select("sample", "total", "cis"))) == [("s1", 10, 4), ("s2", 7, None)]
    assert rows(readers.allele_table(spark, put(tmp_path, "al.tsv", "geneA\tgeneB\na\t.\n.\tb\n"))) == [("a", None), (None, "b")]
    contigs = readers.allele_contigs(spark, put(tmp_path, "al.ctg", "c1 g x y z\nc2\tg2\tw\nc3 g3\n"))
    assert rows(contigs) == [("c1", "g", 0, "x"), ("c1", "g", 1, "y"), ("c1", "g", 2, "z"), ("c2", "g2", 0, "w")]
    assert rows(readers.clusters(spark, put(tmp_path, "cl.txt", "#g\tn\tc\ng1\t2\tx y\n"))) == [("g1", 0, "x"), ("g1", 1, "y")]


def test_writers_read_back(spark, tmp_path):
    bins, pixels = spark.createDataFrame([(0, "c", 0, 10)], "bin int, chrom string, start long, stop long"), spark.createDataFrame([(0, 0, 3.0)], "bin1 long, bin2 long, n double")
    writers.pixels(bins, pixels, str(tmp_path / "m"))
    got = readers.contact_matrix(spark, str(tmp_path / "m"))
    assert rows(got[0]) == rows(bins) and rows(got[1]) == rows(pixels)
    writers.tsv(spark.createDataFrame([("c1", 1, ["a", "b"]), ("c2", None, [])], "chrom string, start long, names array<string>"), str(tmp_path / "by"), by=["chrom"])
    assert [p.read_text() for p in (tmp_path / "by" / "chrom=c1").glob("*.csv")] == ["1\ta,b\n"] and [p.read_text() for p in (tmp_path / "by" / "chrom=c2").glob("*.csv")] == [".\t\n"]
    writers.fasta(spark.createDataFrame([("s1", "ACGTAC", "g1"), ("s2", "GG", "g2")], "chrom string, seq string, grp string"), str(tmp_path / "fa"), 4, by="grp")
    assert [p.read_text() for p in (tmp_path / "fa" / "grp=g1").glob("*.txt")] == [">s1\nACGT\nAC\n"]


def test_by_position(spark):
    a = spark.createDataFrame([("c2", 1, 0.5), ("c1", 9, 0.1), ("c1", 2, 0.2), ("c3", 0, 0.9)], "chrom string, start long, score double")
    b = spark.createDataFrame([("x", 5, 1.0), ("x", 4, 2.0), ("y", 1, 3.0)], "chrom string, start long, score double")
    got = sorted(compartments.beside(a, b, ["chrom", "start"]).select("place", "score", "score2").collect())
    assert [tuple(r) for r in got] == [(0, 0.2, 2.0), (1, 0.1, 1.0), (2, 0.5, 3.0)]
    links = spark.createDataFrame([("c1", 0, 4, "c1", 10, 14), ("c1", 0, 4, "c1", 0, 5), ("c1", 90, 99, "c1", 0, 5)], "chrom1 string, start1 long, stop1 long, chrom2 string, start2 long, stop2 long")
    bins = spark.createDataFrame([("c1", 0, 10, 0.5), ("c1", 10, 20, -0.5)], "chrom string, start long, stop long, score double")
    assert [(r["start2"], r["way"]) for r in compartments.flips_of_links(links, bins, bins).collect()] == [(10, "a2b")]
    agp = spark.createDataFrame([("c", 101, 200, "t1", "+"), ("c", 301, 400, "t2", "-")], "chrom string, start long, stop long, id string, orientation string")
    pairs = spark.createDataFrame([(1, "t1", 0, "t2", 0), (2, "t2", 99, "t1", 5), (3, "t1", 1, "lost", 1)], "read_id long, ref1 string, p1 long, ref2 string, p2 long")
    assert sorted(tuple(r) for r in assembly.contig_pairs_to_chrom(pairs, agp).collect()) == [(1, "c", 101, "c", 400), (2, "c", 301, "c", 106)]
