"""Every registered query of the genomic operators: a DataFrame plan and the SQL that it must agree with.

``add`` takes the name, the operators' ids, the plan (a function of ``v``, which gives views by name) and the SQL, in which
views stand in braces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import assembly as ASM
from ..operators import compartments as AB
from ..operators import contacts as C
from ..operators import genes as G
from ..operators import homology as H
from ..operators import intervals as I
from ..operators import rescue as R
from ..operators import stats as T
from .fixtures import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Query to the operators that it covers.
COVERS: dict[str, list[str]] = {}


def add(name: str, covers: str, plan: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(lambda n: view(spark, sf_dir, n))
    COVERS[name] = covers.split()
    if sql is not None:
        ORACLE_SQL[name] = oracle(sql)


def nearest(column: str | Column, places: int) -> Column:
    """A double rounded as the SQL does it: scaled first, then taken to the nearest whole number, halves away from zero. Spark's
    own rounding to places goes by the decimal digits of the number, where other numbers are halves."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column * F.lit(10.0**places)) / F.lit(10.0**places)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: nearest(c, 6) for c in columns})


big = lambda c: F.col(c).cast("long").alias(c)

# --- pairs -------------------------------------------------------------------------------------------------------------
add("decay_histogram", "FLT-01 FLT-02 STA-01 SRC-10", lambda v: C.decay(v("valid_pairs"), 10000, 10000, 500000),
    "SELECT chr1, cast(floor(abs(pos2-pos1)/10000)*10000 AS bigint) AS dist, count(*) AS n FROM {valid_pairs} WHERE chr1 = chr2 AND cast(floor(abs(pos2-pos1)/10000)*10000 AS bigint) BETWEEN 10000 AND 500000 GROUP BY 1, 2")
add("decay_slope_by_chrom", "STA-01 STA-02", lambda v: C.decay_slope(C.decay(v("valid_pairs"), 10000, 10000, 500000)),
    "SELECT chr1, CASE WHEN count(DISTINCT dist) >= 2 THEN round(regr_slope(log10(n), log10(dist)), 6) END AS slope FROM (SELECT chr1, cast(floor(abs(pos2-pos1)/10000)*10000 AS bigint) AS dist, count(*) AS n FROM {valid_pairs} WHERE chr1 = chr2 GROUP BY 1, 2) x WHERE dist BETWEEN 10000 AND 500000 GROUP BY chr1")
add("cis_pairs", "FLT-01", lambda v: C.cis(v("valid_pairs")).select("read_id", "chr1", "pos1", "pos2"), "SELECT read_id, chr1, pos1, pos2 FROM {valid_pairs} WHERE chr1 = chr2")
add("trans_pairs", "FLT-01", lambda v: C.trans(v("valid_pairs")).select("read_id", "chr1", "chr2"), "SELECT read_id, chr1, chr2 FROM {valid_pairs} WHERE chr1 <> chr2")
add("pair_distance", "FLT-02", lambda v: C.distance(v("valid_pairs")).select("read_id", "distance"), "SELECT read_id, CASE WHEN chr1 = chr2 THEN abs(pos1-pos2) ELSE 0 END AS distance FROM {valid_pairs}")
add("pairs_on_chromosomes", "FLT-03", lambda v: v("valid_pairs").join(F.broadcast(v("chrom_sizes").where("chrom <> 'Chr4'").select(F.col("chrom").alias("chr1"))), "chr1", "left_semi").groupBy("chr1").agg(F.count(F.lit(1)).alias("n")),
    "SELECT chr1, count(*) AS n FROM {valid_pairs} WHERE chr1 IN (SELECT chrom FROM {chrom_sizes} WHERE chrom <> 'Chr4') GROUP BY chr1")
add("chromosome_shares", "MAT-06 MAT-07", lambda v: rounded(C.chromosome_shares(v("valid_pairs")), "ratio"),
    "SELECT chrom, count(*) FILTER (WHERE cis) AS cis, count(*) FILTER (WHERE NOT cis) AS trans, round(CASE WHEN count(*) FILTER (WHERE NOT cis) > 0 THEN cast(count(*) FILTER (WHERE cis) AS double)/count(*) FILTER (WHERE NOT cis) END, 6) AS ratio FROM (SELECT chr1 AS chrom, chr1 = chr2 AS cis FROM {valid_pairs} UNION ALL SELECT chr2, false FROM {valid_pairs} WHERE chr1 <> chr2) x GROUP BY chrom")
add("trans_counts", "AGG-14 AGG-13", lambda v: C.counted_both_ways(C.trans(v("valid_pairs")), "chr1", "chr2"),
    "SELECT x, y, count(*) AS n FROM (SELECT chr1 AS x, chr2 AS y FROM {valid_pairs} WHERE chr1 <> chr2 UNION ALL SELECT chr2, chr1 FROM {valid_pairs} WHERE chr1 <> chr2) t GROUP BY 1, 2")
add("territories", "MAT-21 MAT-22", lambda v: rounded(C.territories(v("valid_pairs")), "score"),
    """WITH o AS (SELECT x, y, count(*) AS n FROM (SELECT chr1 AS x, chr2 AS y FROM {valid_pairs} WHERE chr1 <> chr2 UNION ALL SELECT chr2, chr1 FROM {valid_pairs} WHERE chr1 <> chr2) t GROUP BY 1, 2),
    t AS (SELECT x, sum(n) AS t FROM o GROUP BY x) SELECT o.x, o.y, o.n, round(log2(o.n / (cast(a.t AS double)*cast(b.t AS double)/(SELECT cast(sum(n) AS double) FROM o))), 6) AS score FROM o JOIN t a ON a.x = o.x JOIN t b ON b.x = o.y""")
add("fragment_sizes", "STA-08", lambda v: rounded(T.histogram(v("valid_pairs"), "frag_size", 50, ["chr1"]), "share"),
    "SELECT chr1, bin, n, round(cast(n AS double)/cast(sum(n) OVER (PARTITION BY chr1) AS double), 6) AS share FROM (SELECT chr1, cast(floor(frag_size/50)*50 AS bigint) AS bin, count(*) AS n FROM {valid_pairs} GROUP BY 1, 2) x")
add("fragment_coverage", "AGG-09 SET-02", lambda v: (lambda p: p.select("chr1", F.explode(F.array("site1", "site2")).alias("site")).groupBy("chr1").agg(F.countDistinct("site").alias("fragments")))(v("valid_pairs")),
    "SELECT chr1, count(DISTINCT site) AS fragments FROM (SELECT chr1, site1 AS site FROM {valid_pairs} UNION ALL SELECT chr1, site2 FROM {valid_pairs}) x GROUP BY chr1")
add("unused_sites", "AGG-09 SET-02 JN-05", lambda v: v("valid_pairs").select(F.col("site2").alias("site")).distinct().join(v("valid_pairs").where("chr1 = 'Chr1' and read_id % 16 = 1").select(F.col("site1").alias("site")).distinct(), "site", "left_anti"),
    "SELECT DISTINCT site2 AS site FROM {valid_pairs} WHERE site2 NOT IN (SELECT site1 FROM {valid_pairs} WHERE chr1 = 'Chr1' AND read_id % 16 = 1)")
add("library_rates", "AGG-10 SRC-24 SCL-12", lambda v: v("valid_pairs").agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("chr1") == F.col("chr2"), 1)).alias("cis")).select("pairs", "cis", S.percent_text(F.col("cis"), F.col("pairs")).alias("cis_rate")),
    "SELECT count(*) AS pairs, count(*) FILTER (WHERE chr1 = chr2) AS cis, printf('%.2f%%', cast(count(*) FILTER (WHERE chr1 = chr2) AS double)*100/count(*)) AS cis_rate FROM {valid_pairs}")
add("pairs_to_links", "SNK-07 SCL-08", lambda v: v("valid_pairs").select("read_id", S.strand_flag(F.col("strand1")).alias("flag1"), "chr1", "pos1", S.strand_flag(F.col("strand2")).alias("flag2"), "chr2", "pos2"),
    "SELECT read_id, CASE WHEN strand1 = '+' THEN 0 ELSE 16 END AS flag1, chr1, pos1, CASE WHEN strand2 = '+' THEN 0 ELSE 16 END AS flag2, chr2, pos2 FROM {valid_pairs}")
add("resolution_estimate", "MAT-25 WIN-08", lambda v: rounded(C.resolutions(v("valid_pairs"), v("chrom_sizes"), list(range(10, 1001, 10))), "share"),
    """WITH e AS (SELECT chr1 AS chrom, pos1 AS pos FROM {valid_pairs} UNION ALL SELECT chr2, pos2 FROM {valid_pairs}), b AS (SELECT chrom, cast(floor(pos/100) AS bigint) AS k, count(*) AS n FROM e GROUP BY 1, 2),
    f AS (SELECT cast(unnest(range(10, 1001, 10)) AS integer) AS factor), w AS (SELECT factor, chrom, unnest(range(0, cast(floor(size/100) AS bigint) + factor, factor)) AS i FROM f, {chrom_sizes}),
    c AS (SELECT factor, chrom, cast(floor(k/factor)*factor AS bigint) AS i, sum(n) AS n FROM b, f WHERE k % factor < factor - 1 GROUP BY 1, 2, 3)
    SELECT w.factor, count(*) AS bins, count(*) FILTER (WHERE n > 1000) AS covered, round(cast(count(*) FILTER (WHERE n > 1000) AS double)/count(*), 6) AS share FROM w LEFT JOIN c ON c.factor = w.factor AND c.chrom = w.chrom AND c.i = w.i GROUP BY 1""")
add("row_sum_quantiles", "AGG-16", lambda v: rounded(C.bin_sums(v("genome_pixels"), []).agg(*[F.percentile("total", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.25, 0.2, 0.1)], F.avg("total").alias("mean"), F.stddev_samp("total").alias("sd")), "p25", "p20", "p10", "mean", "sd"),
    "SELECT round(quantile_cont(total, 0.25), 6) AS p25, round(quantile_cont(total, 0.2), 6) AS p20, round(quantile_cont(total, 0.1), 6) AS p10, round(avg(total), 6) AS mean, round(stddev_samp(total), 6) AS sd FROM (SELECT bin, cast(sum(n) AS double) AS total FROM (SELECT bin1 AS bin, n FROM {genome_pixels} UNION ALL SELECT bin2, n FROM {genome_pixels} WHERE bin1 <> bin2) x GROUP BY bin) y")

# --- matrices ----------------------------------------------------------------------------------------------------------
add("contact_pixels", "MAT-01 MAT-18 SNK-16", lambda v: C.pixels(v("valid_pairs"), 20000), "SELECT chrom, bin1, bin2, n FROM {pixels}")
add("pixels_by_resolution", "MAT-24", lambda v: (lambda fine: fine.withColumn("size", F.lit(20000)).unionByName(C.coarsen(fine, 5, ["chrom"]).withColumn("size", F.lit(100000))).groupBy("size", "chrom").agg(F.count(F.lit(1)).alias("pixels")))(C.pixels(v("valid_pairs"), 20000)),
    "SELECT size, chrom, count(*) AS pixels FROM (SELECT 20000 AS size, chrom, bin1, bin2 FROM {pixels} UNION SELECT 100000, chrom, cast(floor(bin1/5) AS bigint), cast(floor(bin2/5) AS bigint) FROM {pixels}) x GROUP BY 1, 2")
add("contig_offsets", "MAT-02 WIN-03", lambda v: C.contig_offsets(v("contigs"), 10000).select("id", "bins", "offset"),
    "SELECT id, cast(ceil(length/10000) AS bigint) AS bins, cast(coalesce(sum(cast(ceil(length/10000) AS bigint)) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS \"offset\" FROM {contigs}")
add("pixels_from_alignments", "MAT-01 SRC-30", lambda v: C.pixels_from_alignments(v("alignments"), C.contig_offsets(v("agp_old").select("id", F.col("tig_stop").alias("length")), 5000), 5000, 20),
    """WITH o AS (SELECT id, cast(2*(row_number() OVER (ORDER BY id) - 1) AS bigint) AS off FROM {agp_old})
    SELECT least(a.off + cast(floor(p1/5000) AS bigint), b.off + cast(floor(p2/5000) AS bigint)) AS bin1, greatest(a.off + cast(floor(p1/5000) AS bigint), b.off + cast(floor(p2/5000) AS bigint)) AS bin2, count(*) AS n FROM {alignments} JOIN o a ON a.id = ref1 JOIN o b ON b.id = ref2 WHERE NOT is_unmapped AND is_read1 AND mapq >= 20 GROUP BY 1, 2""")
add("symmetric_pixels", "MAT-03 SRC-11", lambda v: C.symmetric(v("pixels")), "SELECT chrom, bin1, bin2, n FROM {pixels} UNION ALL SELECT chrom, bin2, bin1, n FROM {pixels} WHERE bin1 <> bin2")
add("cis_bin_sums", "MAT-04", lambda v: C.bin_sums(v("pixels"), ["chrom"]), "SELECT chrom, bin, cast(sum(n) AS bigint) AS total FROM (SELECT chrom, bin1 AS bin, n FROM {pixels} UNION ALL SELECT chrom, bin2, n FROM {pixels} WHERE bin1 <> bin2) x GROUP BY 1, 2")
add("trans_bin_sums", "MAT-05", lambda v: C.bin_sums(v("genome_pixels").where("floor(bin1/50) <> floor(bin2/50)"), []), "SELECT bin, cast(sum(n) AS bigint) AS total FROM (SELECT bin1 AS bin, n FROM {genome_pixels} WHERE floor(bin1/50) <> floor(bin2/50) UNION ALL SELECT bin2, n FROM {genome_pixels} WHERE floor(bin1/50) <> floor(bin2/50)) x GROUP BY bin")
add("off_diagonal_pixels", "MAT-15", lambda v: C.drop_diagonals(v("pixels"), 1), "SELECT chrom, bin1, bin2, n FROM {pixels} WHERE abs(bin2-bin1) > 1")
OE = """WITH valid AS (SELECT DISTINCT chrom, bin FROM (SELECT chrom, bin1 AS bin FROM {pixels} UNION ALL SELECT chrom, bin2 FROM {pixels}) x),
    np AS (SELECT a.chrom, b.bin - a.bin AS d, count(*) AS pairs FROM valid a JOIN valid b ON a.chrom = b.chrom AND a.bin <= b.bin GROUP BY 1, 2),
    tot AS (SELECT chrom, bin2 - bin1 AS d, sum(n) AS total FROM {pixels} GROUP BY 1, 2),
    ex AS (SELECT np.chrom, np.d, pairs, cast(coalesce(total, 0) AS double)/pairs AS expected FROM np LEFT JOIN tot ON np.chrom = tot.chrom AND np.d = tot.d),
    oe AS (SELECT p.chrom, bin1, bin2, n, CASE WHEN expected > 0 THEN n/expected ELSE 0.0 END AS oe FROM {pixels} p JOIN ex ON p.chrom = ex.chrom AND p.bin2 - p.bin1 = ex.d) """
add("expected_by_distance", "MAT-08", lambda v: rounded(C.expected(v("pixels")), "expected"), OE + "SELECT chrom, d, pairs, round(expected, 6) AS expected FROM ex")
add("obs_over_expected", "MAT-08", lambda v: rounded(C.observed_over_expected(v("pixels")), "oe"), OE + "SELECT chrom, bin1, bin2, n, round(oe, 6) AS oe FROM oe")
add("interaction_score", "MAT-09", lambda v: rounded(C.interaction_score(v("pixels")), "score"),
    OE + "SELECT b.chrom, b.bin, round(b.total/m.bins, 6) AS score FROM (SELECT chrom, bin, sum(oe) AS total FROM (SELECT chrom, bin1 AS bin, oe FROM oe UNION ALL SELECT chrom, bin2, oe FROM oe WHERE bin1 <> bin2) x GROUP BY 1, 2) b JOIN (SELECT chrom, max(bin2) + 1 AS bins FROM {pixels} GROUP BY chrom) m ON b.chrom = m.chrom")
add("matrix_asymmetry", "MAT-14", lambda v: C.asymmetry(v("genome_pixels")).select(big("difference")),
    "SELECT max(abs(coalesce(a.n, 0) - coalesce(b.n, 0))) AS difference FROM {genome_pixels} a FULL JOIN {genome_pixels} b ON a.bin1 = b.bin2 AND a.bin2 = b.bin1")
add("coarse_pixels", "MAT-17", lambda v: C.coarsen(v("pixels"), 5, ["chrom"]), "SELECT chrom, cast(floor(bin1/5) AS bigint) AS bin1, cast(floor(bin2/5) AS bigint) AS bin2, cast(sum(n) AS bigint) AS n FROM {pixels} GROUP BY 1, 2, 3")
add("reordered_pixels", "MAT-17", lambda v: C.reorder(v("genome_pixels"), C.bin_sums(v("genome_pixels"), []).select("bin", (F.lit(199).cast("long") - F.col("bin")).alias("place")).where("bin % 7 <> 0")),
    "SELECT least(199-bin1, 199-bin2) AS bin1, greatest(199-bin1, 199-bin2) AS bin2, cast(sum(n) AS bigint) AS n FROM {genome_pixels} WHERE bin1 % 7 <> 0 AND bin2 % 7 <> 0 GROUP BY 1, 2")
add("two_matrices", "MAT-23", lambda v: v("genome_pixels").where("bin1 <= bin2").select("bin1", "bin2", "n", F.lit("upper").alias("part")).unionByName(v("genome_pixels").where("bin1 < bin2").select(F.col("bin2").alias("bin1"), F.col("bin1").alias("bin2"), (F.col("n") * 2).alias("n"), F.lit("lower").alias("part"))),
    "SELECT bin1, bin2, n, 'upper' AS part FROM {genome_pixels} UNION ALL SELECT bin2, bin1, n*2, 'lower' FROM {genome_pixels} WHERE bin1 < bin2")
add("log_matrix", "MAT-18", lambda v: C.counted_both_ways(v("genome_pixels").where("n > 0"), "bin1", "bin2").select("x", "y", nearest(F.log2(F.col("n").cast("double")), 6).alias("score")),
    "SELECT x, y, round(log2(cast(count(*) AS double)), 6) AS score FROM (SELECT bin1 AS x, bin2 AS y FROM {genome_pixels} UNION ALL SELECT bin2, bin1 FROM {genome_pixels}) t GROUP BY 1, 2")
LOG_OE = """WITH s AS (SELECT greatest(2, cast(floor(ln(50)/ln(1.03)) AS bigint)) AS many), pt AS (SELECT DISTINCT cast(round(pow(10.0, i*log10(50)/(many - 1))) AS bigint) AS x FROM s, unnest(range(0, many)) t(i)),
    r AS (SELECT cast(0 AS bigint) AS low, cast(1 AS bigint) AS high UNION ALL SELECT x, y FROM (SELECT x, lead(x) OVER (ORDER BY x) AS y FROM pt) z WHERE y IS NOT NULL),
    np AS (SELECT low, high, sum(50 - d) AS pairs FROM r, unnest(range(low, high)) t(d) GROUP BY 1, 2),
    ex AS (SELECT p.chrom, low, high, cast(sum(n) AS double)/cast(min(pairs) AS double) AS expected FROM {pixels} p JOIN np ON bin2 - bin1 >= low AND bin2 - bin1 < high GROUP BY 1, 2, 3),
    loe AS (SELECT p.chrom, bin1, bin2, n, n/expected AS oe FROM {pixels} p JOIN ex ON p.chrom = ex.chrom AND bin2 - bin1 >= low AND bin2 - bin1 < high) """
add("expected_by_log_bins", "MAT-10", lambda v: rounded(C.expected_by_log_bins(v("pixels"), 50), "expected"), LOG_OE + "SELECT chrom, d, round(expected, 6) AS expected FROM ex, unnest(range(low, high)) t(d)")
add("obs_over_log_bins", "MAT-10", lambda v: rounded(C.observed_over_log_bins(v("pixels"), 50), "oe"), LOG_OE + "SELECT chrom, bin1, bin2, n, round(oe, 6) AS oe FROM loe")
add("balanced_matrix", "MAT-11", lambda v: rounded(C.balanced(v("genome_pixels")), "balanced"))
add("balanced_both_ways", "MAT-12", lambda v: rounded(C.balanced_both_ways(v("genome_pixels")), "balanced"))
add("balanced_off_diagonal", "MAT-13 MAT-15", lambda v: rounded(C.corrected_safely(v("genome_pixels"), 200), "balanced"))
PC1 = lambda v: v("bg1").groupBy("chrom", (F.floor(F.col("start") / 20000)).cast("long").alias("bin")).agg(F.min("score").alias("pc1"))
add("compartment_strength", "MAT-16", lambda v: rounded(C.strength(C.observed_over_log_bins(v("pixels"), 50), PC1(v)), "mean"),
    LOG_OE + """, b AS (SELECT chrom, bin1, bin2, oe FROM loe UNION ALL SELECT chrom, bin2, bin1, oe FROM loe WHERE bin1 <> bin2), pc AS (SELECT g.chrom, cast(floor(start/20000) AS bigint) AS bin, min(score) AS pc1 FROM {bg1} g GROUP BY 1, 2),
    pm AS (SELECT pc.* FROM pc WHERE EXISTS (SELECT 1 FROM b WHERE b.chrom = pc.chrom AND b.bin1 = pc.bin)), qs AS (SELECT chrom, quantile_cont(pc1, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS l FROM pm GROUP BY 1), q AS (SELECT chrom, i, l[i + 1] AS lo, l[i + 2] AS hi FROM qs, unnest([0, 1, 2, 3, 4]) t(i)),
    c AS (SELECT pm.chrom, bin, i AS cell FROM pm JOIN q ON q.chrom = pm.chrom AND pc1 > lo AND pc1 < hi), sz AS (SELECT chrom, cell, count(*) AS bins FROM c GROUP BY 1, 2),
    sm AS (SELECT b.chrom, x.cell AS cell1, y.cell AS cell2, sum(oe) AS total FROM b JOIN c x ON x.chrom = b.chrom AND x.bin = bin1 JOIN c y ON y.chrom = b.chrom AND y.bin = bin2 GROUP BY 1, 2, 3)
    SELECT x.cell AS cell1, y.cell AS cell2, round(sum(coalesce(total, 0)/(x.bins*y.bins)), 6) AS mean, cast(sum(x.bins*y.bins) AS bigint) AS n FROM sz x JOIN sz y ON x.chrom = y.chrom LEFT JOIN sm ON sm.chrom = x.chrom AND cell1 = x.cell AND cell2 = y.cell GROUP BY 1, 2""")
add("compartment_strength_draws", "MAT-16", lambda v: C.strength_draws(C.observed_over_log_bins(v("pixels"), 50), PC1(v)).agg(F.count(F.lit(1)).alias("draws"), nearest(F.stddev_pop("score"), 6).alias("sd")))
add("group_row_medians", "MAT-19 MAT-20", lambda v: rounded(C.pair_medians(C.symmetric(v("genome_pixels")), v("genome_pixels").select(F.explode(F.array("bin1", "bin2")).alias("bin")).distinct().withColumn("grp", F.floor(F.col("bin") / 50).cast("long"))), "median", "mean"),
    """WITH s AS (SELECT bin1, bin2, n FROM {genome_pixels} UNION ALL SELECT bin2, bin1, n FROM {genome_pixels} WHERE bin1 <> bin2), b AS (SELECT DISTINCT bin1 AS bin, cast(floor(bin1/50) AS bigint) AS grp FROM s),
    g AS (SELECT DISTINCT floor(bin1/50) AS g1, floor(bin2/50) AS g2 FROM s), r AS (SELECT b.bin, b.grp AS grp1, cast(g.g2 AS bigint) AS grp2, coalesce(sum(s.n), 0) AS t FROM b JOIN g ON b.grp = g.g1 LEFT JOIN s ON s.bin1 = b.bin AND floor(s.bin2/50) = g.g2 GROUP BY 1, 2, 3)
    SELECT grp1, grp2, round(cast(median(t) AS double), 6) AS median, round(cast(avg(t) AS double), 6) AS mean FROM r GROUP BY 1, 2""")

# --- intervals ---------------------------------------------------------------------------------------------------------
add("domain_gene_overlap_f70", "INT-02 INT-01", lambda v: I.held_join(v("domains"), v("genes"), 0.7).select("chrom", "start", "stop", "b_gene", "overlap"),
    "SELECT d.chrom, d.start, d.stop, g.gene AS b_gene, least(d.stop, g.stop) - greatest(d.start, g.start) AS overlap FROM {domains} d JOIN {genes} g ON d.chrom = g.chrom AND d.start < g.stop AND d.stop > g.start WHERE least(d.stop, g.stop) - greatest(d.start, g.start) >= cast(0.7 AS double)*(g.stop-g.start)")
add("overlap_pairs", "INT-01", lambda v: I.overlap_join(v("bg1"), v("genes")).select("chrom", "start", "b_gene", "overlap"),
    "SELECT b.chrom, b.start, g.gene AS b_gene, least(b.stop, g.stop) - greatest(b.start, g.start) AS overlap FROM {bg1} b JOIN {genes} g ON b.chrom = g.chrom AND b.start < g.stop AND b.stop > g.start")
add("genes_per_domain", "INT-02 INT-05", lambda v: I.count_overlaps(v("domains").select("chrom", "start", "stop", "level"), v("genes"), ["chrom", "start", "stop", "level"], fraction_b=0.7),
    "SELECT d.chrom, d.start, d.stop, d.level, count(g.gene) AS n FROM {domains} d LEFT JOIN {genes} g ON d.chrom = g.chrom AND d.start < g.stop AND d.stop > g.start AND least(d.stop, g.stop) - greatest(d.start, g.start) >= cast(0.7 AS double)*(g.stop-g.start) GROUP BY 1, 2, 3, 4")
add("domain_of_gene", "INT-03", lambda v: I.best_overlap(v("genes"), v("domains"), 0.7, last=True).groupBy("gene").agg(F.max_by(F.struct("b_start", "b_stop"), F.struct("overlap", "b_start", "b_stop")).alias("d")).select("gene", "d.b_start", "d.b_stop"),
    "SELECT gene, b_start, b_stop FROM (SELECT g.gene, d.start AS b_start, d.stop AS b_stop, row_number() OVER (PARTITION BY g.gene ORDER BY least(d.stop, g.stop) - greatest(d.start, g.start) DESC, d.start DESC, d.stop DESC) AS r FROM {genes} g JOIN {domains} d ON d.chrom = g.chrom AND d.start < g.stop AND d.stop > g.start WHERE least(d.stop, g.stop) - greatest(d.start, g.start) >= cast(0.7 AS double)*(g.stop-g.start)) x WHERE r = 1")
PC1_PAIRS = "WITH o AS (SELECT g.gene, b.score FROM {genes} g JOIN {bg1} b ON b.chrom = g.chrom AND b.start < g.stop AND b.stop > g.start WHERE least(b.stop, g.stop) - greatest(b.start, g.start) >= cast(0.51 AS double)*(g.stop-g.start)), z AS (SELECT a.line_no, a.gene1, a.gene2, cast(round(x.score*10000000) AS bigint) AS v1, cast(round(y.score*10000000) AS bigint) AS v2 FROM {anchors} a JOIN o x ON x.gene = a.gene1 JOIN o y ON y.gene = a.gene2) "
add("gene_pc1_pairs", "INT-04 JN-08", lambda v: AB.gene_pairs(v("anchors"), v("genes"), v("bg1"), v("genes"), v("bg1")).select("line_no", "gene1", "gene2", *[F.round(F.col(c) * 10_000_000).cast("long").alias(c) for c in ("v1", "v2")]), PC1_PAIRS + "SELECT line_no, gene1, gene2, v1, v2 FROM z")
add("gene_density", "INT-05 INT-08 ASM-07", lambda v: I.count_overlaps(I.make_windows(v("chrom_sizes"), 100000), v("genes"), ["chrom", "start", "stop"]),
    "SELECT w.chrom, w.start, w.stop, count(g.gene) AS n FROM (SELECT chrom, s AS start, least(s + 100000, size) AS stop FROM (SELECT chrom, size, unnest(range(0, size, 100000)) AS s FROM {chrom_sizes}) t) w LEFT JOIN {genes} g ON g.chrom = w.chrom AND w.start < g.stop AND w.stop > g.start GROUP BY 1, 2, 3")
add("snp_rate_per_gene", "INT-06 FLT-04 SRC-08", lambda v: I.count_points(v("genes"), v("variants").where(F.split("sample", ":")[0].isin("0/1", "1/1")), ["gene", "start", "stop"]).select("gene", "n", nearest(F.col("n").cast("double") / (F.col("stop") - F.col("start") + 1), 9).alias("rate")),
    "SELECT g.gene, count(x.pos) AS n, round(cast(count(x.pos) AS double)/(g.stop - g.start + 1), 9) AS rate FROM {genes} g LEFT JOIN (SELECT chrom, pos FROM {variants} WHERE split_part(sample, ':', 1) IN ('0/1', '1/1')) x ON x.chrom = g.chrom AND x.pos BETWEEN g.start AND g.stop GROUP BY g.gene, g.start, g.stop")
add("sign_flips", "INT-07", lambda v: (lambda ab: ab[0].withColumn("way", F.lit("a2b")).unionByName(ab[1].withColumn("way", F.lit("b2a"))).select("chrom", "start", "way"))(AB.sign_flips(AB.paired(v("bg1"), v("bg2")), 0.1)),
    "SELECT a.chrom, a.start, CASE WHEN a.score > 0 THEN 'a2b' ELSE 'b2a' END AS way FROM {bg1} a JOIN {bg2} b ON a.chrom = b.chrom AND a.start = b.start WHERE abs(a.score - b.score) >= cast(0.1 AS double) AND (a.score > 0 AND b.score < 0 OR a.score < 0 AND b.score > 0)")
add("make_windows", "INT-08", lambda v: I.make_windows(v("chrom_sizes"), 30000), "SELECT chrom, s AS start, least(s + 30000, size) AS stop FROM (SELECT chrom, size, unnest(range(0, size, 30000)) AS s FROM {chrom_sizes}) t")
add("leaf_domains", "INT-09 INT-10", lambda v: I.leaves(v("domains")),
    "SELECT DISTINCT a.chrom, a.start, a.stop FROM {domains} a WHERE NOT EXISTS (SELECT 1 FROM {domains} b WHERE a.chrom = b.chrom AND b.start < a.stop AND b.stop > a.start AND b.stop - b.start < a.stop - a.start)")
add("bottom_domains_in_order", "INT-09", lambda v: I.fold_bottom(v("supplier").selectExpr("concat('Chr', cast(1 + (s_suppkey % 4) as string)) as chrom", "(s_suppkey*7717) % 900000 as start", "(s_suppkey*7717) % 900000 + 20000 + s_nationkey*1000 as stop", "s_suppkey"), "s_suppkey"))
add("merged_domains", "INT-10", lambda v: I.merge_keep_smallest(v("domains")))
add("domain_boundaries", "INT-11", lambda v: I.boundaries(v("domains")), "SELECT DISTINCT chrom, pos FROM (SELECT chrom, start AS pos FROM {domains} UNION ALL SELECT chrom, stop FROM {domains}) x")
add("boundary_flanks", "INT-11", lambda v: I.flanked(I.boundaries(v("domains")), v("chrom_sizes"), 5000),
    "SELECT x.chrom, greatest(pos - 5000, 0) AS start, least(pos + 5000, size) AS stop FROM (SELECT DISTINCT chrom, pos FROM (SELECT chrom, start AS pos FROM {domains} UNION ALL SELECT chrom, stop FROM {domains}) y) x JOIN {chrom_sizes} c ON c.chrom = x.chrom")
add("bins_mostly_in_domains", "INT-12", lambda v: I.mostly_inside(I.overlap_join(v("domains"), v("bg1"))).select("chrom", "start", "stop", "b_start"),
    "SELECT d.chrom, d.start, d.stop, b.start AS b_start FROM {domains} d JOIN {bg1} b ON d.chrom = b.chrom AND d.start < b.stop AND d.stop > b.start WHERE least(d.stop, b.stop) - greatest(d.start, b.start) >= cast(0.5 AS double)*(b.stop - b.start)")
add("split_contigs", "INT-13", lambda v: I.split_regions(v("agp_old").select("chrom", (F.col("start") - 1).alias("start"), "stop", "orientation"), 3000).select("chrom", "start", "piece_start", "piece_stop"),
    """SELECT chrom, start - 1 AS start, start - 1 + a AS piece_start, start - 1 + least(b, stop - start + 1) AS piece_stop FROM (SELECT *, unnest(CASE WHEN orientation = '-' THEN [0, 1000, 4000, 7000] ELSE [0, 3000, 6000, 9000] END) AS a, unnest(CASE WHEN orientation = '-' THEN [1000, 4000, 7000, 10000] ELSE [3000, 6000, 9000, 12000] END) AS b FROM {agp_old}) x""")
add("points_in_one_gene", "INT-14 SNK-10", lambda v: I.lone_hits(v("variants").select("chrom", "pos"), v("genes")).select("chrom", "pos", "b_gene"),
    "SELECT chrom, pos, b_gene FROM (SELECT v.chrom, v.pos, g.gene AS b_gene, count(*) OVER (PARTITION BY v.chrom, v.pos) AS n FROM {variants} v JOIN {genes} g ON v.chrom = g.chrom AND v.pos BETWEEN g.start AND g.stop) x WHERE n = 1")
add("best_target", "INT-15 SRT-06", lambda v: C.strongest(v("blast6").where("qseqid <> sseqid").groupBy("qseqid", "sseqid").agg(F.max("bitscore").alias("score")), "qseqid", [F.desc("score"), F.col("sseqid")]),
    "SELECT qseqid, sseqid, score FROM (SELECT qseqid, sseqid, max(bitscore) AS score, row_number() OVER (PARTITION BY qseqid ORDER BY max(bitscore) DESC, sseqid) AS r FROM {blast6} WHERE qseqid <> sseqid GROUP BY 1, 2) x WHERE r = 1")

# --- domains and compartments ------------------------------------------------------------------------------------------
add("genes_by_chrom", "AGG-01 SRC-01", lambda v: v("genes").groupBy("chrom").agg(F.count(F.lit(1)).alias("n")), "SELECT chrom, count(*) AS n FROM {genes} GROUP BY chrom")
add("ab_lengths", "AGG-02 SRC-04", lambda v: rounded(AB.lengths(v("bg1")), "a_rate"),
    "SELECT chrom, a, b, round(CASE WHEN a + b > 0 THEN cast(a AS double)/(a + b) END, 6) AS a_rate FROM (SELECT chrom, cast(sum(CASE WHEN score >= 0 THEN stop-start ELSE 0 END) AS bigint) AS a, cast(sum(CASE WHEN score < 0 THEN stop-start ELSE 0 END) AS bigint) AS b FROM {bg1} GROUP BY chrom) x")
add("ab_percent", "AGG-03", lambda v: rounded(AB.length_of_chromosome(v("bg1")), "a_percent", "b_percent"),
    "SELECT chrom, round(cast(sum(CASE WHEN score > 0 THEN stop-start ELSE 0 END) AS double)*100/max(stop), 6) AS a_percent, round(cast(sum(CASE WHEN score < 0 THEN stop-start ELSE 0 END) AS double)*100/max(stop), 6) AS b_percent FROM {bg1} GROUP BY chrom")
add("ab_length_rollup", "AGG-04", lambda v: AB.lengths_with_total(v("bg1")), "SELECT chrom, cast(sum(CASE WHEN score > 0 THEN stop-start ELSE 0 END) AS bigint) AS a, cast(sum(CASE WHEN score < 0 THEN stop-start ELSE 0 END) AS bigint) AS b FROM {bg1} WHERE score <> 0 GROUP BY ROLLUP (chrom)")
SW = "CASE WHEN a.score > 0 THEN 'A' ELSE 'B' END || CASE WHEN b.score > 0 THEN 'A' ELSE 'B' END"
PAIR = "{bg1} a JOIN {bg2} b ON a.chrom = b.chrom AND a.start = b.start"
add("switch_types", "AGG-05 SCL-04 JN-08", lambda v: AB.switches(AB.paired(v("bg1"), v("bg2"))), f"SELECT {SW} AS type, count(*) AS bins, cast(sum(a.stop-a.start) AS bigint) AS bases FROM {PAIR} GROUP BY 1")
add("conserved_bins", "SCL-04", lambda v: AB.conserved(AB.paired(v("bg1"), v("bg2"))), f"SELECT a.score*b.score >= 0 AS conserved, count(*) AS bins FROM {PAIR} GROUP BY 1")
add("switch_links", "ASM-09", lambda v: AB.switch_links(AB.paired(v("bg1"), v("bg2")), ["AB", "BA"], 1000), f"SELECT a.chrom, a.start + 1000 AS start1, a.stop - 1000 AS stop1, a.start + 1000 AS start2, a.stop + 1000 AS stop2, {SW} AS type FROM {PAIR} WHERE {SW} IN ('AB', 'BA')")
add("genome_size", "AGG-06", lambda v: AB.genome_size(v("bg1")), "SELECT cast(sum(m) AS bigint) AS size FROM (SELECT chrom, max(stop) AS m FROM {bg1} GROUP BY chrom) x")
add("sample_correlation", "STA-03", lambda v: AB.correlation(AB.paired(v("bg1"), v("bg2")), ["chrom"]), f"SELECT a.chrom, count(*) AS bins, CASE WHEN count(*) >= 3 THEN round(corr(a.score, b.score), 6) END AS r FROM {PAIR} GROUP BY a.chrom")
add("correlation_by_switch", "STA-03", lambda v: AB.correlation(AB.paired(v("bg1"), v("bg2")), [S.switch_type(F.col("v1"), F.col("v2")).alias("type")]), f"SELECT {SW} AS type, count(*) AS bins, CASE WHEN count(*) >= 3 THEN round(corr(a.score, b.score), 6) END AS r FROM {PAIR} GROUP BY 1")
add("bins_in_range", "FLT-07", lambda v: v("bg1").where("chrom = 'Chr1' and stop between 100000 and 400000").select("chrom", "start", "stop"), "SELECT chrom, start, stop FROM {bg1} WHERE chrom = 'Chr1' AND stop BETWEEN 100000 AND 400000")
add("domain_stats", "AGG-07 SRC-14", lambda v: rounded(v("domains").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bases")).crossJoin(F.broadcast(v("chrom_sizes").agg(F.sum("size").alias("genome")))).select("n", "bases", (F.col("bases").cast("double") * 100 / F.col("genome")).alias("percent")), "percent"),
    "SELECT count(*) AS n, cast(sum(stop-start) AS bigint) AS bases, round(cast(sum(stop-start) AS double)*100/(SELECT cast(sum(size) AS double) FROM {chrom_sizes}), 6) AS percent FROM {domains}")
add("domain_sizes_by_level", "AGG-08 STA-12", lambda v: v("domains").groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bases"), F.array_join(F.transform(F.sort_array(F.collect_list(F.col("stop") - F.col("start"))), lambda x: x.cast("string")), ",").alias("sizes")),
    "SELECT level, count(*) AS n, cast(sum(stop-start) AS bigint) AS bases, string_agg(cast(stop-start AS varchar), ',' ORDER BY stop-start) AS sizes FROM {domains} GROUP BY level")
add("largest_domains", "SRT-04", lambda v: v("domains").withColumn("size", F.col("stop") - F.col("start")).orderBy(F.desc("size"), "chrom", "start").limit(20), "SELECT chrom, start, stop, level, stop-start AS size FROM {domains} ORDER BY stop-start DESC, chrom, start LIMIT 20")
add("strongest_bins", "SRT-05", lambda v: v("bg1").where("score > 0").orderBy(F.desc("score"), "chrom", "start").limit(10).select("chrom", "start", nearest("score", 6).alias("score")), "SELECT chrom, start, round(score, 6) AS score FROM {bg1} WHERE score > 0 ORDER BY {bg1}.score DESC, chrom, start LIMIT 10")
add("boundary_profile", "STA-11", lambda v: rounded(I.overlap_join(I.flanked(I.boundaries(v("domains")), v("chrom_sizes"), 30000), v("bg1")).withColumn("at", F.floor((F.col("b_start") - F.col("start")) / 10000).cast("long")).groupBy("at").agg(F.avg("b_score").alias("mean"), F.count(F.lit(1)).alias("n")), "mean"),
    "SELECT cast(floor((b.start - w.start)/10000) AS bigint) AS \"at\", round(avg(b.score), 6) AS mean, count(*) AS n FROM (SELECT x.chrom, greatest(pos - 30000, 0) AS start, least(pos + 30000, size) AS stop FROM (SELECT DISTINCT chrom, pos FROM (SELECT chrom, start AS pos FROM {domains} UNION ALL SELECT chrom, stop FROM {domains}) y) x JOIN {chrom_sizes} c ON c.chrom = x.chrom) w JOIN {bg1} b ON b.chrom = w.chrom AND b.start < w.stop AND b.stop > w.start GROUP BY 1")
add("conserved_domains", "ASM-10", lambda v: AB.domain_pairs(v("domains"), v("genes"), v("anchors"), 0.7),
    "WITH d AS (SELECT g.gene, d.chrom || ':' || d.start || ':' || d.stop AS s FROM {genes} g JOIN {domains} d ON d.chrom = g.chrom AND d.start < g.stop AND d.stop > g.start WHERE least(d.stop, g.stop) - greatest(d.start, g.start) >= cast(0.7 AS double)*(g.stop-g.start)) SELECT x.s AS s1, y.s AS s2, count(*) AS pairs, string_agg(a.gene1, ',' ORDER BY a.gene1) AS genes FROM {anchors} a JOIN d x ON x.gene = a.gene1 JOIN d y ON y.gene = a.gene2 GROUP BY 1, 2")

# --- statistics --------------------------------------------------------------------------------------------------------
RS = """WITH r AS (SELECT chrom, score, start % 20000 = 0 AS even, rank() OVER (PARTITION BY chrom ORDER BY score) + cast(count(*) OVER (PARTITION BY chrom, score) - 1 AS double)/2 AS rk FROM {bg1}),
    n AS (SELECT chrom, cast(count(*) FILTER (WHERE even) AS double) AS n1, cast(count(*) FILTER (WHERE NOT even) AS double) AS n2, sum(CASE WHEN even THEN rk ELSE 0.0 END) AS w FROM r GROUP BY chrom) """
add("ranksum_ab", "STA-04", lambda v: rounded(T.rank_sum(v("bg1").withColumn("g", F.when(F.col("start") % 20000 == 0, "e").otherwise("o")), "chrom", "g", "score", "e", "o"), "z"),
    RS + "SELECT chrom, round(CASE WHEN n1 > 0 AND n2 > 0 THEN (w - n1*(n1+n2+1)/2)/sqrt(n1*n2*(n1+n2+1)/12) END, 6) AS z FROM n")
add("ranksum_p", "STA-04", lambda v: T.rank_sum(v("bg1").withColumn("g", F.when(F.col("start") % 20000 == 0, "e").otherwise("o")), "chrom", "g", "score", "e", "o").select("chrom", nearest(T.normal_p(F.col("z")), 5).alias("p"), T.stars(T.normal_p(F.col("z"))).alias("stars")),
    RS + """, z AS (SELECT chrom, greatest(abs((w - n1*(n1+n2+1)/2)/sqrt(n1*n2*(n1+n2+1)/12))/sqrt(2.0), 1e-12) AS x FROM n),
    p AS (SELECT chrom, 1 - 2/sqrt(pi())*sum(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END*exp((2*k + 1)*ln(x) - lgamma(k + 1))/(2*k + 1)) AS p FROM z, unnest(range(0, 60)) t(k) GROUP BY chrom)
    SELECT chrom, round(p, 5) AS p, CASE WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM p""")
TT = """WITH m AS (SELECT *, (a1+a2+a3)/3 AS ma, (b1+b2+b3)/3 AS mb FROM {expression}), s AS (SELECT *, sqrt(((a1-ma)*(a1-ma)+(a2-ma)*(a2-ma)+(a3-ma)*(a3-ma)+(b1-mb)*(b1-mb)+(b2-mb)*(b2-mb)+(b3-mb)*(b3-mb))/4*2.0/3) AS s FROM m),
    t AS (SELECT gene_a, gene_b, log2((ma+1)/(mb+1)) AS log2fc, CASE WHEN s > 0 THEN greatest(cast(0 AS double), 2*(0.5 - 0.375*(abs(ma-mb)/s/sqrt(1+(abs(ma-mb)/s)*(abs(ma-mb)/s)/4))*(1 - (abs(ma-mb)/s/sqrt(1+(abs(ma-mb)/s)*(abs(ma-mb)/s)/4))*(abs(ma-mb)/s/sqrt(1+(abs(ma-mb)/s)*(abs(ma-mb)/s)/4))/12))) ELSE cast(0 AS double) END AS p FROM s) """
A3, B3 = ["a1", "a2", "a3"], ["b1", "b2", "b3"]
add("allelic_log2fc_ttest", "STA-05 SRC-25", lambda v: rounded(T.t_test(v("expression"), A3, B3), "log2fc", "p").select("gene_a", "gene_b", "log2fc", "p"), TT + "SELECT gene_a, gene_b, round(log2fc, 6) AS log2fc, round(p, 6) AS p FROM t")
BH = TT + """, q AS (SELECT *, round(p, 9) AS pr FROM t), c AS (SELECT pr, count(*) AS n FROM q GROUP BY pr), k AS (SELECT pr, sum(n) OVER (ORDER BY pr) AS r, (SELECT count(*) FROM q) AS m FROM c),
    f AS (SELECT pr, least(cast(1 AS double), min(pr*m/r) OVER (ORDER BY pr DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS fdr FROM k) """
FDR = lambda v: T.false_discovery(T.t_test(v("expression"), A3, B3).withColumn("p", nearest("p", 9)), "p", "gene_a")
add("allelic_fdr", "STA-06", lambda v: FDR(v).select("gene_a", nearest("fdr", 6).alias("fdr")), BH + "SELECT q.gene_a, round(f.fdr, 6) AS fdr FROM q JOIN f ON q.pr = f.pr")
add("expression_types", "STA-07", lambda v: T.expression_type(FDR(v)).groupBy("type").agg(F.count(F.lit(1)).alias("n")), BH + "SELECT CASE WHEN log2fc > 0 THEN 'A>B' ELSE 'A<B' END AS type, count(*) AS n FROM q JOIN f ON q.pr = f.pr WHERE q.pr < cast(0.05 AS double) AND fdr < cast(0.05 AS double) AND abs(log2fc) >= 1 GROUP BY 1")
add("expression_consistency", "STA-07", lambda v: T.consistency(v("expression").select("gene_a", F.explode(F.array(*[F.struct(F.lit(k).alias("sample"), F.when(F.col(f"a{k}") >= 2 * F.col(f"b{k}"), "A>B").when(F.col(f"b{k}") >= 2 * F.col(f"a{k}"), "A<B").alias("type")) for k in (1, 2, 3)])).alias("s")).select("gene_a", "s.*").where("type is not null"), "gene_a", 3),
    "WITH s AS (" + " UNION ALL ".join(f"SELECT gene_a, {k} AS sample, CASE WHEN a{k} >= 2*b{k} THEN 'A>B' WHEN b{k} >= 2*a{k} THEN 'A<B' END AS type FROM {{expression}}" for k in (1, 2, 3)) + ") SELECT gene_a, CASE WHEN count(DISTINCT type) > 1 THEN 'Inconsistent' ELSE 'Consistent' END AS result FROM s WHERE type IS NOT NULL GROUP BY gene_a HAVING count(DISTINCT type) > 1 OR count(DISTINCT sample) = 3")
add("box_by_chrom", "STA-09", lambda v: rounded(T.box(v("bg1"), ["chrom"], "score"), "q1", "median", "q3", "low", "high"),
    "WITH q AS (SELECT chrom, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3, count(score) AS n FROM {bg1} GROUP BY chrom) SELECT q.chrom, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, n, round(min(CASE WHEN score >= q1 - 1.5*(q3-q1) THEN score END), 6) AS low, round(max(CASE WHEN score <= q3 + 1.5*(q3-q1) THEN score END), 6) AS high FROM q JOIN {bg1} b ON b.chrom = q.chrom GROUP BY q.chrom, q1, median, q3, n")
add("regression_by_chrom", "STA-02", lambda v: rounded(T.regression(AB.paired(v("bg1"), v("bg2")), ["chrom"], "v1", "v2").drop("p"), "slope", "intercept", "r", "error"),
    f"SELECT a.chrom, count(*) AS n, round(regr_slope(b.score, a.score), 6) AS slope, round(regr_intercept(b.score, a.score), 6) AS intercept, round(corr(b.score, a.score), 6) AS r, round(sqrt(greatest(0.0, (1 - corr(b.score, a.score)*corr(b.score, a.score))*var_samp(b.score)/var_samp(a.score)/(count(*) - 2))), 6) AS error FROM {PAIR} GROUP BY a.chrom HAVING count(*) >= 3 AND var_samp(a.score) > 0")
add("genes_in_compartments", "STA-10", lambda v: I.overlap_join(v("genes"), v("bg1"), fraction_a=0.51).groupBy(S.compartment(F.col("b_score")).alias("type")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN b.score >= 0 THEN 'A' ELSE 'B' END AS type, count(*) AS n FROM {genes} g JOIN {bg1} b ON b.chrom = g.chrom AND b.start < g.stop AND b.stop > g.start WHERE least(b.stop, g.stop) - greatest(b.start, g.start) >= cast(0.51 AS double)*(g.stop-g.start) GROUP BY 1")
add("permuted_compartments", "SMP-03 STA-10", lambda v: T.permutation(v("bg1").select("chrom", "start", S.compartment(F.col("score")).alias("type")), "type", 50, 1000))
add("log_scaled_expression", "SCL-10 STA-14", lambda v: v("expression").where("a1 >= 2 and b1 >= 2").select("gene_a", nearest(F.log2("a1"), 6).alias("x"), nearest(F.log2("b1"), 6).alias("y")), "SELECT gene_a, round(log2(a1), 6) AS x, round(log2(b1), 6) AS y FROM {expression} WHERE a1 >= 2 AND b1 >= 2")
add("counts_per_million", "STA-13", lambda v: (lambda e: e.crossJoin(F.broadcast(e.agg(F.sum("a1").alias("t")))).select("gene_a", nearest(F.col("a1") * 1e6 / F.col("t"), 4).alias("cpm")).where("cpm >= 1"))(v("expression")), "SELECT gene_a, round(a1*cast(1000000 AS double)/(SELECT sum(a1) FROM {expression}), 4) AS cpm FROM {expression} WHERE round(a1*cast(1000000 AS double)/(SELECT sum(a1) FROM {expression}), 4) >= 1")
add("top_terms", "SRT-07", lambda v: T.t_test(v("expression"), A3, B3).where("p > 0").select("gene_a", nearest(-F.log10("p"), 4).alias("score")).orderBy(F.desc("score"), "gene_a").limit(20), TT + "SELECT gene_a, round(-log10(p), 4) AS score FROM t WHERE p > 0 ORDER BY round(-log10(p), 4) DESC, gene_a LIMIT 20")

# --- genes, synteny, alleles -------------------------------------------------------------------------------------------
add("genes_by_chrom_list", "ALL-01", lambda v: v("genes").groupBy("chrom").agg(F.array_join(F.sort_array(F.collect_list("gene")), ",").alias("genes")), "SELECT chrom, string_agg(gene, ',' ORDER BY gene) AS genes FROM {genes} GROUP BY chrom")
add("gene_bed", "SNK-11 SRC-05 SRC-06", lambda v: G.gene_bed(v("gff")), "SELECT chrom, start, stop, regexp_extract(attributes, 'ID=([^;]*)', 1) AS name, strand FROM {gff} WHERE type = 'gene'")
add("transcripts", "SNK-11", lambda v: G.transcripts(v("gff")),
    "WITH c AS (SELECT regexp_extract(attributes, 'Parent=([^;]*)', 1) AS name, string_agg(cast(start AS varchar), ',' ORDER BY start, stop) AS starts, string_agg(cast(stop AS varchar), ',' ORDER BY start, stop) AS stops, cast(sum(stop-start+1) AS bigint) AS cds_length FROM {gff} WHERE type = 'CDS' GROUP BY 1) SELECT m.chrom, m.start, m.stop, c.name, m.strand, starts, stops, cds_length FROM {gff} m JOIN c ON c.name = regexp_extract(m.attributes, 'ID=([^;]*)', 1) WHERE m.type = 'mRNA'")
add("gff_children", "SRC-07 FLT-09", lambda v: G.children(v("gff")).groupBy("depth").agg(F.count(F.lit(1)).alias("n")),
    "WITH RECURSIVE e AS (SELECT DISTINCT regexp_extract(attributes, 'Parent=([^;]*)', 1) AS p, regexp_extract(attributes, 'ID=([^;]*)', 1) AS c FROM {gff} WHERE attributes LIKE '%Parent=%'), w AS (SELECT p, c, 1 AS depth FROM e UNION ALL SELECT w.p, e.c, w.depth + 1 FROM w JOIN e ON w.c = e.p WHERE w.depth < 3) SELECT depth, count(*) AS n FROM w GROUP BY depth")
add("cds_offsets", "FLT-15 WIN-03", lambda v: G.cds_offsets(v("gff")), "SELECT parent, start, stop, cast(coalesce(sum(stop-start+1) OVER (PARTITION BY parent ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS \"offset\" FROM (SELECT regexp_extract(attributes, 'Parent=([^;]*)', 1) AS parent, start, stop FROM {gff} WHERE type = 'CDS') x")
add("renamed_genes", "FLT-10 FLT-08", lambda v: G.renamed(v("genes"), "AT"), "SELECT gene, 'AT' || substring(chrom, 4, 5) || lpad(cast(row_number() OVER (PARTITION BY chrom ORDER BY start, gene) AS varchar), 5, '0') AS new_name FROM {genes}")
add("renamed_chromosomes", "FLT-08 SRC-23", lambda v: v("genes").join(F.broadcast(v("chrom_sizes").where("chrom <> 'Chr3'").select("chrom", F.concat(F.lit("new"), "chrom").alias("to"))), "chrom", "left").select("gene", F.coalesce("to", "chrom").alias("chrom")), "SELECT g.gene, coalesce(CASE WHEN c.chrom IS NOT NULL THEN 'new' || c.chrom END, g.chrom) AS chrom FROM {genes} g LEFT JOIN (SELECT chrom FROM {chrom_sizes} WHERE chrom <> 'Chr3') c ON c.chrom = g.chrom")
add("promoters", "ASM-07", lambda v: G.promoters(v("genes"), v("chrom_sizes")), "SELECT g.chrom, CASE WHEN strand = '+' THEN greatest(start - 2001, 0) ELSE least(stop + 1, size) END AS start, CASE WHEN strand = '+' THEN greatest(start - 1, 0) ELSE least(stop + 2001, size) END AS stop, gene, strand FROM {genes} g JOIN {chrom_sizes} c ON c.chrom = g.chrom")
add("start_site_density", "ASM-07 INT-05", lambda v: G.start_sites(v("genes")).groupBy("chrom", (F.floor(F.col("pos") / 50000) * 50000).cast("long").alias("start")).agg(F.count(F.lit(1)).alias("n")), "SELECT chrom, cast(floor(start/50000)*50000 AS bigint) AS start, count(*) AS n FROM {genes} GROUP BY 1, 2")
add("anchor_links", "JN-01 SRC-17", lambda v: G.anchor_links(v("anchors"), v("genes"), v("genes")).select("gene1", "gene2", "chrom1", "start1", "chrom2", "start2"), "SELECT gene1, gene2, a.chrom AS chrom1, a.start AS start1, b.chrom AS chrom2, b.start AS start2 FROM {anchors} JOIN {genes} a ON a.gene = gene1 JOIN {genes} b ON b.gene = gene2")
add("synteny_blocks", "AGG-17", lambda v: G.blocks(G.anchor_links(v("anchors"), v("genes"), v("genes"))).select("block", "chrom1", "chrom2", "start1", "stop1", "start2", "stop2", "pairs"),
    """WITH l AS (SELECT block, line_no, a.chrom AS chrom1, a.start AS start1, a.stop AS stop1, b.chrom AS chrom2, b.start AS start2, b.stop AS stop2 FROM {anchors} JOIN {genes} a ON a.gene = gene1 JOIN {genes} b ON b.gene = gene2), f AS (SELECT block, first(chrom1 ORDER BY line_no) AS c1, first(chrom2 ORDER BY line_no) AS c2 FROM l GROUP BY block)
    SELECT l.block, chrom1, chrom2, min(start1) AS start1, max(stop1) AS stop1, min(start2) AS start2, max(stop2) AS stop2, count(*) AS pairs FROM l JOIN f ON l.block = f.block AND chrom1 = c1 AND chrom2 = c2 GROUP BY 1, 2, 3""")
add("numbered_blocks", "SRC-15 SRC-16 WIN-01", lambda v: G.numbered_blocks(v("anchors").select("line_no", F.when(F.col("line_no") % 10 == 0, "###").otherwise(F.col("gene1")).alias("value"))).select("line_no", "value", big("block")),
    "SELECT line_no, value, block FROM (SELECT line_no, value, cast(sum(CASE WHEN value LIKE '#%' THEN 1 ELSE 0 END) OVER (ORDER BY line_no) AS bigint) AS block FROM (SELECT line_no, CASE WHEN line_no % 10 = 0 THEN '###' ELSE gene1 END AS value FROM {anchors}) x) y WHERE value NOT LIKE '#%'")
add("blast_hits", "SRC-09 JN-02", lambda v: v("blast6").where("qseqid <> sseqid").select("qseqid", "sseqid").distinct().join(v("genes").select(F.col("gene").alias("sseqid"), "chrom"), "sseqid", "left").select("qseqid", "sseqid", "chrom"), "SELECT DISTINCT b.qseqid, b.sseqid, g.chrom FROM {blast6} b LEFT JOIN {genes} g ON g.gene = b.sseqid WHERE b.qseqid <> b.sseqid")
add("unmapped_genes", "JN-05 ALL-14 SET-02", lambda v: v("genes").select("gene").join(v("alleles").where("slot <> 'D'").select("gene"), "gene", "left_anti"), "SELECT gene FROM {genes} WHERE gene NOT IN (SELECT gene FROM {alleles} WHERE slot <> 'D')")
add("right_only", "JN-04", lambda v: v("anchors").select(F.col("gene2").alias("gene")).distinct().join(v("tandem").select(F.col("gene1").alias("gene")), "gene", "left_anti"), "SELECT DISTINCT gene2 AS gene FROM {anchors} WHERE gene2 NOT IN (SELECT gene1 FROM {tandem})")
add("merged_anchor_tables", "JN-03 ALL-04", lambda v: v("anchors").where("line_no % 2 = 0").select("gene1", F.col("gene2").alias("geneb")).join(v("anchors").where("line_no % 3 = 0").select("gene1", F.col("gene2").alias("genec")), "gene1", "full_outer"), "SELECT coalesce(a.gene1, b.gene1) AS gene1, a.gene2 AS geneb, b.gene2 AS genec FROM (SELECT * FROM {anchors} WHERE line_no % 2 = 0) a FULL JOIN (SELECT * FROM {anchors} WHERE line_no % 3 = 0) b ON a.gene1 = b.gene1")
add("alleles_with_any", "JN-06", lambda v: v("alleles").join(v("alleles").join(v("tandem").select(F.col("gene1").alias("gene")), "gene", "left_semi").select("allele_id").distinct(), "allele_id", "left_semi"), "SELECT allele_id, slot, gene FROM {alleles} WHERE allele_id IN (SELECT allele_id FROM {alleles} WHERE gene IN (SELECT gene1 FROM {tandem}))")
add("reciprocal_best", "JN-07", lambda v: G.reciprocal_best(v("blast6")),
    "WITH b AS (SELECT qseqid, sseqid, row_number() OVER (PARTITION BY qseqid ORDER BY max(bitscore) DESC, max(identity) DESC, sseqid) AS r FROM {blast6} WHERE qseqid <> sseqid GROUP BY 1, 2) SELECT x.qseqid AS x, x.sseqid AS y FROM b x JOIN b y ON x.qseqid = y.sseqid AND x.sseqid = y.qseqid WHERE x.r = 1 AND y.r = 1 AND x.qseqid < x.sseqid")
add("cluster_table", "JN-09 SRC-29", lambda v: v("contigs").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("id")), " ").alias("contigs")), "SELECT grp, count(*) AS n, string_agg(id, ' ' ORDER BY id) AS contigs FROM {contigs} GROUP BY grp")
add("pruned_pairs", "JN-10 SRC-26 SRC-27", lambda v: v("alignments").where("ref1 <> ref2").select(F.least("ref1", "ref2").alias("x"), F.greatest("ref1", "ref2").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).join(C.allelic_pairs(v("allele_contigs")), ["x", "y"], "left_anti"),
    "WITH d AS (SELECT DISTINCT a.contig AS x, b.contig AS y FROM {allele_contigs} a JOIN {allele_contigs} b ON a.gene = b.gene WHERE a.contig < b.contig) SELECT p.x, p.y, p.n FROM (SELECT least(ref1, ref2) AS x, greatest(ref1, ref2) AS y, count(*) AS n FROM {alignments} WHERE ref1 <> ref2 GROUP BY 1, 2) p LEFT JOIN d ON d.x = p.x AND d.y = p.y WHERE d.x IS NULL")
add("sample_pairs", "JN-11", lambda v: v("chrom_sizes").select(F.col("chrom").alias("x")).join(F.broadcast(v("chrom_sizes").select(F.col("chrom").alias("y"))), F.col("x") < F.col("y")), "SELECT a.chrom AS x, b.chrom AS y FROM {chrom_sizes} a JOIN {chrom_sizes} b ON a.chrom < b.chrom")
add("final_table_stats", "AGG-11 SRC-21", lambda v: G.slot_counts(G.slots(v("alleles"), list("ABCD")), list("ABCD")),
    "WITH r AS (SELECT DISTINCT allele_id, slot, gene FROM {alleles}), k AS (SELECT *, row_number() OVER (PARTITION BY allele_id, slot ORDER BY gene) AS k FROM r), w AS (SELECT allele_id, count(*) FILTER (WHERE k = 1) AS filled, count(*) FILTER (WHERE k > 1) AS d FROM k GROUP BY allele_id) SELECT cast(filled AS integer) AS filled, count(*) AS alleles, cast(sum(d) AS bigint) AS dup_genes FROM w GROUP BY 1")
add("repeated_genes", "AGG-12", lambda v: v("anchors").select(F.explode(F.array("gene1", "gene2")).alias("gene")).groupBy("gene").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "SELECT gene, count(*) AS n FROM (SELECT gene1 AS gene FROM {anchors} UNION ALL SELECT gene2 FROM {anchors}) x GROUP BY gene HAVING count(*) > 1")
add("copy_number", "AGG-15", lambda v: v("expression").select("gene_a", nearest(F.col("a1") * 150 / (F.col("b1") + 1) / 3, 6).alias("copies")), "SELECT gene_a, round(a1*150/(b1 + 1)/3, 6) AS copies FROM {expression}")
add("keep_first", "WIN-04 SET-05", lambda v: C.strongest(v("anchors"), "gene2", [F.col("line_no")]).select("gene2", "gene1", "line_no"), "SELECT gene2, gene1, line_no FROM (SELECT *, row_number() OVER (PARTITION BY gene2 ORDER BY line_no) AS r FROM {anchors}) x WHERE r = 1")
add("allele_slots_from_gmap", "ALL-06 ALL-07 SCL-05", lambda v: G.slots(v("alleles"), list("ABCD")),
    "WITH k AS (SELECT *, row_number() OVER (PARTITION BY allele_id, slot ORDER BY gene) AS k FROM (SELECT DISTINCT allele_id, slot, gene FROM {alleles}) x) SELECT allele_id, " + ", ".join(f"min(CASE WHEN slot = '{s}' AND k = 1 THEN gene END) AS gene{s}" for s in "ABCD") + ", coalesce(string_agg(CASE WHEN k > 1 THEN gene END, ',' ORDER BY gene), '') AS dup_gene FROM k GROUP BY allele_id")
add("supported_allele_slots", "ALL-06", lambda v: G.supported_slots(v("alleles"), v("blast6"), list("ABCD")).select("allele_id", "geneA", "dup_gene"),
    """WITH h AS (SELECT qseqid AS x, sseqid AS y FROM {blast6} WHERE qseqid <> sseqid UNION SELECT sseqid, qseqid FROM {blast6} WHERE qseqid <> sseqid), keep AS (SELECT DISTINCT a.allele_id, a.gene FROM {alleles} a JOIN {alleles} b ON a.allele_id = b.allele_id JOIN h ON h.x = a.gene AND h.y = b.gene UNION SELECT allele_id, min(gene) FROM {alleles} GROUP BY allele_id HAVING count(DISTINCT gene) = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY allele_id, slot ORDER BY gene) AS k FROM (SELECT DISTINCT a.allele_id, a.slot, a.gene FROM {alleles} a JOIN keep ON keep.allele_id = a.allele_id AND keep.gene = a.gene) x) SELECT allele_id, min(CASE WHEN slot = 'A' AND k = 1 THEN gene END) AS geneA, coalesce(string_agg(CASE WHEN k > 1 THEN gene END, ',' ORDER BY gene), '') AS dup_gene FROM k GROUP BY allele_id""")
add("allele_long_form", "ALL-01 ALL-14", lambda v: G.long_form(G.slots(v("alleles"), list("ABCD")), list("ABCD")), "SELECT allele_id, CASE WHEN k = 1 THEN slot ELSE 'dup' END AS slot, gene FROM (SELECT *, row_number() OVER (PARTITION BY allele_id, slot ORDER BY gene) AS k FROM (SELECT DISTINCT allele_id, slot, gene FROM {alleles}) x) y")
add("allele_main_chromosome", "ALL-10", lambda v: G.main_chromosome(v("genes"), v("alleles")), "SELECT allele_id, chrom, n FROM (SELECT a.allele_id, g.chrom, count(*) AS n, row_number() OVER (PARTITION BY a.allele_id ORDER BY count(*) DESC, g.chrom) AS r FROM {alleles} a JOIN {genes} g ON g.gene = a.gene GROUP BY 1, 2) x WHERE r = 1")
add("paralogs_and_tandems", "ALL-10 SRC-22", lambda v: G.split_dups(v("alleles"), v("tandem")),
    "WITH k AS (SELECT *, row_number() OVER (PARTITION BY allele_id, slot ORDER BY gene) AS k FROM {alleles}) SELECT d.allele_id, d.gene, CASE WHEN EXISTS (SELECT 1 FROM k m JOIN {tandem} t ON (t.gene1 = d.gene AND t.gene2 = m.gene) OR (t.gene2 = d.gene AND t.gene1 = m.gene) WHERE m.allele_id = d.allele_id AND m.k = 1) THEN 'tandem' ELSE 'paralog' END AS kind FROM k d WHERE d.k > 1")
add("remaining_tandems", "ALL-11", lambda v: v("tandem").join(v("alleles").where("slot = 'A'").select(F.col("gene").alias("gene1")), "gene1", "left_anti"), "SELECT gene1, gene2 FROM {tandem} WHERE gene1 NOT IN (SELECT gene FROM {alleles} WHERE slot = 'A')")
add("unique_blast_placement", "ALL-12", lambda v: I.only_hit(v("blast6").where("qseqid <> sseqid and identity >= 90").select("qseqid", "sseqid").distinct().join(v("alleles").select(F.col("gene").alias("sseqid"), "allele_id"), "sseqid").select("qseqid", "allele_id").distinct(), ["qseqid"]), "SELECT qseqid, min(allele_id) AS allele_id FROM (SELECT DISTINCT b.qseqid, a.allele_id FROM {blast6} b JOIN {alleles} a ON a.gene = b.sseqid WHERE b.qseqid <> b.sseqid AND b.identity >= 90) x GROUP BY qseqid HAVING count(*) = 1")
add("merged_allele_tables", "ALL-13 SET-01", lambda v: v("alleles").where("slot = 'A'").unionByName(v("alleles").where("slot = 'B'")), "SELECT allele_id, slot, gene FROM {alleles} WHERE slot IN ('A', 'B')")
add("haplotype_pairs", "ALL-02 ALL-03", lambda v: G.anchor_links(v("anchors"), v("genes"), v("genes")).groupBy(F.when(F.col("chrom1") == F.col("chrom2"), "intra").otherwise("inter").alias("kind")).agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN a.chrom = b.chrom THEN 'intra' ELSE 'inter' END AS kind, count(*) AS n FROM {anchors} JOIN {genes} a ON a.gene = gene1 JOIN {genes} b ON b.gene = gene2 GROUP BY 1")
add("shared_genes", "SET-03", lambda v: v("alleles").where("slot = 'A'").select("gene").join(v("tandem").select(F.col("gene1").alias("gene")), "gene", "left_semi").agg(F.countDistinct("gene").alias("n")), "SELECT count(DISTINCT gene) AS n FROM {alleles} WHERE slot = 'A' AND gene IN (SELECT gene1 FROM {tandem})")
add("filtered_variants", "FLT-04 SRC-08", lambda v: v("variants").withColumn("dp", S.attribute(F.col("info"), "DP").cast("int")).where("length(ref) = 1 and length(alt) = 1 and dp >= 20").select("chrom", "pos", "dp"), "SELECT chrom, pos, cast(regexp_extract(info, 'DP=([0-9]+)', 1) AS integer) AS dp FROM {variants} WHERE length(ref) = 1 AND length(alt) = 1 AND cast(regexp_extract(info, 'DP=([0-9]+)', 1) AS integer) >= 20")
add("gene_evidence", "FLT-12", lambda v: v("genes").select("gene").join(v("blast6").groupBy(F.col("qseqid").alias("gene")).agg(F.count(F.lit(1)).alias("hits")), "gene", "left").join(v("expression").select(F.col("gene_a").alias("gene"), "a1"), "gene", "left").where((F.coalesce("hits", F.lit(0)) > 25) | (F.coalesce("a1", F.lit(0.0)) > 50)).select("gene"), "SELECT g.gene FROM {genes} g LEFT JOIN (SELECT qseqid, count(*) AS hits FROM {blast6} GROUP BY 1) b ON b.qseqid = g.gene LEFT JOIN {expression} e ON e.gene_a = g.gene WHERE coalesce(hits, 0) > 25 OR coalesce(a1, 0) > 50")
add("ko_list", "SNK-14", lambda v: v("anchors").groupBy("block").agg(F.array_join(F.sort_array(F.collect_list("gene1")), ",").alias("l")).select("block", F.explode(F.split("l", ",")).alias("gene")), "SELECT block, gene1 AS gene FROM {anchors}")
add("bed_to_bedpe", "SNK-08", lambda v: v("genes").select(F.col("chrom").alias("chrom1"), F.col("start").alias("start1"), F.col("stop").alias("stop1"), F.col("chrom").alias("chrom2"), F.col("start").alias("start2"), F.col("stop").alias("stop2")), "SELECT chrom AS chrom1, start AS start1, stop AS stop1, chrom AS chrom2, start AS start2, stop AS stop2 FROM {genes}")
add("matrix_headers", "SNK-09 SCL-01", lambda v: v("bg1").select(F.concat_ws("|", F.lit("bin"), F.lit("genome"), S.range_id(F.col("chrom"), F.col("start"), F.col("stop"))).alias("header")), "SELECT 'bin|genome|' || chrom || ':' || start || '-' || stop AS header FROM {bg1}")
add("range_ids", "SCL-01", lambda v: v("genes").select("gene", S.parse_range_id(S.range_id(F.col("chrom"), F.col("start"), F.col("stop"))).alias("r")).select("gene", "r.chrom", "r.start", "r.stop"), "SELECT gene, chrom, start, stop FROM {genes}")
add("size_labels", "SCL-02 SCL-03", lambda v: v("domains").select("start", S.size_label(F.col("start") * 10).alias("label")), "SELECT start, CASE WHEN start*10 <= 1000 THEN (start*10) || ' bp' WHEN start*10 <= 400000 THEN cast(floor(start*10/1000) AS bigint) || ' Kbp' ELSE printf('%.1f', start*10/1000000.0) || ' Mbp' END AS label FROM {domains}")
add("bin_size_words", "SCL-09", lambda v: v("contigs").select("id", S.bin_size(F.concat(F.col("re_sites").cast("string"), F.lit("K"))).alias("size")), "SELECT id, re_sites*1000 AS size FROM {contigs}")
add("version_sorted", "SRT-02 SRT-03 SRT-01", lambda v: v("genes").withColumn("k", S.trailing_number(F.col("chrom"))).orderBy("k", "start", "gene").select("chrom", "start", "gene"), "SELECT chrom, start, gene FROM {genes} ORDER BY cast(substring(chrom, 4, 5) AS bigint), start, gene")
add("sampled_genes", "SMP-01", lambda v: v("genes").join(v("tandem").select(F.col("gene1").alias("gene")), "gene", "left_anti").withColumn("u", F.col("start") * 7919 % 10007).orderBy("u", "gene").limit(30).select("gene", "u"), "SELECT gene, start*7919 % 10007 AS u FROM {genes} WHERE gene NOT IN (SELECT gene1 FROM {tandem}) ORDER BY start*7919 % 10007, gene LIMIT 30")
add("downsampled_pairs", "SMP-02", lambda v: v("valid_pairs").where("read_id * 7919 % 10007 < 1000").select("read_id"), "SELECT read_id FROM {valid_pairs} WHERE read_id * 7919 % 10007 < 1000")
add("column_sum", "AGG-19", lambda v: v("genes").agg(F.sum(F.col("stop") - F.col("start")).alias("total")), "SELECT cast(sum(stop-start) AS bigint) AS total FROM {genes}")
add("cumulative_share", "WIN-06", lambda v: rounded(T.histogram(v("domains"), "start", 100000, ["chrom"]).withColumn("cumulative", F.sum("share").over(Window.partitionBy("chrom").orderBy("bin"))), "share", "cumulative"),
    "WITH h AS (SELECT chrom, bin, n, cast(n AS double)/cast(sum(n) OVER (PARTITION BY chrom) AS double) AS share FROM (SELECT chrom, cast(floor(start/100000)*100000 AS bigint) AS bin, count(*) AS n FROM {domains} GROUP BY 1, 2) x) SELECT chrom, bin, n, round(share, 6) AS share, round(sum(share) OVER (PARTITION BY chrom ORDER BY bin), 6) AS cumulative FROM h")
add("kmer_venn", "SET-04", lambda v: v("valid_pairs").select(F.col("site1").alias("k"), F.lit(1).alias("m")).union(v("valid_pairs").where("chr1 = 'Chr2'").select("site2", F.lit(2))).union(v("valid_pairs").where("frag_size > 900").select("site1", F.lit(4))).groupBy("k").agg(F.bit_or("m").alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n")),
    "SELECT mask, count(*) AS n FROM (SELECT k, bit_or(m) AS mask FROM (SELECT site1 AS k, 1 AS m FROM {valid_pairs} UNION ALL SELECT site2, 2 FROM {valid_pairs} WHERE chr1 = 'Chr2' UNION ALL SELECT site1, 4 FROM {valid_pairs} WHERE frag_size > 900) x GROUP BY k) y GROUP BY mask")

# --- assembly ----------------------------------------------------------------------------------------------------------
LIFT = """WITH o AS (SELECT p.read_id, p.chr1, CASE WHEN a.orientation = '+' THEN p.pos1 - a.start + a.tig_start ELSE a.tig_stop - (p.pos1 - a.start + 1) END AS t1, a.id AS i1, p.chr2, CASE WHEN b.orientation = '+' THEN p.pos2 - b.start + b.tig_start ELSE b.tig_stop - (p.pos2 - b.start + 1) END AS t2, b.id AS i2
    FROM {valid_pairs} p JOIN {agp_old} a ON a.chrom = p.chr1 AND p.pos1 BETWEEN a.start AND a.stop JOIN {agp_old} b ON b.chrom = p.chr2 AND p.pos2 BETWEEN b.start AND b.stop)
    SELECT o.read_id, o.chr1, CASE WHEN x.orientation = '+' THEN x.start + t1 - x.tig_start ELSE x.stop - t1 END AS pos1, o.chr2, CASE WHEN y.orientation = '+' THEN y.start + t2 - y.tig_start ELSE y.stop - t2 END AS pos2 FROM o JOIN {agp_new} x ON x.chrom = o.chr1 AND x.id = o.i1 JOIN {agp_new} y ON y.chrom = o.chr2 AND y.id = o.i2"""
add("liftover_pairs", "ASM-01 ASM-04", lambda v: ASM.lift_over(v("valid_pairs"), v("agp_old"), v("agp_new")), LIFT)
add("features_to_chrom", "ASM-02", lambda v: ASM.features_to_chrom(v("contigs").select("id", F.lit(11).cast("long").alias("start"), F.lit(50).cast("long").alias("stop"), F.lit("+").alias("strand")), v("agp_old")), "SELECT a.chrom, CASE WHEN orientation = '+' THEN start + 10 ELSE stop - 49 END AS start, CASE WHEN orientation = '+' THEN start + 49 ELSE stop - 10 END AS stop, CASE WHEN orientation = '+' THEN '+' ELSE '-' END AS strand, a.id FROM {agp_old} a JOIN {contigs} c ON c.id = a.id")
add("bed_to_chrom", "ASM-03 SCL-06 WIN-07", lambda v: ASM.bed_to_chrom(v("contigs").select("id", F.lit(10).cast("long").alias("start"), F.lit(50).cast("long").alias("stop")), v("agp_old")), "SELECT a.chrom, start + 9 AS start, start + 49 AS stop, a.id FROM {agp_old} a JOIN {contigs} c ON c.id = a.id")
add("tours", "ASM-06 SRC-28", lambda v: ASM.tours(v("agp_old")), "SELECT chrom, string_agg(id || orientation, ' ' ORDER BY number) AS tour FROM {agp_old} GROUP BY chrom")
add("agp_clusters", "SNK-04 SRC-13", lambda v: ASM.clusters(ASM.contigs(v("agp_old"))), "SELECT chrom, count(*) AS n, string_agg(id, ' ' ORDER BY number) AS contigs FROM {agp_old} WHERE type <> 'U' AND chrom <> id GROUP BY chrom")
add("agp_to_assembly", "SNK-03", lambda v: ASM.signed_order(v("agp_old")), "WITH i AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM {agp_old}) SELECT chrom, string_agg(cast(CASE WHEN orientation = '-' THEN -k ELSE k END AS varchar), ' ' ORDER BY number) AS line FROM {agp_old} a JOIN i ON i.id = a.id GROUP BY chrom")
add("tour_neighbours", "WIN-05 MAT-28", lambda v: ASM.neighbours(v("agp_old")), "SELECT chrom, id, lag(id) OVER (PARTITION BY chrom ORDER BY number) AS before, lead(id) OVER (PARTITION BY chrom ORDER BY number) AS after FROM {agp_old}")
add("partition_balance", "AGG-18", lambda v: rounded(ASM.balance(v("contigs"), "grp", "length"), "score"), "SELECT round(cast(max(l) - min(l) AS double)/cast(sum(l) AS double), 6) AS score FROM (SELECT grp, sum(length) AS l FROM {contigs} GROUP BY grp) x")
add("layout_changes", "ASM-05", lambda v: v("agp_old").select("id", F.col("chrom").alias("old_chrom"), F.col("number").alias("old_number")).join(v("agp_new").select("id", F.col("chrom").alias("new_chrom"), F.col("number").alias("new_number")), "id", "left"), "SELECT o.id, o.chrom AS old_chrom, o.number AS old_number, n.chrom AS new_chrom, n.number AS new_number FROM {agp_old} o LEFT JOIN {agp_new} n ON n.id = o.id")
add("strongest_link", "SRT-06 MAT-28", lambda v: C.strongest(C.counted_both_ways(v("alignments").where("ref1 <> ref2"), "ref1", "ref2").join(v("agp_new").select(F.col("id").alias("x")), "x", "left_anti").join(v("agp_new").select(F.col("id").alias("y")), "y", "left_semi"), "x", [F.desc("n"), F.col("y")]).select("x", "y", "n"),
    "SELECT x, y, n FROM (SELECT x, y, count(*) AS n, row_number() OVER (PARTITION BY x ORDER BY count(*) DESC, y) AS r FROM (SELECT ref1 AS x, ref2 AS y FROM {alignments} WHERE ref1 <> ref2 UNION ALL SELECT ref2, ref1 FROM {alignments} WHERE ref1 <> ref2) t WHERE x NOT IN (SELECT id FROM {agp_new}) AND y IN (SELECT id FROM {agp_new}) GROUP BY 1, 2) u WHERE r = 1")
GC = lambda x: f"CASE WHEN length(regexp_replace({x}, '[Nn]', '', 'g')) > 0 THEN round(cast(length(regexp_replace({x}, '[^GCgc]', '', 'g')) AS double)*100/length(regexp_replace({x}, '[Nn]', '', 'g')), 6) ELSE -1.0 END"
add("gc_content", "SCL-07 SRC-19", lambda v: v("sequences").select("chrom", nearest(S.gc_percent(F.col("seq")), 6).alias("gc")), "SELECT chrom, " + GC("seq") + " AS gc FROM {sequences}")
add("gc_windows", "ASM-08", lambda v: ASM.gc_windows(v("sequences"), 1000).select("chrom", "start", "stop", nearest("gc", 6).alias("gc")),
    "SELECT chrom, s AS start, least(s + 1000, length(seq)) AS stop, " + GC("substring(seq, s + 1, 1000)") + " AS gc FROM (SELECT chrom, seq, unnest(range(0, length(seq), 1000)) AS s FROM {sequences}) t")
add("split_fasta", "SNK-13 SNK-05", lambda v: v("contigs").withColumn("before", F.sum("length").over(Window.partitionBy("grp").orderBy("id"))).select("id", "grp", F.floor(F.col("before") / 100000).cast("long").alias("part")), "SELECT id, grp, cast(floor(sum(length) OVER (PARTITION BY grp ORDER BY id)/100000) AS bigint) AS part FROM {contigs}")
add("excluded_contigs", "FLT-06 FLT-11", lambda v: v("contigs").where(~F.col("id").rlike("ctg1|ctg2")).select("id"), "SELECT id FROM {contigs} WHERE NOT regexp_matches(id, 'ctg1|ctg2')")
add("repeat_numbers", "FLT-13 WIN-02", lambda v: G.renumbered_runs(v("anchors").select("line_no", F.floor((F.col("line_no") + 7) / 13).alias("id")), "id").select("line_no", "new_id"),
    "SELECT line_no, max(CASE WHEN id IS DISTINCT FROM before THEN line_no + 1 END) OVER (ORDER BY line_no) AS new_id FROM (SELECT line_no, floor((line_no + 7)/13) AS id, lag(floor((line_no + 7)/13)) OVER (ORDER BY line_no) AS before FROM {anchors}) x")
add("repeat_groups", "FLT-14 SRC-18", lambda v: v("contigs").select("id", G.repeat_group(F.when(F.col("grp") == "g1", "LTR/Copia").when(F.col("grp") == "g2", "LINE").when(F.col("grp") == "g3", "DNA/hAT").when(F.col("grp") == "g4", "RC/Helitron").otherwise("Unknown")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN grp IN ('g1', 'g2') THEN 'I' WHEN grp IN ('g3', 'g4') THEN 'II' ELSE 'other' END AS kind, count(*) AS n FROM {contigs} GROUP BY 1")
add("anchored_duplicates", "ALL-09", lambda v: G.with_anchored_dups(v("alleles").where("slot <> 'D'"), v("anchors")),
    "WITH k AS (SELECT gene, allele_id FROM {alleles} WHERE slot <> 'D'), b AS (SELECT gene1 AS x, gene2 AS gene FROM {anchors} UNION ALL SELECT gene2, gene1 FROM {anchors}) SELECT DISTINCT k.allele_id, b.gene FROM b JOIN k ON k.gene = b.x WHERE b.gene NOT IN (SELECT gene FROM k)")
add("folded_alleles", "ALL-08", lambda v: G.fold_shared(v("anchors").select(F.concat(F.lit("al"), "block").alias("allele_id"), F.explode(F.array("gene1", "gene2")).alias("gene")).distinct().withColumn("chrom", F.lit("Chr1"))))
add("alleles_from_pairs", "ALL-05 ALL-04", lambda v: G.fold_shared(v("anchors").join(v("genes").select(F.col("gene").alias("gene1"), "chrom"), "gene1").select("chrom", F.concat("gene1", F.lit("+"), "gene2").alias("allele_id"), F.explode(F.array("gene1", "gene2")).alias("gene"))))

# --- homology, rescue, parts -------------------------------------------------------------------------------------------
FIRST_TWO = "chrom in ('Chr1', 'Chr2')"


def ortholog_table(v) -> DataFrame:
    a, b, hits = v("genes").where(FIRST_TWO), v("genes").where(f"not {FIRST_TWO}"), v("blast6")
    pick = lambda q, s: hits.join(q.select(F.col("gene").alias("qseqid")), "qseqid", "left_semi").join(s.select(F.col("gene").alias("sseqid")), "sseqid", "left_semi")
    table = H.with_paralogs(H.orthologs(a, b, pick(a, b), pick(b, a)), a, b, hits)
    return table.withColumn("paralogs", F.array_join("paralogs", ","))


add("ortholog_table", "JN-07", ortholog_table,
    f"""WITH a AS (SELECT gene FROM {{genes}} WHERE {FIRST_TWO}), b AS (SELECT gene FROM {{genes}} WHERE NOT {FIRST_TWO}),
    r AS (SELECT qseqid, sseqid, row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, identity DESC, sseqid) AS k FROM {{blast6}}
      WHERE (qseqid IN (SELECT gene FROM a) AND sseqid IN (SELECT gene FROM b)) OR (qseqid IN (SELECT gene FROM b) AND sseqid IN (SELECT gene FROM a))),
    best AS (SELECT qseqid, sseqid FROM r WHERE k = 1),
    mutual AS (SELECT x.qseqid AS gene_a, x.sseqid AS gene_b FROM best x JOIN best y ON x.qseqid = y.sseqid AND x.sseqid = y.qseqid WHERE x.qseqid IN (SELECT gene FROM a)),
    way AS (SELECT min(qseqid) AS gene_a, sseqid AS gene_b FROM best WHERE qseqid IN (SELECT gene FROM a) AND qseqid NOT IN (SELECT gene_a FROM mutual) AND sseqid NOT IN (SELECT gene_b FROM mutual) GROUP BY sseqid),
    pairs AS (SELECT gene_a, gene_b, 'reciprocal' AS kind, 0 AS k FROM mutual UNION ALL SELECT gene_a, gene_b, 'best', 1 FROM way),
    paired AS (SELECT gene_a AS gene FROM pairs UNION ALL SELECT gene_b FROM pairs),
    off_hits AS (SELECT qseqid, sseqid, identity, row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, identity DESC, sseqid) AS n FROM {{blast6}} WHERE qseqid IN (SELECT gene FROM paired) AND sseqid NOT IN (SELECT gene FROM paired)),
    cand AS (SELECT p.gene_a, p.gene_b, o.sseqid AS paralog, row_number() OVER (PARTITION BY o.sseqid ORDER BY o.identity DESC, p.k DESC, p.gene_a DESC, p.gene_b DESC) AS n FROM pairs p JOIN off_hits o ON o.n = 1 AND (o.qseqid = p.gene_a OR o.qseqid = p.gene_b)),
    lists AS (SELECT gene_a, gene_b, string_agg(paralog, ',' ORDER BY paralog) AS paralogs FROM cand WHERE n = 1 GROUP BY 1, 2)
    SELECT p.gene_a, p.gene_b, p.kind, coalesce(l.paralogs, '') AS paralogs FROM pairs p LEFT JOIN lists l ON l.gene_a = p.gene_a AND l.gene_b = p.gene_b
    UNION ALL SELECT gene, NULL, 'none', '' FROM a WHERE gene NOT IN (SELECT gene FROM paired) AND gene NOT IN (SELECT paralog FROM cand)
    UNION ALL SELECT NULL, gene, 'none', '' FROM b WHERE gene NOT IN (SELECT gene FROM paired) AND gene NOT IN (SELECT paralog FROM cand)""")


def copy_numbers(v) -> DataFrame:
    depth = v("genes").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(F.concat(F.lit("s"), F.col("k")).alias("sample"), "gene", "start", "stop", ((F.col("stop") - F.col("start")) % 97 + F.col("k")).alias("coverage"))
    reads = depth.groupBy("sample").agg((F.count(F.lit(1)) * 1000).alias("n"))
    return rounded(H.copy_numbers(depth, reads, 150, 4_000_000), "copies")


add("copy_number_by_sample", "AGG-15", copy_numbers,
    """WITH d AS (SELECT 's' || cast(k AS varchar) AS sample, gene, start, stop, (stop - start) % 97 + k AS coverage FROM {genes} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) ks),
    n AS (SELECT sample, count(*)*1000 AS n FROM d GROUP BY 1)
    SELECT d.sample, gene, round(cast(coverage*150 AS double)/abs(stop - start)/(cast(n AS double)*150/4000000), 6) AS copies FROM d JOIN n ON n.sample = d.sample""")
add("gene_evidence_labels", "FLT-12", lambda v: H.gene_evidence(
    v("blast6").select(F.col("qseqid").alias("gene"), "identity", "length"), v("tandem").select(F.col("gene1").alias("gene")).unionByName(v("anchors").select(F.col("gene2").alias("gene"))),
    v("expression").select(F.col("gene_a").alias("gene"), (F.col("a1") + 0.7).alias("fpkm")), v("expression").select(F.col("gene_a").alias("gene"), (F.col("b1") / 100).alias("cov")),
    v("genes").select("gene", ((F.col("stop") - F.col("start")) % 101).alias("support")), fpkm=20),
    """WITH b AS (SELECT qseqid AS gene, count(*) AS n FROM {blast6} WHERE identity >= 30 AND length >= 100 GROUP BY 1),
    p AS (SELECT gene, count(*) AS n FROM (SELECT gene1 AS gene FROM {tandem} UNION ALL SELECT gene2 FROM {anchors}) x GROUP BY 1),
    every AS (SELECT gene FROM b UNION SELECT gene FROM p UNION SELECT gene_a FROM {expression} UNION SELECT gene FROM {genes}),
    t AS (SELECT e.gene, coalesce(b.n, 0) AS blast, coalesce(p.n, 0) AS pfam, coalesce(cast(floor(x.a1 + 0.7) AS bigint), 0) AS fpkm, coalesce(x.b1/100, 0.0) AS cov, coalesce((g.stop - g.start) % 101, 0) AS support
      FROM every e LEFT JOIN b ON b.gene = e.gene LEFT JOIN p ON p.gene = e.gene LEFT JOIN {expression} x ON x.gene_a = e.gene LEFT JOIN {genes} g ON g.gene = e.gene)
    SELECT *, CASE WHEN blast > 1 OR pfam > 1 OR (fpkm > 20 AND cov > 0.5) OR support > 90 THEN 'keep' ELSE 'remove' END AS label FROM t""")
add("ko_rows", "SNK-14", lambda v: H.ko_list(v("anchors").select(F.col("gene1").alias("gene"), F.when(F.col("line_no") % 3 != 0, F.concat(F.lit('"'), "gene2", F.lit(",K"), "block", F.lit('"'))).alias("kos"))),
    "SELECT gene1 AS gene, gene2 AS ko FROM {anchors} WHERE line_no % 3 <> 0 UNION ALL SELECT gene1, 'K' || block FROM {anchors} WHERE line_no % 3 <> 0 UNION ALL SELECT gene1, NULL FROM {anchors} WHERE line_no % 3 = 0")
add("contig_targets", "INT-15", lambda v: rounded(H.contig_targets(H.suppressed(v("blast6").where("qseqid <> sseqid").select(F.col("qseqid").alias("q"), F.col("sseqid").alias("t"), F.least(F.col("bitscore"), F.col("length")).alias("score"), (F.col("bitscore") * 7 % 500).alias("start"), (F.col("bitscore") * 7 % 500 + F.col("length")).alias("stop"))),
    v("blast6").select(F.col("qseqid").alias("q"), F.lit(600).alias("size")).distinct(), 0.7, 0.3), "identity", "overlap"))


def alignment_lines(v) -> DataFrame:
    strand = lambda k: F.when(F.col("mapq") % k == 0, "+").otherwise("-")
    number = lambda c: F.substring(c, 4, 9).cast("long")
    a = C.strongest(v("alignments"), "read_id", [F.col("ref1"), F.col("ref2")])  # ids repeat in the view
    a = a.withColumns({"line_no": F.col("read_id"), "name": F.floor(F.col("read_id") / 8).cast("string"), "strand1": strand(2), "strand2": strand(3), "is_paired": F.lit(True)})
    return a.withColumns({"ref_id1": number("ref1"), "ref_id2": number("ref2")})


add("alignment_links", "SNK-06 SRC-30", lambda v: R.links_of_alignments(alignment_lines(v)),
    """SELECT line_no, name, CASE WHEN mapq % 2 = 0 THEN 0 ELSE 16 END AS flag1, ref1, p1, CASE WHEN i <= j THEN 0 ELSE 1 END AS order1, CASE WHEN mapq % 3 = 0 THEN 0 ELSE 16 END AS flag2, ref2, p2, CASE WHEN i <= j THEN 1 ELSE 0 END AS order2
    FROM (SELECT *, read_id AS line_no, cast(read_id // 8 AS varchar) AS name, cast(substring(ref1, 4, 9) AS bigint) AS i, cast(substring(ref2, 4, 9) AS bigint) AS j, lag(read_id // 8) OVER (ORDER BY read_id) AS b FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY ref1, ref2) AS r FROM {alignments}) y WHERE r = 1) x WHERE (b IS NULL OR b <> read_id // 8) AND NOT is_unmapped""")
add("insert_positions", "MAT-28", lambda v: R.insert_positions(C.counted_both_ways(v("alignments").where("ref1 <> ref2"), "ref1", "ref2"), v("agp_new").select("chrom", "id", (F.row_number().over(Window.partitionBy("chrom").orderBy("number")) - 1).alias("number"))),
    """WITH s AS (SELECT x, y, count(*) AS n FROM (SELECT ref1 AS x, ref2 AS y FROM {alignments} WHERE ref1 <> ref2 UNION ALL SELECT ref2, ref1 FROM {alignments} WHERE ref1 <> ref2) z GROUP BY 1, 2),
    t AS (SELECT chrom, id, row_number() OVER (PARTITION BY chrom ORDER BY number) - 1 AS k FROM {agp_new}),
    f AS (SELECT s.x, t.chrom, s.y, s.n, t.k FROM s JOIN t ON t.id = s.y WHERE s.x NOT IN (SELECT id FROM t)),
    b AS (SELECT *, row_number() OVER (PARTITION BY x, chrom ORDER BY n DESC, k) AS r FROM f),
    p AS (SELECT b.x, b.chrom, b.y AS nearest, b.n, CASE WHEN b.k = 0 THEN -1 WHEN coalesce(d.n, 0) > coalesce(u.n, 0) THEN b.k ELSE b.k - 1 END AS before FROM b LEFT JOIN f u ON u.x = b.x AND u.chrom = b.chrom AND u.k = b.k - 1 LEFT JOIN f d ON d.x = b.x AND d.chrom = b.chrom AND d.k = b.k + 1 WHERE b.r = 1)
    SELECT *, before + 1 AS after FROM p""")
add("fastq_parts", "SNK-13", lambda v: R.parts_by_count(v("valid_pairs").select("read_id", F.col("read_id").alias("line_no")), 1000).select("read_id", "part"), "SELECT read_id, read_id // 1000 AS part FROM {valid_pairs}")
add("fasta_parts", "SNK-13 SNK-05", lambda v: R.parts_by_length(v("contigs").select("id", "length", F.substring("id", 4, 9).cast("long").alias("line_no")), "length", 100_000).select("id", "part"),
    "SELECT id, cast(sum(length) OVER (ORDER BY cast(substring(id, 4, 9) AS bigint)) // 100000 AS bigint) AS part FROM {contigs}")
add("most_even_partition", "AGG-18", lambda v: rounded(R.most_even(v("contigs").withColumn("k", F.explode(F.array(F.lit(3), F.lit(5), F.lit(7)))).groupBy("k", (F.substring("id", 4, 9).cast("long") % F.col("k")).alias("g")).agg(F.sum("length").alias("l")), ["k"], "l"), "score"),
    "SELECT k, round(cast(max(l) - min(l) AS double)/cast(sum(l) AS double), 6) AS score FROM (SELECT k, cast(substring(id, 4, 9) AS bigint) % k AS g, sum(length) AS l FROM {contigs} CROSS JOIN (SELECT 3 AS k UNION ALL SELECT 5 UNION ALL SELECT 7) ks GROUP BY 1, 2) x GROUP BY k ORDER BY cast(max(l) - min(l) AS double)/cast(sum(l) AS double), k LIMIT 1")
add("cluster_of_contig", "JN-09", lambda v: R.inverted(ASM.clusters(v("agp_old")), "chrom", "contigs"), "SELECT id AS item, chrom FROM {agp_old}")
add("listed_genes", "FLT-11", lambda v: R.listed(v("genes"), v("tandem").select("gene1"), "gene").select("gene", F.lit(True).alias("listed")).unionByName(R.listed(v("genes"), v("tandem").select("gene1"), "gene", keep=False).select("gene", F.lit(False).alias("listed"))),
    "SELECT gene, gene IN (SELECT gene1 FROM {tandem}) AS listed FROM {genes}")
add("row_sum_summary", "AGG-16", lambda v: rounded(C.bin_sums(v("genome_pixels"), []).agg(F.count("total").alias("n"), F.min("total").cast("double").alias("least"), F.max("total").cast("double").alias("most"), F.avg("total").alias("mean"), F.stddev_samp("total").alias("sd"), *[F.percentile("total", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.25, 0.2, 0.1)]), "p25", "p20", "p10", "mean", "sd"),
    "SELECT count(*) AS n, min(total) AS least, max(total) AS most, round(quantile_cont(total, 0.25), 6) AS p25, round(quantile_cont(total, 0.2), 6) AS p20, round(quantile_cont(total, 0.1), 6) AS p10, round(avg(total), 6) AS mean, round(stddev_samp(total), 6) AS sd FROM (SELECT bin, cast(sum(n) AS double) AS total FROM (SELECT bin1 AS bin, n FROM {genome_pixels} UNION ALL SELECT bin2, n FROM {genome_pixels} WHERE bin1 <> bin2) x GROUP BY bin) y")
add("smallest_domains", "SRT-04", lambda v: v("domains").withColumn("size", F.col("stop") - F.col("start")).orderBy("size", "chrom", "start").limit(20), "SELECT chrom, start, stop, level, stop-start AS size FROM {domains} ORDER BY stop-start, chrom, start LIMIT 20")
add("decay_slope_pooled", "STA-01", lambda v: C.decay_slope(C.decay(v("valid_pairs"), 10000, 50000, 300000, by=[]), by=[]),
    "SELECT round(regr_slope(log10(n), log10(dist)), 6) AS slope FROM (SELECT cast(floor(abs(pos2-pos1)/10000)*10000 AS bigint) AS dist, count(*) AS n FROM {valid_pairs} WHERE chr1 = chr2 GROUP BY 1) x WHERE dist BETWEEN 50000 AND 300000")
add("dosage_regression", "STA-14", lambda v: rounded(T.regression(v("expression").where("a1 >= 2 and b1 >= 2").select(F.log2("a1").alias("x"), F.log2("b1").alias("y")), [], "x", "y"), "slope", "intercept", "r").drop("error", "p"),
    "SELECT count(*) AS n, round(regr_slope(log2(b1), log2(a1)), 6) AS slope, round(regr_intercept(log2(b1), log2(a1)), 6) AS intercept, round(corr(log2(b1), log2(a1)), 6) AS r FROM {expression} WHERE a1 >= 2 AND b1 >= 2")
add("log_plus_one", "SCL-10", lambda v: v("expression").select("gene_a", nearest(F.log1p("a1"), 6).alias("natural"), nearest(F.log2(F.col("a1") + 1), 6).alias("binary")), "SELECT gene_a, round(ln(1 + a1), 6) AS natural, round(log2(a1 + 1), 6) AS binary FROM {expression}")
add("pairs_by_chrom_text", "SCL-12", lambda v: v("valid_pairs").groupBy("chr1").agg(F.format_number(F.count(F.lit(1)), 0).alias("pairs")), "SELECT chr1, format('{:,}', count(*)) AS pairs FROM {valid_pairs} GROUP BY chr1")
add("pairs_of_both_tables", "SET-01", lambda v: v("anchors").select("gene1", "gene2", "block").unionByName(v("tandem").select("gene1", "gene2"), allowMissingColumns=True), "SELECT gene1, gene2, block FROM {anchors} UNION ALL SELECT gene1, gene2, NULL FROM {tandem}")

from . import extended  # noqa: E402,F401  adds its queries
