"""Queries of allele tables, placement of contigs, annotation trees, k-mers and distributions; registered like those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation as AN
from ..operators import assembly as ASM
from ..operators import collinearity as L
from ..operators import compartments as AB
from ..operators import contacts as C
from ..operators import genes as G
from ..operators import kmers as K
from ..operators import naming as N
from ..operators import placement as P
from ..operators import rescue as R
from ..operators import stats as T
from .catalogue import add, rounded

HAPS = ["A", "B", "C", "D"]
#: Pairs of each two haplotypes, the earlier one's gene first, of its first line alone.
FIRST_PAIRS = """o AS (SELECT gene1 AS x, gene2 AS y, hap1 || hap2 AS h, line_no FROM {hap_links} WHERE hap1 < hap2 UNION ALL SELECT gene2, gene1, hap2 || hap1, line_no FROM {hap_links} WHERE hap1 > hap2),
    p AS (SELECT h, x, y FROM (SELECT *, row_number() OVER (PARTITION BY h, x ORDER BY line_no, y) AS r FROM o) q WHERE r = 1),
    ab AS (SELECT x, y FROM p WHERE h = 'AB'), ac AS (SELECT x, y FROM p WHERE h = 'AC'), ad AS (SELECT x, y FROM p WHERE h = 'AD'), bc AS (SELECT x, y FROM p WHERE h = 'BC'), bd AS (SELECT x, y FROM p WHERE h = 'BD'), cd AS (SELECT x, y FROM p WHERE h = 'CD')"""

# --- alleles -----------------------------------------------------------------------------------------------------------
add("synteny_alleles", "ALL-04 JN-03", lambda v: L.synteny_table(v("hap_links"), HAPS),
    f"""WITH {FIRST_PAIRS},
    t1 AS (SELECT x AS a, y AS b FROM ab), t2 AS (SELECT coalesce(t.a, p.x) AS a, t.b, p.y AS c FROM t1 t FULL JOIN ac p ON t.a = p.x),
    t3 AS (SELECT coalesce(t.a, p.x) AS a, t.b, t.c, p.y AS d FROM t2 t FULL JOIN ad p ON t.a = p.x), t4 AS (SELECT t.a, coalesce(t.b, p.x) AS b, p.y AS c, t.d FROM t3 t FULL JOIN bc p ON t.b = p.x),
    t5 AS (SELECT t.a, coalesce(t.b, p.x) AS b, t.c, p.y AS d FROM t4 t FULL JOIN bd p ON t.b = p.x), t6 AS (SELECT t.a, t.b, coalesce(t.c, p.x) AS c, p.y AS d FROM t5 t FULL JOIN cd p ON t.c = p.x)
    SELECT DISTINCT a AS "geneA", b AS "geneB", c AS "geneC", d AS "geneD" FROM t6 WHERE (a IS NOT NULL)::int + (b IS NOT NULL)::int + (c IS NOT NULL)::int + (d IS NOT NULL)::int >= 2""")
add("collinear_alleles", "ALL-05 JN-03", lambda v: L.collinear_table(v("hap_links"), HAPS),
    f"""WITH {FIRST_PAIRS},
    ta AS (SELECT coalesce(ab.x, ac.x, ad.x) AS a, ab.y AS b, ac.y AS c, ad.y AS d FROM ab FULL JOIN ac ON ab.x = ac.x FULL JOIN ad ON ad.x = coalesce(ab.x, ac.x)),
    tb AS (SELECT coalesce(bc.x, bd.x) AS b, bc.y AS c, bd.y AS d FROM bc FULL JOIN bd ON bc.x = bd.x WHERE coalesce(bc.x, bd.x) NOT IN (SELECT b FROM ta WHERE b IS NOT NULL)),
    tc AS (SELECT x AS c, y AS d FROM cd WHERE x NOT IN (SELECT c FROM ta WHERE c IS NOT NULL UNION ALL SELECT c FROM tb WHERE c IS NOT NULL)),
    r0 AS (SELECT a, b, c, d FROM ta UNION ALL SELECT NULL, b, c, d FROM tb UNION ALL SELECT NULL, NULL, c, d FROM tc),
    r1 AS (SELECT * FROM r0 QUALIFY a IS NULL OR row_number() OVER (PARTITION BY a ORDER BY a NULLS LAST, b NULLS LAST, c NULLS LAST, d NULLS LAST) = 1),
    r2 AS (SELECT * FROM r1 QUALIFY b IS NULL OR row_number() OVER (PARTITION BY b ORDER BY a NULLS LAST, b NULLS LAST, c NULLS LAST, d NULLS LAST) = 1),
    r3 AS (SELECT * FROM r2 QUALIFY c IS NULL OR row_number() OVER (PARTITION BY c ORDER BY a NULLS LAST, b NULLS LAST, c NULLS LAST, d NULLS LAST) = 1),
    r4 AS (SELECT * FROM r3 QUALIFY d IS NULL OR row_number() OVER (PARTITION BY d ORDER BY a NULLS LAST, b NULLS LAST, c NULLS LAST, d NULLS LAST) = 1)
    SELECT a AS "geneA", b AS "geneB", c AS "geneC", d AS "geneD" FROM r4""")
add("expanded_alleles", "ALL-05 ALL-08 ALL-09", lambda v: L.expanded_table(L.collinear_table(v("hap_links").where("kind = 'homolog'"), HAPS), v("hap_links"), HAPS))
add("final_allele_kinds", "ALL-10", lambda v: L.final_kinds(v("allele_cells"), v("genes").select("gene", F.concat("chrom", F.lit("g1")).alias("chrom")), v("tandem"), 2),
    """WITH n AS (SELECT allele_id, chrom, count(*) AS n FROM {allele_cells} JOIN {genes} USING (gene) GROUP BY 1, 2),
    m AS (SELECT allele_id, chrom FROM n QUALIFY row_number() OVER (PARTITION BY allele_id ORDER BY n DESC, chrom) = 1),
    t AS (SELECT gene1 AS x, gene2 AS y FROM {tandem} UNION SELECT gene2, gene1 FROM {tandem})
    SELECT c.allele_id, m.chrom, c.hap, c.gene, CASE WHEN c.hap IS NOT NULL THEN 'allele' WHEN EXISTS (SELECT 1 FROM t JOIN {allele_cells} s ON s.gene = t.y WHERE t.x = c.gene AND s.allele_id = c.allele_id AND s.hap IS NOT NULL) THEN 'tandem' ELSE 'paralog' END AS kind
    FROM {allele_cells} c LEFT JOIN m ON m.allele_id = c.allele_id""")
add("remaining_tandem_alleles", "ALL-11", lambda v: L.with_remaining_tandems(v("allele_cells"), v("hap_links").where("kind = 'tandem'").select("gene1", "gene2", "hap1")),
    """WITH n AS (SELECT DISTINCT gene1, gene2, hap1 FROM {hap_links} WHERE kind = 'tandem' AND gene1 NOT IN (SELECT gene FROM {allele_cells}) AND gene2 NOT IN (SELECT gene FROM {allele_cells}))
    SELECT allele_id, hap, gene, nth FROM {allele_cells} UNION ALL SELECT '+' || gene1 || '|' || gene2, hap1, gene1, NULL FROM n UNION ALL SELECT '+' || gene1 || '|' || gene2, NULL, gene2, 1 FROM n""")
add("blast_placed_alleles", "ALL-12", lambda v: L.with_blast_genes(v("allele_cells"), v("blast6").where("bitscore >= 900").select(F.col("qseqid").alias("gene"), F.col("sseqid").alias("hit")), v("hap_of_gene")),
    """WITH t AS (SELECT DISTINCT qseqid AS gene, allele_id FROM {blast6} JOIN {allele_cells} ON sseqid = gene WHERE bitscore >= 900 AND qseqid NOT IN (SELECT gene FROM {allele_cells})),
    u AS (SELECT gene, min(allele_id) AS allele_id FROM t GROUP BY gene HAVING count(*) = 1), h AS (SELECT u.gene, u.allele_id, g.hap FROM u LEFT JOIN {hap_of_gene} g ON g.gene = u.gene),
    f AS (SELECT *, hap IS NOT NULL AND row_number() OVER (PARTITION BY allele_id, hap ORDER BY gene) = 1 AND NOT EXISTS (SELECT 1 FROM {allele_cells} c WHERE c.allele_id = h.allele_id AND c.hap = h.hap) AS free FROM h),
    a AS (SELECT allele_id, coalesce(max(nth), 0) AS n FROM {allele_cells} GROUP BY 1)
    SELECT allele_id, hap, gene, nth FROM {allele_cells} UNION ALL SELECT allele_id, hap, gene, NULL FROM f WHERE free
    UNION ALL SELECT f.allele_id, NULL, f.gene, a.n + row_number() OVER (PARTITION BY f.allele_id ORDER BY f.gene) FROM f JOIN a ON a.allele_id = f.allele_id WHERE NOT free""")
add("merged_cell_tables", "ALL-13 SET-01", lambda v: L.merged_tables(v("allele_cells"), v("allele_cells2")),
    """WITH k AS (SELECT b.allele_id, a.allele_id AS into_id, count(DISTINCT b.gene) AS n FROM {allele_cells2} b JOIN {allele_cells} a ON a.gene = b.gene GROUP BY 1, 2), m AS (SELECT allele_id, count(DISTINCT gene) AS n FROM {allele_cells2} GROUP BY 1)
    SELECT allele_id, hap, gene, nth FROM {allele_cells} UNION ALL SELECT '2:' || allele_id, hap, gene, nth FROM {allele_cells2} WHERE allele_id NOT IN (SELECT k.allele_id FROM k JOIN m ON m.allele_id = k.allele_id AND m.n = k.n)""")

# --- contigs -----------------------------------------------------------------------------------------------------------
add("placed_contigs", "MAT-27", lambda v: P.placed_contigs(v("contigs").select("id", "length"), v("contigs").where("length % 3000 <> 0").select("id", "grp"), v("alignments").groupBy(F.col("ref1").alias("x"), F.col("ref2").alias("y")).agg(F.count(F.lit(1)).alias("n")), v("allele_contigs").select(F.col("contig").alias("id"), "gene"), without=["g6"], least=2))

# --- contacts ----------------------------------------------------------------------------------------------------------
add("territories_by_distance", "MAT-22", lambda v: rounded(C.territories_by_distance(v("valid_pairs"), v("chrom_sizes"), 20000), "expected", "score"),
    """WITH c AS (SELECT chrom, cast(sum(ceil(size/20000.0)) OVER (ORDER BY chrom) - ceil(size/20000.0) AS bigint) AS f, cast(ceil(size/20000.0) AS bigint) AS n FROM {chrom_sizes}),
    w AS (SELECT chrom, f + unnest(range(0, n)) AS g FROM c), g AS (SELECT chr1, chr2, a.f + pos1 // 20000 AS g1, b.f + pos2 // 20000 AS g2 FROM {valid_pairs} JOIN c a ON a.chrom = chr1 JOIN c b ON b.chrom = chr2),
    m AS (SELECT d, cast(n AS double)/((SELECT sum(n) FROM c) - d) AS m FROM (SELECT abs(g1 - g2) AS d, count(*) AS n FROM g GROUP BY 1) x),
    e AS (SELECT a.chrom AS chrom1, b.chrom AS chrom2, sum(m) AS expected FROM w a JOIN w b ON a.g < b.g AND a.chrom <> b.chrom JOIN m ON m.d = b.g - a.g GROUP BY 1, 2),
    o AS (SELECT least(chr1, chr2) AS chrom1, greatest(chr1, chr2) AS chrom2, count(*) AS observed FROM g WHERE chr1 <> chr2 GROUP BY 1, 2)
    SELECT o.chrom1, o.chrom2, observed, round(expected, 6) AS expected, round(log2(observed/expected), 6) AS score FROM o JOIN e ON e.chrom1 = o.chrom1 AND e.chrom2 = o.chrom2""")

# --- annotation --------------------------------------------------------------------------------------------------------
add("coding_positions", "FLT-15", lambda v: rounded(AN.genome_positions(v("gff"), v("part").select(F.format_string("G%d.t1", "p_partkey").alias("parent"), (F.col("p_size") * 7).cast("long").alias("pos")), by_strand=True), "percent"),
    """WITH c AS (SELECT regexp_extract(attributes, 'Parent=(.*)$', 1) AS parent, chrom, strand, start, stop FROM {gff} WHERE type = 'CDS'),
    r AS (SELECT *, sum(stop - start + 1) OVER (PARTITION BY parent ORDER BY CASE WHEN strand = '-' THEN -stop ELSE start END, stop) AS last FROM c),
    p AS (SELECT 'G' || p_partkey || '.t1' AS parent, cast(p_size*7 AS bigint) AS pos FROM {part}),
    h AS (SELECT p.parent, p.pos, r.chrom, cast(CASE WHEN strand = '-' THEN stop - (pos - (last - stop + start)) ELSE start + (pos - (last - stop + start)) END AS bigint) AS base FROM p JOIN r ON r.parent = p.parent AND pos BETWEEN last - stop + start AND last)
    SELECT h.parent, h.pos, h.chrom, h.base, g.gene, round(cast(h.base - g.start AS double)/(g.stop - g.start + 1)*100, 6) AS percent FROM h
    JOIN (SELECT regexp_extract(attributes, 'ID=([^;]*)', 1) AS gene, start, stop FROM {gff} WHERE type = 'gene') g ON g.gene || '.t1' = h.parent""")
add("renamed_subtrees", "FLT-09 FLT-08", lambda v: AN.renamed_subtrees(v("gff").drop("level"), v("part").where("p_partkey % 3 = 0").select(F.format_string("G%d", "p_partkey").alias("old"), F.format_string("New$%d", "p_size").alias("new"))).select("old", "chrom", "type", "start", "stop", "attributes"),
    r"""WITH n AS (SELECT 'G' || p_partkey AS old, 'New$' || p_size AS new FROM {part} WHERE p_partkey % 3 = 0)
    SELECT old, chrom, type, start, stop, rtrim(replace(replace(attributes || ';', old || ';', new || ';'), old || '.', new || '.'), ';') AS attributes FROM {gff} JOIN n ON n.old = 'G' || regexp_extract(attributes, 'G([0-9]+)', 1)""")

# --- sequences ---------------------------------------------------------------------------------------------------------
add("kmer_sets", "SET-04", lambda v: K.venn_of(v("sequences").withColumn("seq", F.translate("seq", "N", "")).withColumn("sample", F.substring("chrom", 2, 12).cast("long") % 3), 21, [0, 1, 2]),
    """WITH w AS (SELECT sample, substring(seq, i, 21) AS w FROM (SELECT cast(substring(chrom, 2, 12) AS bigint) % 3 AS sample, s AS seq, unnest(range(1, len(s) - 19)) AS i FROM (SELECT chrom, translate(seq, 'N', '') AS s FROM {sequences}) q) x),
    c AS (SELECT sample, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM w WHERE NOT regexp_matches(w, '[^ACGT]'))
    SELECT mask, count(*) AS n FROM (SELECT kmer, bit_or(1 << cast(sample AS integer)) AS mask FROM c GROUP BY kmer) y GROUP BY mask""")

# --- distributions -----------------------------------------------------------------------------------------------------
add("regression_p_by_chrom", "STA-02", lambda v: rounded(T.regression(AB.paired(v("bg1"), v("bg2")), ["chrom"], "v1", "v2").select("chrom", "n", "p"), "p"),
    """WITH g AS (SELECT a.chrom, count(*) AS n, regr_slope(b.score, a.score) AS s, sqrt(greatest(0.0, (1 - corr(b.score, a.score)*corr(b.score, a.score))*var_samp(b.score)/var_samp(a.score)/(count(*) - 2))) AS e
      FROM {bg1} a JOIN {bg2} b ON b.chrom = a.chrom AND b.start = a.start GROUP BY a.chrom HAVING count(*) >= 3 AND var_samp(a.score) > 0),
    t AS (SELECT chrom, n, cast(n - 2 AS double) AS df, abs(s/e)/2000 AS h FROM g)
    SELECT chrom, n, round(1 - 2*exp(lgamma((df + 1)/2) - lgamma(df/2))/sqrt(pi()*df)*h/3*list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END*power(1 + i*i*h*h/df, -(df + 1)/2))), 6) AS p FROM t""")
add("domain_conservation", "ASM-10", lambda v: rounded(AB.conserved_domains(v("domains"), v("genes"), v("domains"), v("genes"), v("anchors"), 0.7, 0.01, 2, 1), "share1", "share2", "anchored_share1", "anchored_share2"),
    """WITH d AS (SELECT gene, s FROM (SELECT g.gene, d.chrom || ':' || d.start || ':' || d.stop AS s, row_number() OVER (PARTITION BY g.gene ORDER BY least(d.stop, g.stop) - greatest(d.start, g.start) DESC, d.chrom, d.start, d.stop) AS r
      FROM {genes} g JOIN (SELECT DISTINCT chrom, start, stop FROM {domains}) d ON d.chrom = g.chrom AND d.start < g.stop AND d.stop > g.start WHERE least(d.stop, g.stop) - greatest(d.start, g.start) >= cast(0.7 AS double)*(g.stop-g.start)) x WHERE r = 1),
    m1 AS (SELECT s, count(*) AS n, count(*) FILTER (WHERE gene IN (SELECT gene1 FROM {anchors})) AS a FROM d GROUP BY s), m2 AS (SELECT s, count(*) AS n, count(*) FILTER (WHERE gene IN (SELECT gene2 FROM {anchors})) AS a FROM d GROUP BY s),
    p AS (SELECT x.s AS s1, y.s AS s2, count(*) AS n, string_agg(a.gene1, ',' ORDER BY a.line_no, a.gene1, a.gene2) AS n1, string_agg(a.gene2, ',' ORDER BY a.line_no, a.gene1, a.gene2) AS n2 FROM {anchors} a JOIN d x ON x.gene = a.gene1 JOIN d y ON y.gene = a.gene2 GROUP BY 1, 2)
    SELECT s1 AS domain1, s2 AS domain2, p.n AS pairs, m1.n AS genes1, m2.n AS genes2, m1.a AS anchored1, m2.a AS anchored2, round(p.n/m1.n, 6) AS share1, round(p.n/m2.n, 6) AS share2, round(p.n/m1.a, 6) AS anchored_share1, round(p.n/m2.a, 6) AS anchored_share2, n1 AS names1, n2 AS names2
    FROM p JOIN m1 ON m1.s = s1 JOIN m2 ON m2.s = s2 WHERE least(p.n/m1.n, p.n/m2.n) >= 0.01 AND least(m1.n, m2.n) >= 2 AND least(m1.a, m2.a) >= 1""")
add("domain_size_density", "STA-12", lambda v: rounded(T.density(v("domains").withColumn("size", F.col("stop") - F.col("start")), "size", ["level"], 64).withColumn("density", F.col("density") * 1e6), "x", "density"),
    """WITH s AS (SELECT level, cast(stop - start AS double) AS x FROM {domains}), g AS (SELECT level, count(*) AS n, stddev_samp(x)*power(count(*), -0.2) AS h, min(x) AS lo, max(x) AS hi FROM s GROUP BY level HAVING stddev_samp(x) > 0),
    p AS (SELECT *, lo - 3*h AS f, (hi - lo + 6*h)/63 AS step FROM g), b AS (SELECT s.level, cast(floor((s.x - f)/step + 0.5) AS bigint) AS i, count(*) AS c FROM s JOIN p ON p.level = s.level GROUP BY 1, 2)
    SELECT p.level, cast(j AS integer) AS nth, round(f + j*step, 6) AS x, round(1e6*(SELECT sum(c*exp(-0.5*power((j - b.i)*step/h, 2))) FROM b WHERE b.level = p.level)/(n*h*sqrt(2*pi())), 6) AS density FROM p, range(0, 64) r(j)""")

# --- compartments and contigs by position ------------------------------------------------------------------------------
add("bins_by_position", "JN-08 INT-04", lambda v: (lambda b: rounded(AB.beside(b(v("bg1")), b(v("bg2").where("start >= 20000")), ["chrom", "start"]), "score", "score2"))(lambda d: d.select("chrom", "start", "score")),
    """WITH a AS (SELECT chrom, start, score, row_number() OVER (ORDER BY chrom, start) - 1 AS place FROM {bg1}), b AS (SELECT chrom AS chrom2, start AS start2, score AS score2, row_number() OVER (ORDER BY chrom, start) - 1 AS place FROM {bg2} WHERE start >= 20000)
    SELECT a.chrom, a.start, round(score, 6) AS score, chrom2, start2, round(score2, 6) AS score2, a.place FROM a JOIN b ON b.place = a.place""")
add("link_flips", "INT-07", lambda v: rounded(AB.flips_of_links(G.anchor_links(v("anchors"), v("genes"), v("genes")).select("gene1", "gene2", "chrom1", "start1", "stop1", "chrom2", "start2", "stop2"), v("bg1"), v("bg2")).select("gene1", "gene2", "v1", "v2", "way"), "v1", "v2"),
    """SELECT gene1, gene2, round(x.score, 6) AS v1, round(y.score, 6) AS v2, CASE WHEN x.score > y.score THEN 'a2b' ELSE 'b2a' END AS way FROM {anchors} JOIN {genes} a ON a.gene = gene1 JOIN {genes} b ON b.gene = gene2
    JOIN {bg1} x ON x.chrom = a.chrom AND (a.stop - a.start) // 2 + a.start >= x.start AND (a.stop - a.start) // 2 + a.start < x.stop JOIN {bg2} y ON y.chrom = b.chrom AND (b.stop - b.start) // 2 + b.start >= y.start AND (b.stop - b.start) // 2 + b.start < y.stop
    WHERE x.score*y.score < 0 AND abs(x.score - y.score) >= 0.005""")
add("contig_pairs_on_chromosomes", "ASM-04", lambda v: ASM.contig_pairs_to_chrom(v("alignments").where("not is_unmapped"), v("agp_new")),
    """SELECT read_id, a.chrom AS chr1, CASE WHEN a.orientation = '+' THEN a.start + p1 ELSE a.stop - p1 END AS pos1, b.chrom AS chr2, CASE WHEN b.orientation = '+' THEN b.start + p2 ELSE b.stop - p2 END AS pos2
    FROM {alignments} JOIN {agp_new} a ON a.id = ref1 JOIN {agp_new} b ON b.id = ref2 WHERE NOT is_unmapped""")

# --- names and fragments -----------------------------------------------------------------------------------------------
CHROM_NAMES = lambda v: v("chrom_sizes").where("chrom <> 'Chr3'").select(F.col("chrom").alias("old"), F.concat(F.lit("LG$"), F.substring("chrom", 4, 2)).alias("new"))
add("layout_renamed", "FLT-08", lambda v: N.by_list(v("agp_old"), "chrom", CHROM_NAMES(v)).select("chrom", "start", "id"), "SELECT CASE WHEN chrom <> 'Chr3' THEN 'LG$' || substring(chrom, 4, 2) ELSE chrom END AS chrom, start, id FROM {agp_old}")
add("annotation_on_renamed", "FLT-08", lambda v: N.by_list(v("gff").drop("level"), "chrom", CHROM_NAMES(v), keep_others=False), "SELECT 'LG$' || substring(chrom, 4, 2) AS chrom, type, start, stop, strand, attributes FROM {gff} WHERE chrom <> 'Chr3'")
add("attributes_renamed", "FLT-08", lambda v: N.attribute_by_list(v("gff").drop("level"), "Parent", v("part").where("p_partkey % 2 = 0").select(F.format_string("G%d.t1", "p_partkey").alias("old"), F.format_string("T%d$1", "p_partkey").alias("new"))),
    "SELECT chrom, type, start, stop, strand, regexp_replace(attributes, 'Parent=G([0-9]+).t1', 'Parent=T\\1$1') AS attributes FROM {gff} WHERE type = 'CDS' AND cast(regexp_extract(attributes, 'G([0-9]+)', 1) AS bigint) % 2 = 0")
add("genes_affixed", "FLT-08", lambda v: N.affixed(v("genes"), "gene", "x_", ".v2"), "SELECT chrom, start, stop, 'x_' || gene || '.v2' AS gene, strand FROM {genes}")
add("genes_by_haplotype", "FLT-08", lambda v: N.prefixed_by_haplotype(v("genes"), "gene", ["1", "2", "3"]), "SELECT chrom, start, stop, CASE right(chrom, 1) WHEN '1' THEN 'A|' WHEN '2' THEN 'B|' WHEN '3' THEN 'C|' ELSE '' END || gene AS gene, strand FROM {genes}")
add("fragment_pairs", "SNK-10", lambda v: R.fragment_pairs(v("valid_pairs"), v("genes")),
    """WITH o AS (SELECT *, chr1 > chr2 OR (chr1 = chr2 AND pos1 > pos2) AS t FROM {valid_pairs}),
    r AS (SELECT read_id, CASE WHEN t THEN chr2 ELSE chr1 END AS chr1, CASE WHEN t THEN pos2 ELSE pos1 END AS pos1, CASE WHEN (CASE WHEN t THEN strand2 ELSE strand1 END) = '+' THEN 1 ELSE 0 END AS strand1,
      CASE WHEN t THEN chr1 ELSE chr2 END AS chr2, CASE WHEN t THEN pos1 ELSE pos2 END AS pos2, CASE WHEN (CASE WHEN t THEN strand1 ELSE strand2 END) = '+' THEN 1 ELSE 0 END AS strand2 FROM o),
    f1 AS (SELECT read_id, min(start) AS up1, min(stop) AS down1 FROM r JOIN {genes} ON chrom = chr1 AND pos1 >= start AND pos1 < stop GROUP BY 1 HAVING count(*) = 1), f2 AS (SELECT read_id, min(start) AS up2, min(stop) AS down2 FROM r JOIN {genes} ON chrom = chr2 AND pos2 >= start AND pos2 < stop GROUP BY 1 HAVING count(*) = 1)
    SELECT r.read_id, chr1, pos1, strand1, up1, down1, chr2, pos2, strand2, up2, down2 FROM r LEFT JOIN f1 ON f1.read_id = r.read_id LEFT JOIN f2 ON f2.read_id = r.read_id""")

# --- matrices of placed contigs and of homologous groups ---------------------------------------------------------------
add("placed_log_matrices", "MAT-18", lambda v: rounded(C.placed_log_matrices(ASM.contig_pairs_to_chrom(v("alignments").where("not is_unmapped"), v("agp_new")), v("chrom_sizes"), 50000), "score"),
    """WITH p AS (SELECT a.chrom AS c1, b.chrom AS c2, CASE WHEN a.orientation = '+' THEN a.start + p1 ELSE a.stop - p1 END // 50000 AS b1, CASE WHEN b.orientation = '+' THEN b.start + p2 ELSE b.stop - p2 END // 50000 AS b2
      FROM {alignments} JOIN {agp_new} a ON a.id = ref1 JOIN {agp_new} b ON b.id = ref2 WHERE NOT is_unmapped),
    f AS (SELECT chrom, cast(sum(ceil(size/50000.0)) OVER (ORDER BY chrom) - ceil(size/50000.0) AS bigint) AS f FROM {chrom_sizes}),
    h AS (SELECT c1 AS matrix, b1 AS x, b2 AS y FROM p WHERE c1 = c2 UNION ALL SELECT 'genome', u.f + b1, w.f + b2 FROM p JOIN f u ON u.chrom = c1 JOIN f w ON w.chrom = c2)
    SELECT matrix, x, y, round(log2(cast(count(*) AS double)), 6) AS score FROM (SELECT matrix, x, y FROM h UNION ALL SELECT matrix, y, x FROM h) z GROUP BY 1, 2, 3""")
add("homolog_row_medians", "MAT-20 MAT-19", lambda v: rounded(C.pair_medians(C.symmetric(v("genome_pixels")), v("genome_pixels").select(F.explode(F.array("bin1", "bin2")).alias("bin")).distinct().withColumn("chrom", F.format_string("Ch%d%s", F.floor(F.col("bin") / 100) + 1, F.when(F.col("bin") % 100 < 50, "A").otherwise("B"))).select("bin", C.homolog(F.col("chrom")).alias("grp"))), "median", "mean"),
    """WITH s AS (SELECT bin1, bin2, n FROM {genome_pixels} UNION ALL SELECT bin2, bin1, n FROM {genome_pixels} WHERE bin1 <> bin2), b AS (SELECT DISTINCT bin1 AS bin, 'Ch' || (bin1 // 100 + 1) AS grp FROM s),
    g AS (SELECT DISTINCT 'Ch' || (bin1 // 100 + 1) AS g1, 'Ch' || (bin2 // 100 + 1) AS g2 FROM s), r AS (SELECT b.bin, b.grp AS grp1, g.g2 AS grp2, coalesce(sum(s.n), 0) AS t FROM b JOIN g ON b.grp = g.g1 LEFT JOIN s ON s.bin1 = b.bin AND 'Ch' || (s.bin2 // 100 + 1) = g.g2 GROUP BY 1, 2, 3)
    SELECT grp1, grp2, round(cast(median(t) AS double), 6) AS median, round(cast(avg(t) AS double), 6) AS mean FROM r GROUP BY 1, 2""")
