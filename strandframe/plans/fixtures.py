"""Genomic views over the star-schema tables: one SQL text each, which Spark and DuckDB both run."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

#: View name to SQL; tables and other views stand in braces.
VIEWS: dict[str, str] = {
    "valid_pairs": """
        SELECT l_orderkey*8 + l_linenumber AS read_id,
          concat('Chr', cast(1 + (l_partkey % 4) AS varchar(8))) AS chr1,
          (l_orderkey*7919 + l_linenumber*104729) % 1000000 AS pos1,
          CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand1,
          concat('Chr', cast(1 + ((l_partkey + CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey ELSE 0 END) % 4) AS varchar(8))) AS chr2,
          ((l_orderkey*7919 + l_linenumber*104729) % 1000000 + (l_partkey*l_suppkey*l_linenumber) % 200000) % 1000000 AS pos2,
          CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS strand2,
          cast(100 + (l_orderkey*31) % 900 AS bigint) AS frag_size,
          concat('F', cast((l_orderkey*7919 + l_linenumber*104729) % 1000000 % 997 AS varchar(8))) AS site1,
          concat('F', cast((l_partkey*l_suppkey) % 997 AS varchar(8))) AS site2 FROM {lineitem}
    """,
    "genes": """
        SELECT concat('Chr', cast(1 + (p_partkey % 4) AS varchar(8))) AS chrom, (p_partkey*9973) % 990000 AS start,
          (p_partkey*9973) % 990000 + 500 + p_size*100 AS stop, concat('G', cast(p_partkey AS varchar(12))) AS gene,
          CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM {part}
    """,
    "domains": """
        SELECT concat('Chr', cast(1 + (s_suppkey % 4) AS varchar(8))) AS chrom, (s_suppkey*7717) % 900000 AS start,
          (s_suppkey*7717) % 900000 + 20000 + s_nationkey*1000 AS stop, 1 + (s_nationkey % 3) AS level FROM {supplier}
    """,
    "chrom_sizes": """
        SELECT concat('Chr', cast(1 + n_nationkey AS varchar(8))) AS chrom, cast(1000000 AS bigint) AS size FROM {nation} WHERE n_nationkey < 4
    """,
    "bg1": """
        SELECT chrom, b*10000 AS start, (b+1)*10000 AS stop, cast(sum(v) AS double)/cast(100*count(*) AS double) AS score FROM (
          SELECT concat('Chr', cast(1 + (o_custkey % 4) AS varchar(8))) AS chrom, o_orderkey % 100 AS b, (o_custkey*37) % 201 - 100 AS v FROM {orders}) x GROUP BY chrom, b
    """,
    "bg2": """
        SELECT chrom, b*10000 AS start, (b+1)*10000 AS stop, cast(sum(v) AS double)/cast(100*count(*) AS double) AS score FROM (
          SELECT concat('Chr', cast(1 + (o_custkey % 4) AS varchar(8))) AS chrom, o_orderkey % 100 AS b, (o_custkey*53 + o_orderkey*11) % 201 - 100 AS v FROM {orders}) x GROUP BY chrom, b
    """,
    "anchors": """
        SELECT concat('G', cast(p_partkey AS varchar(12))) AS gene1, concat('G', cast((p_partkey*3 + 1) % 200 AS varchar(12))) AS gene2,
          concat('block', cast(1 + cast(floor(p_partkey/10) AS bigint) AS varchar(8))) AS block, p_partkey AS line_no FROM {part}
    """,
    "agp_old": """
        SELECT concat('Chr', cast(1 + c % 4 AS varchar(8))) AS chrom, cast(floor(c/4) AS bigint)*10000 + 1 AS start, (cast(floor(c/4) AS bigint)+1)*10000 AS stop,
          cast(floor(c/4) AS bigint) + 1 AS number, 'W' AS type, concat('ctg', cast(c AS varchar(8))) AS id, cast(1 AS bigint) AS tig_start, cast(10000 AS bigint) AS tig_stop,
          CASE WHEN c % 5 = 0 THEN '-' ELSE '+' END AS orientation FROM (SELECT DISTINCT o_orderkey % 400 AS c FROM {orders}) x
    """,
    "agp_new": """
        SELECT concat('Chr', cast(1 + c % 4 AS varchar(8))) AS chrom, (99 - cast(floor(c/4) AS bigint))*10000 + 1 AS start, (100 - cast(floor(c/4) AS bigint))*10000 AS stop,
          100 - cast(floor(c/4) AS bigint) AS number, 'W' AS type, concat('ctg', cast(c AS varchar(8))) AS id, cast(1 AS bigint) AS tig_start, cast(10000 AS bigint) AS tig_stop,
          CASE WHEN c % 3 = 0 THEN '-' ELSE '+' END AS orientation FROM (SELECT DISTINCT o_orderkey % 400 AS c FROM {orders}) x WHERE c % 37 <> 0
    """,
    "variants": """
        SELECT concat('Chr', cast(1 + (o_custkey % 4) AS varchar(8))) AS chrom, (o_orderkey*6367) % 1000000 + 1 AS pos,
          CASE WHEN o_orderkey % 11 = 0 THEN 'AT' ELSE 'A' END AS ref, CASE WHEN o_orderkey % 13 = 0 THEN 'GC' ELSE 'G' END AS alt,
          concat('AC=1;DP=', cast((o_orderkey*17) % 60 AS varchar(8))) AS info,
          concat(CASE o_orderkey % 4 WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' ELSE './.' END, ':9') AS sample FROM {orders}
    """,
    "blast6": """
        SELECT concat('G', cast(l_partkey AS varchar(12))) AS qseqid, concat('G', cast((l_partkey*7 + l_linenumber - 1) % 200 AS varchar(12))) AS sseqid,
          cast(30 + (l_orderkey*13) % 71 AS double) AS identity, cast(50 + (l_orderkey*29) % 500 AS bigint) AS length,
          cast((l_orderkey*41) % 1000 AS double) AS bitscore FROM {lineitem}
    """,
    "gmap_pairs": """
        SELECT concat('R', cast(p_partkey % 50 AS varchar(8))) AS ref_gene,
          concat(CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END, '|', 'G', cast(p_partkey AS varchar(12))) AS gene FROM {part}
    """,
    "tandem": """
        SELECT concat('G', cast(p_partkey AS varchar(12))) AS gene1, concat('G', cast(p_partkey + 1 AS varchar(12))) AS gene2 FROM {part} WHERE p_partkey % 9 = 0
    """,
    "expression": """
        SELECT concat('G', cast(c_custkey AS varchar(12))) AS gene_a, concat('H', cast(c_custkey AS varchar(12))) AS gene_b,
          cast((c_custkey*31) % 97 AS double) AS a1, cast((c_custkey*31) % 97 + (c_custkey*7) % 5 AS double) AS a2, cast((c_custkey*31) % 97 + (c_custkey*11) % 7 AS double) AS a3,
          cast((c_custkey*17) % 89 AS double) AS b1, cast((c_custkey*17) % 89 + (c_custkey*5) % 6 AS double) AS b2, cast((c_custkey*17) % 89 + (c_custkey*3) % 4 AS double) AS b3 FROM {customer}
    """,
    "alignments": """
        SELECT l_orderkey*8 + l_linenumber AS read_id, concat('ctg', cast((l_partkey*3) % 400 AS varchar(8))) AS ref1, (l_orderkey*7919) % 10000 AS p1,
          concat('ctg', cast((l_suppkey*5 + l_partkey) % 400 AS varchar(8))) AS ref2, (l_orderkey*104729 + l_linenumber) % 10000 AS p2,
          cast((l_orderkey*3) % 61 AS bigint) AS mapq, l_linenumber % 2 = 1 AS is_read1, l_orderkey % 23 = 0 AS is_unmapped FROM {lineitem}
    """,
    "gff": """
        SELECT concat('Chr', cast(1 + (p_partkey % 4) AS varchar(8))) AS chrom, k AS level, CASE k WHEN 0 THEN 'gene' WHEN 1 THEN 'mRNA' ELSE 'CDS' END AS type,
  (p_partkey*9973) % 990000 + 1 + CASE WHEN k = 3 THEN 300 ELSE 0 END AS start,
  (p_partkey*9973) % 990000 + CASE k WHEN 2 THEN 200 WHEN 3 THEN 450 ELSE 500 + p_size*100 END AS stop,
  CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand,
  CASE k WHEN 0 THEN concat('ID=G', cast(p_partkey AS varchar(12)), ';Name=N', cast(p_size AS varchar(12)))
    WHEN 1 THEN concat('ID=G', cast(p_partkey AS varchar(12)), '.t1;Parent=G', cast(p_partkey AS varchar(12)))
    ELSE concat('ID=C', cast(p_partkey*4 + k AS varchar(12)), ';Parent=G', cast(p_partkey AS varchar(12)), '.t1') END AS attributes
  FROM {part} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) levels
    """,
    "sequences": """
        SELECT concat('S', cast(doc_id AS varchar(12))) AS chrom, translate(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'BDEFHIJKLMOPQRSUVWXYZ ', 'ACGTACGTACGTACGTACGTNN') AS seq FROM {documents}
    """,
    "pixels": """
        SELECT chr1 AS chrom, least(b1, b2) AS bin1, greatest(b1, b2) AS bin2, count(*) AS n FROM (
  SELECT chr1, cast(floor(pos1/20000) AS bigint) AS b1, cast(floor(pos2/20000) AS bigint) AS b2 FROM {valid_pairs} WHERE chr1 = chr2) x GROUP BY 1, 2, 3
    """,
    "genome_pixels": """
        SELECT least(b1, b2) AS bin1, greatest(b1, b2) AS bin2, count(*) AS n FROM (
  SELECT (cast(substring(chr1, 4, 4) AS bigint) - 1)*50 + cast(floor(pos1/20000) AS bigint) AS b1, (cast(substring(chr2, 4, 4) AS bigint) - 1)*50 + cast(floor(pos2/20000) AS bigint) AS b2
  FROM {valid_pairs}) x GROUP BY 1, 2
    """,
    "alleles": """
        SELECT ref_gene AS allele_id, substring(gene, 1, 1) AS slot, substring(gene, 3, 20) AS gene FROM {gmap_pairs}
    """,
    "contigs": """
        SELECT concat('ctg', cast(c AS varchar(8))) AS id, 'g' || cast(c % 7 AS varchar(8)) AS grp, 10 + c % 90 AS re_sites, 1000*(1 + c % 50) AS length FROM (SELECT DISTINCT o_orderkey % 400 AS c FROM {orders}) x
    """,
    "allele_contigs": """
        SELECT 'Chr' || cast(1 + p_partkey % 4 AS varchar(8)) AS chrom, 'G' || cast(p_partkey AS varchar(12)) AS gene, k AS nth, 'ctg' || cast((p_partkey*7 + k*13) % 400 AS varchar(8)) AS contig
  FROM {part} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks
    """,
    "hap_links": """
        SELECT concat('G', cast(p AS varchar(12))) AS gene1, concat('G', cast(q AS varchar(12))) AS gene2, substring('ABCD', 1 + cast(p % 4 AS integer), 1) AS hap1,
          substring('ABCD', 1 + cast(q % 4 AS integer), 1) AS hap2, p*4 + k AS line_no,
          CASE WHEN p % 4 = q % 4 THEN 'intra' WHEN (p + k) % 7 = 0 THEN 'elsewhere' WHEN (p + k) % 5 = 0 THEN 'tandem' ELSE 'homolog' END AS kind
        FROM (SELECT p_partkey AS p, k, cast(floor(p_partkey/6) AS bigint)*6 + (p_partkey*5 + p_size + 2*k) % 6 + CASE WHEN p_size % 25 = 0 THEN 6 ELSE 0 END AS q
          FROM {part} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks) x WHERE p <> q
    """,
    "allele_cells": """
        SELECT allele_id, CASE WHEN r = 1 THEN slot END AS hap, gene, CASE WHEN r > 1 THEN cast(row_number() OVER (PARTITION BY allele_id, r > 1 ORDER BY slot, gene) AS bigint) END AS nth
        FROM (SELECT allele_id, slot, gene, row_number() OVER (PARTITION BY allele_id, slot ORDER BY gene) AS r FROM (SELECT DISTINCT allele_id, slot, gene FROM {alleles} WHERE cast(floor(cast(substring(gene, 2, 12) AS bigint)/6) AS bigint) % 5 <> 0) d) x
    """,
    "allele_cells2": """
        SELECT concat('R', cast(p_partkey % 80 AS varchar(8))) AS allele_id, cast(NULL AS varchar(1)) AS hap, concat('G', cast(p_partkey AS varchar(12))) AS gene, cast(floor(p_partkey/80) AS bigint) + 1 AS nth FROM {part} WHERE p_partkey % 3 = 0
    """,
    "hap_of_gene": """
        SELECT concat('G', cast(p_partkey AS varchar(12))) AS gene, substring('ABCD', 1 + cast(p_partkey % 4 AS integer), 1) AS hap FROM {part}
    """,
    "gene_pc1": """
        SELECT concat('G', cast(p_partkey AS varchar(12))) AS gene, concat('Chr', cast(1 + (p_partkey % 4) AS varchar(8))) AS chrom, (p_partkey*9973) % 990000 AS start,
  cast((p_partkey*37) % 201 - 100 AS double)/cast(100 AS double) AS v1, cast((p_partkey*53) % 201 - 100 AS double)/cast(100 AS double) AS v2 FROM {part}
    """,
}


def _names(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


@functools.lru_cache(maxsize=256)
def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the folder, as a DataFrame; its text is parsed once a session."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in set(_names(VIEWS[name]))})


def oracle(sql: str) -> str:
    """SQL over views in braces as one statement over the raw tables."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _names(text):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    rest = plain(sql).strip()
    ctes = ", ".join(f"{n} AS ({plain(VIEWS[n]).strip()})" for n in order)
    if not ctes:
        return rest
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {rest[15:]}"
    return f"WITH {ctes}, {rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {ctes} {rest}"
