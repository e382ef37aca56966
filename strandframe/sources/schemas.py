"""Column types of the text formats that are read. Interval ends are called ``stop``."""

#: Format to DDL schema, in the files' column order.
SCHEMAS: dict[str, str] = {
    "bed4": "chrom string, start long, stop long, gene string",
    "bed6": "chrom string, start long, stop long, name string, score string, strand string",
    "bedgraph": "chrom string, start long, stop long, score double",
    "bg5": "chrom string, start long, stop long, pca1 double, score double",
    "gff": "chrom string, source string, type string, start long, stop long, score string, strand string, phase string, attributes string",
    "vcf": "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string, format string, sample string",
    "valid_pairs": "read_id string, chr1 string, pos1 long, strand1 string, chr2 string, pos2 long, strand2 string, frag_size long, site1 string, site2 string",
    "blast6": "qseqid string, sseqid string, identity double, length long, mismatch long, gap long, qstart long, qend long, sstart long, send long, evalue double, bitscore double",
    "tad": "chrom string, start long, stop long, level int",
    "link": "chrom1 string, start1 long, stop1 long, chrom2 string, start2 long, stop2 long, gene1 string, gene2 string",
    "mcscanx_gff": "chrom string, gene string, start long, stop long",
    "sparse_matrix": "bin1 long, bin2 long, n double",
    "chrom_sizes": "chrom string, size long",
    "rename_list": "old string, new string",
    "fragments": "chrom string, start long, stop long, name string, flag string, strand string",
    "mosdepth": "chrom string, start long, stop long, gene string, depth double",
    "stat": "item string, value long",
}
AGP_CONTIG = "chrom string, start long, stop long, number long, type string, id string, tig_start long, tig_stop long, orientation string"
AGP_GAP = "chrom string, start long, stop long, number long, type string, length long, gap_type string, linkage string, evidence string"
