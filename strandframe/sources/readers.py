"""Readers of genomic text formats: tab-separated, without header. Files that end in .gz are unzipped as they are read, one task a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import SCHEMAS


def tsv(spark: SparkSession, path: str | list[str], schema: str, null: str = ".", comment: str | None = "#", header: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    reader = spark.read.option("sep", "\t").option("nullValue", null).option("header", header).option("mode", mode)
    if comment:
        reader = reader.option("comment", comment)
    return reader.schema(schema).csv(path)


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A file of a kind that SCHEMAS names."""
    return tsv(spark, path, SCHEMAS[kind])


def bed(spark: SparkSession, path: str, in_order: bool = False) -> DataFrame:
    rows = read(spark, path, "bed6")
    return rows.orderBy("chrom", "start") if in_order else rows


def gff(spark: SparkSession, path: str, feature: str | None = None) -> DataFrame:
    rows = read(spark, path, "gff")
    return rows.where(F.col("type") == feature) if feature else rows


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants of one sample; rows with a null go."""
    return read(spark, path, "vcf").dropna()


def blast(spark: SparkSession, path: str, keep_self: bool = False, only_ids: bool = False) -> DataFrame:
    rows = read(spark, path, "blast6")
    rows = rows if keep_self else rows.where("qseqid <> sseqid")
    return rows.select("qseqid", "sseqid") if only_ids else rows


def agp(spark: SparkSession, path: str, gap: str = "U") -> tuple[DataFrame, DataFrame]:
    """(contig rows, gap rows)"""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(*[f[k].alias(f"c{k}") for k in range(9)])
    long = lambda k, name: F.col(f"c{k}").cast("long").alias(name)
    first = [F.col("c0").alias("chrom"), long(1, "start"), long(2, "stop"), long(3, "number"), F.col("c4").alias("type")]
    placed = rows.where(F.col("c4") != gap).select(*first, F.col("c5").alias("id"), long(6, "tig_start"), long(7, "tig_stop"), F.col("c8").alias("orientation"))
    gaps = rows.where(F.col("c4") == gap).select(*first, long(5, "length"), F.col("c6").alias("gap_type"), F.col("c7").alias("linkage"), F.col("c8").alias("evidence"))
    return placed, gaps


def links(spark: SparkSession, path: str, swapped: bool = False) -> DataFrame:
    """Link files of six or eight columns; swapped: the two sides change places."""
    rows = read(spark, path, "link")
    if not swapped:
        return rows
    other = {"1": "2", "2": "1"}
    return rows.select(*[F.col(c[:-1] + other[c[-1]]).alias(c) for c in rows.columns])


def sparse_matrix(spark: SparkSession, path: str) -> DataFrame:
    """bin1, bin2, n from 0 on, whichever the file counts from."""
    rows = read(spark, path, "sparse_matrix")
    low = rows.agg(F.least(F.min("bin1"), F.min("bin2"))).first()[0]
    return rows if not low else rows.withColumns({c: F.col(c) - 1 for c in ("bin1", "bin2")})


def repeats(spark: SparkSession, path: str) -> DataFrame:
    """Repeat annotations in columns parted by blanks; lines that do not begin with a score are headers."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^\d"))
    return rows.select(f[0].cast("long").alias("score"), f[4].alias("chrom"), f[5].cast("long").alias("start"), f[6].cast("long").alias("stop"), f[8].alias("strand"), f[9].alias("name"), f[10].alias("class"), F.try_element_at(f, F.lit(15)).alias("id"))


def fasta(spark: SparkSession, path: str, without: list[str] = []) -> DataFrame:  # noqa: B006
    """(chrom, description, seq); sequences whose names contain one of the parts in `without` are left out.

    Records are parted by a > at the beginning of a line; one within a header is part of it.
    """
    r = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.length(F.trim("value")) > 0)
    head = F.split("value", "\n")[0]
    seq = F.regexp_replace(F.substring("value", F.length(head) + 1, F.length("value")), r"\s", "")
    rows = r.select(F.split(F.trim(head), r"\s+")[0].alias("chrom"), F.trim(head).alias("description"), seq.alias("seq"))
    for part in without:
        rows = rows.where(~F.col("chrom").contains(part))
    return rows


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): the lines of each file, from 0 on, in order.

    Lines are numbered within the blocks that Spark reads, whose lengths are added up first, so a file may be split. The order
    of blocks of a file is that of their starts.
    """
    block, start, value = F.input_file_name(), F.input_file_block_start(), F.col("value")
    rows = spark.read.text(path).select(block.alias("file"), start.alias("start"), value, F.monotonically_increasing_id().alias("__id"))
    low = rows.groupBy("file", "start").agg(F.min("__id").alias("low"), F.count(F.lit(1)).alias("n"))
    # One row a block of a file.
    base = low.select("file", "start", "low", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(base, ["file", "start"]).select("file", (F.col("base") + F.col("__id") - F.col("low")).alias("line_no"), "value")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, read_no, name, seq, quality) of FASTQ files, four lines a read by their number, whatever the qualities begin with."""
    lines = numbered_lines(spark, path).withColumn("read_no", F.floor(F.col("line_no") / 4)).withColumn("__k", F.col("line_no") % 4)
    at = lambda k: F.max(F.when(F.col("__k") == k, F.col("value")))
    reads = lines.groupBy("file", "read_no").agg(at(0).alias("name"), at(1).alias("seq"), at(3).alias("quality")).where("quality is not null")
    return reads.withColumn("name", F.regexp_replace("name", "^@", ""))


def fastq_counts(spark: SparkSession, path: str) -> DataFrame:
    """Reads and bases of FASTQ files: the second of every four lines, by its number; nothing is shuffled but counts of blocks."""
    seq = numbered_lines(spark, path).where("line_no % 4 = 1")
    return seq.agg(F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("bases"))


def collinearity(spark: SparkSession, path: str) -> DataFrame:
    """Gene pairs of a collinearity file: block and order from each row's own number, with what the block's header says of it."""
    row = r"^\s*(\d+)-\s*(\d+):\s+(\S+)\s+(\S+)(?:\s+(\S+))?"
    head = r"^## Alignment (\d+): score=(\S+) e_value=(\S+) N=(\d+) (\S+)&(\S+) (plus|minus)"
    text = spark.read.text(path)
    part = lambda how, k: F.regexp_extract("value", how, k)
    rows = text.where(F.col("value").rlike(row)).select(part(row, 1).cast("long").alias("block"), part(row, 2).cast("long").alias("nth"), part(row, 3).alias("gene1"), part(row, 4).alias("gene2"), part(row, 5).try_cast("double").alias("pair_e_value"))
    heads = text.where(F.col("value").rlike(head)).select(part(head, 1).cast("long").alias("block"), part(head, 2).cast("double").alias("score"), part(head, 3).cast("double").alias("e_value"), part(head, 4).cast("long").alias("pairs"), part(head, 5).alias("chr1"), part(head, 6).alias("chr2"), F.when(part(head, 7) == "plus", "+").otherwise("-").alias("orientation"))
    return rows.join(heads, "block", "left")


def anchors(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, gene1, gene2, score, block) of anchor files; a line that begins with # starts a block, counted from 1."""
    from ..operators.genes import numbered_blocks

    f = F.split("value", r"\s+")
    lines = numbered_blocks(numbered_lines(spark, path), ["file"])
    return lines.where(F.size(f) >= 2).select("file", "line_no", f[0].alias("gene1"), f[1].alias("gene2"), F.try_element_at(f, F.lit(3)).alias("score"), "block")


def contact_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bins, pixels) as writers.pixels stores them."""
    return spark.read.parquet(f"{path}/bins"), spark.read.parquet(f"{path}/pixels")


def rename_list(spark: SparkSession, path: str) -> DataFrame:
    """(old, new), one row an old name; the last line of a name counts."""
    lines = numbered_lines(spark, path).select("line_no", F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 2)
    return lines.groupBy(F.col("f")[0].alias("old")).agg(F.max_by(F.col("f")[1], "line_no").alias("new"))


def tandem(spark: SparkSession, path: str) -> DataFrame:
    """(gene1, gene2) of a comma-separated file."""
    return spark.read.schema("gene1 string, gene2 string").csv(path)


def mcscanx_gff(spark: SparkSession, path: str) -> DataFrame:
    """Genes on chromosomes; those on contigs named tig... go."""
    return read(spark, path, "mcscanx_gff").where(~F.col("chrom").startswith("tig"))


def stat(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Library statistics, one row a sample and a column an item; all files are read at once and told apart by their paths."""
    rows = tsv(spark, list(paths.values()), SCHEMAS["stat"]).withColumn("__file", F.expr("url_decode(input_file_name())"))
    sample = F.coalesce(*[F.when(F.col("__file").endswith(path), F.lit(name)) for name, path in sorted(paths.items(), key=lambda x: -len(x[1]))])
    return rows.withColumn("sample", sample).groupBy("sample").pivot("item").agg(F.first("value"))


def allele_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("nullValue", ".").csv(path)


def allele_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, gene, nth, contig) of rows with as many contigs as they like."""
    f = F.split("value", r"\s+")
    rows = spark.read.text(path).where(F.size(f) > 2)
    return rows.select(f[0].alias("chrom"), f[1].alias("gene"), F.posexplode(F.slice(f, F.lit(3), F.size(f) - 2)).alias("nth", "contig")).where("contig <> ''")


def tour(spark: SparkSession, path: str) -> DataFrame:
    """(nth, contig, orientation) of a tour file's last line, told by the position of lines in the file."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.array(F.element_at(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), -1))).alias("line"))
    return lines.select(F.posexplode(F.split(F.trim("line"), r"\s+")).alias("nth", "c")).select("nth", F.expr("substring(c, 1, length(c) - 1)").alias("contig"), F.expr("substring(c, length(c), 1)").alias("orientation"))


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(grp, nth, contig) of lines group, number, contigs. By contig it is the table of contigs' groups."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(f[0].alias("grp"), F.posexplode(F.split(F.trim(f[2]), r"\s+")).alias("nth", "contig"))


def bad_pairs(spark: SparkSession, path: str, fields: int = 12) -> DataFrame:
    """Lines of a pairs file that do not have the right number of fields."""
    return spark.read.text(path).where(F.size(F.split(F.trim("value"), r"\s+")) != fields)


def renumbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with ``nth``, their number within a key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order)))
