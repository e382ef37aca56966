"""Writers: tab-separated text with a null mark, by chromosome or group where asked, and pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.genes import running_total


def tsv(df: DataFrame, path: str, header: bool = False, null: str = ".", by: list[str] = []) -> None:  # noqa: B006
    flat = df.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    w = flat.write.option("sep", "\t").option("header", header).option("nullValue", null).option("emptyValue", "")
    (w.partitionBy(*by) if by else w).csv(path)


def _record(name: Column, seq: Column, width: int) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"))


def fasta(sequences: DataFrame, path: str, width: int = 60, by: str | None = None) -> None:
    """(chrom, seq) as FASTA, one folder a group if by is given."""
    lines = _record(F.col("chrom"), F.col("seq"), width).alias("value")
    rows = sequences.select(lines, *([by] if by else []))
    (rows.write.partitionBy(by) if by else rows.write).text(path)


def pixels(bins: DataFrame, pixels: DataFrame, path: str) -> None:
    """A contact matrix as two tables."""
    bins.write.parquet(f"{path}/bins")
    pixels.write.parquet(f"{path}/pixels")


def parts(lines: DataFrame, path: str, part: str = "part", order: str = "line_no", value: str = "value") -> None:
    """One text file a part, in a folder part=N, its lines in order. A part is written by one task, as one file must be; parts are dealt
    out over all tasks. A value may hold several lines."""
    rows = lines.select(part, order, value).repartition(part).sortWithinPartitions(part, order)
    rows.select(part, value).write.partitionBy(part).text(path)


def fastq_parts(reads: DataFrame, path: str, n: int) -> None:
    """Reads (read_no from 0, name, seq, quality) as FASTQ files of n reads each, in order."""
    value = F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "quality").alias("value")
    parts(reads.select(F.floor(F.col("read_no") / n).cast("long").alias("part"), F.col("read_no").alias("line_no"), value), path)


def fasta_parts(sequences: DataFrame, path: str, target: int, width: int = 60) -> None:
    """Sequences (line_no, chrom, seq) as FASTA files of about `target` bases: a sequence goes to the file that the bases before it have reached."""
    rows = running_total(sequences.withColumn("__length", F.length("seq").cast("long")), "__length")
    part = F.floor((F.col("total") - F.col("__length")) / target).cast("long").alias("part")
    parts(rows.select(part, "line_no", _record(F.col("chrom"), F.col("seq"), width).alias("value")), path)


def fasta_of_groups(agp: DataFrame, contigs: DataFrame, path: str, width: int = 60) -> None:
    """Contigs (chrom: their name, seq) of an AGP's sequence rows (chrom, number, type, id), one FASTA file for each object, in its order."""
    rows = agp.where("type = 'W'").select(F.col("chrom").alias("part"), F.col("number").alias("line_no"), "id").join(contigs.select(F.col("chrom").alias("id"), "seq"), "id")
    parts(rows.select("part", "line_no", _record(F.col("id"), F.col("seq"), width).alias("value")), path)
