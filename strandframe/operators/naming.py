"""New names for chromosomes, genes and attribute values, by a list or by a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_list(rows: DataFrame, column: str, names: DataFrame, keep_others: bool = True) -> DataFrame:
    """rows with a column's values replaced by a list (old, new), one row an old name; values not in it stay, or their rows go."""
    listed = names.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    joined = rows.join(listed, F.col(column) == F.col("__old"), "left" if keep_others else "inner")
    return joined.withColumn(column, F.coalesce("__new", F.col(column)) if keep_others else F.col("__new")).select(*rows.columns)


def attribute_by_list(gff: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """GFF rows whose attribute `key` is in a list (old, new), with the new value in its place among the attributes; other rows go."""
    pattern = rf"(^|;)({key}=)([^;]*)"
    value = F.regexp_extract("attributes", pattern, 3)
    listed = names.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    joined = gff.where(F.col("attributes").rlike(pattern)).join(listed, value == F.col("__old"))
    new = F.regexp_replace("__new", r"([\\$])", r"\\$1")
    return joined.withColumn("attributes", F.regexp_replace("attributes", F.lit(pattern), F.concat(F.lit("$1$2"), new))).select(*gff.columns)


def affixed(rows: DataFrame, column: str, prefix: str = "", suffix: str = "") -> DataFrame:
    """rows with a prefix and a suffix at a column's values."""
    return rows.withColumn(column, F.concat(F.lit(prefix), F.col(column), F.lit(suffix)))


def prefixed_by_haplotype(genes: DataFrame, column: str, suffixes: list[str], chrom: str = "chrom") -> DataFrame:
    """genes with A| before the names of those on chromosomes that end in the first suffix, B| for the second, and so on; others stay.
    All suffixes are as long as the first."""
    ends = F.expr(f"right({chrom}, {len(suffixes[0])})")
    letter = F.coalesce(*[F.when(ends == s, F.lit(f"{chr(ord('A') + k)}|")) for k, s in enumerate(suffixes)], F.lit(""))
    return genes.withColumn(column, F.concat(letter, F.col(column)))
