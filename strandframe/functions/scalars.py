"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_id(chrom: Column, start: Column, stop: Column) -> Column:
    """chrom:start-stop"""
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), stop.cast("string"))


def parse_range_id(text: Column) -> Column:
    """(chrom, start, stop) of chrom:start-stop; nulls where a text is no such range."""
    part = lambda k: F.regexp_extract(text, r"^(.+):(\d+)-(\d+)$", k)
    ok = text.rlike(r"^.+:\d+-\d+$")
    return F.struct(F.when(ok, part(1)).alias("chrom"), F.when(ok, part(2)).cast("long").alias("start"), F.when(ok, part(3)).cast("long").alias("stop"))


def size_label(size: Column, kilo: float = 1e3, mega: float = 4e5) -> Column:
    """bp up to kilo, Kbp (whole) up to mega, Mbp beyond, to one decimal as C's printf rounds it: by the double's exact value, where
    Java's goes by its shortest digits."""
    return (
        F.when(size <= kilo, F.concat(size.cast("long").cast("string"), F.lit(" bp")))
        .when(size <= mega, F.concat(F.floor(size / 1000).cast("long").cast("string"), F.lit(" Kbp")))
        .otherwise(F.concat(F.call_function("format_number", size.cast("double") / 1e6, F.lit("0.0")), F.lit(" Mbp")))
    )


def bin_size(text: Column) -> Column:
    """100K, 1.5M, 2g or plain digits as a number of bases; null otherwise."""
    number, unit = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)([KkMmGg]?)$", 1), F.upper(F.regexp_extract(text, r"^(\d+(?:\.\d+)?)([KkMmGg]?)$", 2))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "G", 1e9).otherwise(1.0)
    return F.when(number != "", (number.cast("double") * scale).cast("long"))


def compartment(value: Column, zero_as: str = "A") -> Column:
    """A above zero, B below; zero is A, B or dropped (null), as the caller's convention is."""
    zero = {"A": F.lit("A"), "B": F.lit("B"), "drop": F.lit(None).cast("string")}[zero_as]
    return F.when(value > 0, "A").when(value < 0, "B").when(value == 0, zero)


def switch_type(first: Column, second: Column, zero_as: str = "B") -> Column:
    """AA, AB, BA or BB."""
    return F.concat(compartment(first, zero_as), compartment(second, zero_as))


def is_conserved(first: Column, second: Column) -> Column:
    """Whether two values have one sign; zero has that of whichever the other has."""
    return first * second >= 0


def haplotype(gene: Column) -> Column:
    """What stands before the bar of a gene's name; null without a bar."""
    return F.when(F.instr(gene, "|") > 0, F.split(gene, r"\|")[0])


def strand_flag(strand: Column) -> Column:
    """0 for +, 16 for anything else."""
    return F.when(strand == "+", 0).otherwise(16)


def gc_percent(seq: Column) -> Column:
    """Percent of G and C among bases that are not N; -1 for a sequence of N alone, and for an empty one."""
    n = F.length(seq)
    known = n - (n - F.length(F.regexp_replace(seq, "[Nn]", "")))
    gc = n - F.length(F.regexp_replace(seq, "[GCgc]", ""))
    return F.when(known > 0, gc.cast("double") * 100 / known).otherwise(F.lit(-1.0))


def attribute(attributes: Column, key: str) -> Column:
    """A value of key=value;key=value; null without the key."""
    return F.str_to_map(attributes, F.lit(";"), F.lit("="))[key]


def percent_text(part: Column, whole: Column) -> Column:
    """Two decimals and a percent sign."""
    return F.concat(F.format_string("%.2f", part.cast("double") * 100 / whole), F.lit("%"))


def trailing_number(name: Column) -> Column:
    """The number that a name ends with, for sorting Chr2 before Chr10."""
    return F.regexp_extract(name, r"(\d+)$", 1).try_cast("long")
