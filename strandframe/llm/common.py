"""Helpers that several text operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpointed, ensure_checkpoint_dir, join_one  # noqa: F401  shared with the operators of this package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Maps A-Z alone; other letters keep their case.
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: Runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


_held: dict = {}
#: Bytes of an array from which the C library asks the system for memory anew each time, and of freed memory that it keeps.
MAPPED, KEPT = 16 << 20, 64 << 20


def reuse_freed_memory() -> None:
    """Makes a Python worker reuse the memory of its short-lived arrays. By default the C library returns each larger one to the
    system at once, and getting fresh pages takes several times as long as the arithmetic."""
    if not _held.get("settled"):
        _held["settled"] = True
        try:
            library = ctypes.CDLL(None)
            library.mallopt(-3, MAPPED)  # M_MMAP_THRESHOLD
            library.mallopt(-1, KEPT)  # M_TRIM_THRESHOLD
        except (AttributeError, OSError):  # another C library
            return


def held(name: object, make):
    """What a Python worker keeps between tasks under a name. It keeps one thing at a time: workers outlive the jobs of one
    operator, and what each would leave behind adds up."""
    reuse_freed_memory()
    if _held.get("name") != name:
        if "name" in _held:
            _held.update(name=None, value=None)
            _give_back()
        _held.update(name=name, value=make())
    return _held["value"]


def _give_back() -> None:
    """Returns freed memory to the system, as far as its allocators can."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def freed_after(rows: Iterator) -> Iterator:
    """A task's rows; after the last, its Python worker forgets what it keeps between tasks and returns all freed memory. For jobs
    that go on with Spark's joins: workers wait beside those, and the executor's memory is one for both."""
    try:
        yield from rows
    finally:
        _held.pop("name", None)
        _held.pop("value", None)
        _give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own, lengthened where docs has one of that name already."""
    out = []
    for name in names:
        while name.lower() in {c.lower() for c in docs.columns}:
            name += "_"
        out.append(name)
    return out


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def least_count(table: DataFrame, extra: int, most_bytes: int, value: str | None = None) -> int:
    """The least count of words (word, n) for which all words as frequent as that take at most so many bytes: `extra` each, and
    the length of a column if one is named; a power of two, 1 if all words fit. Sums by powers of two reach the driver."""
    size = F.lit(extra).cast("long") + (F.length(value) if value else F.lit(0))
    rows = table.groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("power")).agg(F.sum(size).alias("bytes")).collect()
    held, least = 0, 1 << 62
    for power, size in sorted(((r["power"], r["bytes"]) for r in rows), reverse=True):
        held += size
        if held > most_bytes:
            return least
        least = 1 << power
    return 1
