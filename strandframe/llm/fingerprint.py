"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions alone.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, so sketches of
texts of any size share one threshold: their union is the sketch of the union (``merge``), and the
share of one text's sketch found in another's estimates its containment however unequal they are.
A text none of whose hashes is below the threshold keeps its smallest hash alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words in a shingle.
WORDS = 5
#: One hash in SCALE is kept, on average.
SCALE = 8
#: Documents in a bucket of neighbouring ids, and buckets up to which their ids may be broadcast (24 bytes each).
BUCKET_ROWS, BROADCAST_BUCKETS = 4096, 100_000
#: Parts into which quantiles cut the ids.
CUTS = 128
MAX_HASH = 2**63 - 1


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """63-bit hashes of all shingles of a text; one of all its words if they are fewer. Null and blank: none."""
    w = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda x: x != "")

    def hashed(w: Column) -> Column:
        full = F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(words)]).bitwiseAND(F.lit(MAX_HASH)))
        short = F.array(F.xxhash64(F.concat_ws(" ", w)).bitwiseAND(F.lit(MAX_HASH)))
        return F.when(F.size(w) >= words, full).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))

    # The words are bound once, as the variable of a one-element transform.
    return F.flatten(F.transform(F.array(w), hashed))


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """The sorted sketch of a text: array<bigint>."""

    def kept(h: Column) -> Column:
        low = F.filter(h, lambda x: x < F.lit(MAX_HASH // scale))
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.transform(F.array(shingle_hashes(text, words)), kept))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts together, from theirs."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda x: x < F.lit(MAX_HASH // scale))
    return F.when(F.size(low) > 0, F.array_sort(low)).when(F.size(both) > 0, F.array(F.array_min(both))).otherwise(both)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)).cast("double") / F.size(a)).otherwise(F.lit(1.0))


def as_text(a: Column) -> Column:
    """A sketch as comma-joined hexadecimal hashes."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.hex(x))), ",")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp): each document beside the next in descending doc_id; after the last comes the first.

    Quantiles of the ids cut them into CUTS parts, however the ids are spread, and each part into ranges of equal width, each of
    which is sorted by itself, so texts are shuffled once and no task sees more than its ranges. The first document of each
    range is also what follows the last of the range above it; those few are read once more by their ids. Rows of equal
    doc_id follow in order of text, null ids come last.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts, low, high, n = docs.agg(F.percentile_approx("doc_id", [k / CUTS for k in range(1, CUTS)], 10_000), F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    starts = sorted({low or 0, *(cuts or [])})
    ranges = max(1, -(-n // (BUCKET_ROWS * CUTS)))
    buckets = ranges * len(starts)
    widths = [max(1, -(-(b - a) // ranges)) for a, b in zip(starts, [*starts[1:], (high or 0) + 1], strict=True)]
    part = F.size(F.filter(F.array(*map(F.lit, starts)), lambda x: x <= F.col("doc_id")))
    one = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("part"))
    docs = docs.withColumn("part", part).withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise((F.col("part") - 1) * ranges + F.floor((F.col("doc_id") - one(starts)) / one(widths)))).drop("part")

    # One row a range: its highest id, and the range above, whose last document it follows; the highest follows the lowest.
    tops = docs.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    w = Window.orderBy(F.desc("bucket"))
    tops = tops.select("top", F.lag("bucket").over(w).alias("above"), F.min("bucket").over(Window.partitionBy()).alias("lowest"))
    tops = tops.select("top", F.coalesce("above", "lowest").alias("bucket"))
    small = F.broadcast(tops) if buckets <= BROADCAST_BUCKETS else tops
    heads = docs.drop("bucket").join(small, F.col("doc_id").eqNullSafe(F.col("top")))
    heads = heads.groupBy("bucket").agg(F.min("text").alias("head_text")).withColumn("head_fp", sketch(F.col("head_text")))

    w = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.col("text"))
    rows = docs.withColumn("fp", sketch(F.col("text"))).select("*", F.lead("text").over(w).alias("lead_text"), F.lead("fp").over(w).alias("lead_fp"))
    rows = rows.join(heads, "bucket", "left")
    return rows.select(
        "doc_id", "text", "fp",
        F.coalesce("lead_text", "head_text").alias("next_text"),
        F.when(F.col("lead_text").isNotNull(), F.col("lead_fp")).otherwise(F.col("head_fp")).alias("next_fp"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, whose second half the next document's beginning replaces.

    Null texts count as empty; empty texts have an empty fingerprint, alike to each other. A table of one document has
    itself as next. Repeated rows give repeated rows. Other columns of docs are ignored.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.select("doc_id", "n_chars", "fp", "next_fp", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_fp"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        containment(F.col("edited_fp"), F.col("fp")).alias("edited_in_text"), containment(F.col("next_fp"), F.col("fp")).alias("next_in_text"),
    )
