"""State that jobs share, and connected components of an edge list; nothing but counts reaches the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares into which each node's edges are dealt when they meet its parent, so that no task gets all edges of a hub.
SHARES = 8


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder. Only a local master may go without one: it gets a folder of its own."""
    try:
        shared = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # noqa: BLE001  an unset key raises
        shared = None
    if not shared:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="strandframe-")
        spark.sparkContext.setCheckpointDir(shared)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder, so that later reads survive lost executors. What is read back has the
    size of its files, by which Spark may choose its joins, and nothing of the plan that made it."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_one(rows: DataFrame, ones: DataFrame, key: str, how: str = "inner", by: str | None = None, shares: int = SHARES, wide: bool = False) -> DataFrame:
    """rows joined with a table of one row a key. A frequent key's rows are dealt, by hashes of column `by`, into so many
    tasks, and the one row goes to each of them. wide: the table is shuffled, however small its files are. Of files of short names,
    well packed, Spark would broadcast millions of rows, copies included, through the driver."""
    dealt = rows.withColumn("__share", F.pmod(F.xxhash64(by or F.struct(*rows.columns), F.lit(29)), F.lit(shares)).cast("int"))
    copies = ones.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return dealt.join(copies.hint("merge") if wide else copies, [key, "__share"], how).drop("__share")


def components(edges: DataFrame, wide: bool = False) -> DataFrame:
    """(node, label) of every node of an edge; label is one node of its component. edges: (a, b) of one orderable type.

    In each round every node points to the smallest of itself and its neighbours, and edges are redrawn between those.
    Only nodes smaller than all their neighbours remain, so the edges vanish after a few rounds. Nodes without an edge to
    another node are not in the result. wide: see join_one.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    edges = checkpointed(edges)
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        parent = checkpointed(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("parent")))
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("label"))
        else:
            moved = join_one(labels, parent.select(F.col("node").alias("label"), "parent"), "label", "left", "node", wide=wide)
            labels = checkpointed(moved.select("node", F.coalesce("parent", "label").alias("label")))
        to_a, to_b = (parent.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab")
        moved = join_one(join_one(edges, to_a, "a", by="b", wide=wide), to_b, "b", by="a", wide=wide)
        edges = moved.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).where(F.col("a") != F.col("b")).distinct()
        edges = checkpointed(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels
