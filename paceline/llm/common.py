"""Helpers that the training-data operators share: staging folders, batches, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.runtime import ship

#: Rows in an Arrow batch handed to Python. Texts can be long, so batches are small.
BATCH_ROWS = 256
#: Shuffle files go when a query ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once by rows and by bytes; send the package to the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder of ``spark.checkpoint.dir``.

    Where the setting is absent and Spark runs within one machine (tests), a temporary folder becomes the
    checkpoint folder of the session. On a cluster its absence is an error: a folder of the driver's machine would be
    out of the executors' sight.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="paceline-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame, codec: str = "zstd", tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing.

    ``tidy`` has Spark remove the shuffle files of this write at its end, rather than at some garbage collection of the driver.
    """
    spark = df.sparkSession
    at = scratch(spark)
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", codec).parquet(at)
    finally:
        if tidy:
            spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(at)


def bytes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``data``, the UTF-8 bytes of the text (null stays null); other columns go."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("data")
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of an undirected graph ``edges(src, dst)`` of longs.

    Alternating large-star and small-star steps; ``component`` is the smallest node reachable.
    Only nodes that have an edge to another node are returned; null ends are no nodes. Each round's edges are written to
    the shared folder, so a lost executor costs one round at most, and nothing but two sums per
    round comes to the driver.
    """
    pairs = staged(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    if pairs.isEmpty():
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        pairs = staged(small.where("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
