"""What the ten operators share: the checkpoint folder, batch bounds, skew-safe lookups."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python, so that long texts do not pile up in a worker.
BATCH_BYTES = "8m"


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches, fixes how scans are split, and sees that checkpoints have a folder.

    The least number of splits of a scan follows the number of cores at the moment; fixing it for
    the session gives a row the same number in each scan, also after an executor is lost.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``. Only on one machine
    (tests, a laptop) a temporary one is made where that is unset; on a cluster that is an error, as
    executors do not share a local folder.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, BATCH_BYTES)
    context = spark.sparkContext
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(context.defaultParallelism))
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and forgets how they were made."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def done(*frames: DataFrame) -> None:
    """Deletes the files of tables made by ``cut`` that nothing reads any more."""
    for df in frames:
        held = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if held.isDefined():
            delete(df.sparkSession, held.get())


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the checkpoints."""
    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def smallest_by_hash(df: DataFrame, key: str, size: int, total: int) -> DataFrame:
    """The ``size`` rows with the smallest hash of ``key``, of ``total`` rows. Only rows below a bound
    that about ``size`` rows pass are sorted, so what a sort hands to the driver does not grow."""
    order = F.xxhash64(key)
    share = (size + 12 * size**0.5 + 100) / max(1, total)
    if share < 1:
        df = df.where(order <= int(-(2**63) + share * 2**64))
    return df.orderBy(order, key).limit(size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str = "doc_id"):
    """crc32 of an id written as decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Labels the nodes of a graph with the smallest node that they reach.

    ``edges`` has long columns ``a`` and ``b``; the result has ``node`` and ``root`` for each
    node that has an edge to another one. Large-star and small-star steps alternate until
    nothing changes, so the number of rounds grows with the logarithm of the longest chain.
    Each side of a join is a written table; adaptive execution splits the hubs. Nothing is
    gathered on the driver but two numbers a round.
    """
    def measure(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return tuple(row)

    pairs = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = measure(pairs)
    # files of some size: a round's tables are about as large as the first one
    parts = min(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), before[0] // 20_000 + 1)
    while before[0]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts))
        large = cut(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(parts)
        )
        lower = cut(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts))
        joined = large.join(lower, "u")
        new = cut(
            joined.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(lower.select("u", F.col("m").alias("v")))
            .distinct()
            .coalesce(parts)
        )
        done(pairs, low, large, lower)
        pairs, after = new, measure(new)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    labels = cut(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots))
    done(pairs)
    return labels
