"""Runs over a corpus that can break off and go on.

A ledger is a folder of published batches for each policy. A batch is written beside it and appears by a rename, whole or not at
all. What a batch publishes carries the hash of each input, so a run that starts again leaves out every input whose hash is
published under its policy: a changed text or another policy is new work, the rest is not done twice. What a run that broke off had not
published is removed by the next one. One run at a time writes to a ledger.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.stored import forget, remove, stored

OPEN = "_open"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def publish(rows: DataFrame, path: str, policy_sha256: str) -> None:
    """Writes a batch and renames it into the ledger."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{path}/{OPEN}/{name}")
    store, folder = _place(spark, f"{path}/{policy_sha256}")
    store.mkdirs(folder)
    if not store.rename(_place(spark, f"{path}/{OPEN}/{name}")[1], _place(spark, f"{path}/{policy_sha256}/{name}")[1]):
        raise OSError(f"a batch could not be published: {path}/{policy_sha256}/{name}")


def published(spark: SparkSession, path: str, policy_sha256: str) -> DataFrame | None:
    """All that a policy's batches hold; None before the first one."""
    store, folder = _place(spark, f"{path}/{policy_sha256}")
    if not store.exists(folder) or not len(store.listStatus(folder)):
        return None
    return spark.read.parquet(f"{path}/{policy_sha256}/*")


def pending(inputs: DataFrame, path: str, policy_sha256: str) -> DataFrame:
    """The inputs whose ``input_sha256`` no batch of the policy holds."""
    done = published(inputs.sparkSession, path, policy_sha256)
    return inputs if done is None else inputs.join(done.select("input_sha256").distinct(), "input_sha256", "left_anti")


def run(inputs: DataFrame, path: str, policy_sha256: str, work: Callable[[DataFrame], DataFrame], batch: Column, most: int | None = None) -> int:
    """Works on what is pending, a batch at a time in the order of ``batch``, and says how many batches it published. ``work`` gets
    a batch's rows and returns rows with ``input_sha256`` for each of them; an input without a row stays pending. ``most``: batches of this run."""
    spark = inputs.sparkSession
    remove(spark, f"{path}/{OPEN}")
    todo = stored(pending(inputs, path, policy_sha256).withColumn("__batch", batch))
    numbers = sorted(r[0] for r in todo.select("__batch").distinct().collect())  # a number for each batch
    for number in numbers[:most]:
        publish(work(todo.where(F.col("__batch") == number).drop("__batch")), path, policy_sha256)
    forget(todo)
    return len(numbers[:most])


def outputs(inputs: DataFrame, path: str, policy_sha256: str) -> DataFrame:
    """What the ledger holds for the inputs as they are now. An input that is still pending stops the query."""
    done = published(inputs.sparkSession, path, policy_sha256)
    if done is None:
        raise ValueError("nothing is published under this policy")
    rows = inputs.select("input_sha256").distinct().join(done.withColumn("__done", F.lit(True)), "input_sha256", "left")
    lost = F.when(F.col("__done").isNull(), F.raise_error(F.concat(F.lit("an input is still pending: "), F.coalesce("input_sha256", F.lit("?")))).cast("boolean"))
    return rows.where(lost.otherwise(True)).drop("__done")
