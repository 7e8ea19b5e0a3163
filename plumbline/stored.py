"""Tables that are read more than once: written to the shared checkpoint folder, their lineage cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A temporary folder takes its place on one machine only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows as written to the shared folder, their lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(*frames: DataFrame) -> None:
    """Deletes the files of stored tables that no plan reads any more."""
    for df in frames:
        held = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if held.isDefined():
            remove(df.sparkSession, held.get())


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of one's own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
