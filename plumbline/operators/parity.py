"""Comparing renderings, runs and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_difference(left: DataFrame, right: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """One row: ``equal`` and the first position at which two sequences differ (null if none)."""
    a = left.select(position, F.struct(*columns).alias("a"))
    b = right.select(position, F.struct(*columns).alias("b"))
    same = F.col("a").eqNullSafe(F.col("b"))
    return a.join(b, position, "full").agg(F.bool_and(same).alias("equal"), F.min(F.when(~same, F.col(position))).alias("first_difference")).select(F.coalesce("equal", F.lit(True)).alias("equal"), "first_difference")


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with ``side``."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def projected_equal(left: DataFrame, right: DataFrame, key: str, excluded: list[str]) -> DataFrame:
    """``key, equal`` of rows compared without the columns that a comparison excludes by name."""
    columns = [c for c in left.columns if c not in {key, *excluded}]
    a, b = left.select(key, F.struct(*columns).alias("a")), right.select(key, F.struct(*columns).alias("b"))
    return a.join(b, key, "full").select(key, F.col("a").eqNullSafe(F.col("b")).alias("equal"))


def foreign_keys(json: str, allowed: list[str]):
    """Keys of a JSON object that are not allowed, and whether any allowed key lacks."""
    keys = F.json_object_keys(F.col(json))
    names = F.array(*map(F.lit, allowed))
    return F.array_except(keys, names), F.array_except(names, keys)
