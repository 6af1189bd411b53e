"""Faults put into a table, to see that they are found."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sample_records(spark: SparkSession, n: int) -> DataFrame:
    """n order records with a position."""
    i = F.col("id")
    return spark.range(n).select((i + 1000).cast("string").alias("order_id"), F.lit("1").alias("line_id"), F.concat(F.lit("dec:"), (i + 10).cast("string"), F.lit(".5")).alias("amount"), F.lit("shipped").alias("status"), F.concat(F.lit("ignore-"), i.cast("string")).alias("_meta"), i.alias("pos"))


def drop(df: DataFrame, which: Column) -> DataFrame:
    return df.where(~F.coalesce(which, F.lit(False)))


def duplicate(df: DataFrame, which: Column) -> DataFrame:
    return df.unionByName(df.where(which))


def mutate(df: DataFrame, which: Column, column: str, value: Any) -> DataFrame:
    return df.withColumn(column, F.when(which, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(column)))


def phantom(df: DataFrame, which: Column, column: str, value: Column) -> DataFrame:
    """Copies of some rows under another key."""
    return df.unionByName(df.where(which).withColumn(column, value))
