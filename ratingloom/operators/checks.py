"""Guards that fail a query instead of changing its meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assert_none(rows: DataFrame, bad: Column, message: str) -> DataFrame:
    """The rows; reading one for which `bad` holds fails the query."""
    return rows.filter(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))


def assert_bounded(rows: DataFrame, limit: int, message: str) -> DataFrame:
    """The rows; more of them than the limit fail the query. Counted apart, so that no row moves."""
    total = rows.agg(F.count("*").alias("_n"))
    checked = total.select(F.when(F.col("_n") > limit, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True).alias("_ok"))
    return rows.join(F.broadcast(checked), F.col("_ok")).drop("_ok")


def assert_unique(rows: DataFrame, key: list[str], message: str) -> DataFrame:
    """The rows; a repeated key fails the query."""
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    return assert_none(counted, F.col("_n") > 1, message).drop("_n")
