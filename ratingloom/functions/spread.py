"""Work that is dear for each row, over all cores and once for rows that are alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import written_once


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows over all cores by their key: of a table with few bytes a scan makes one task, however dear a row's work is."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys)


def once_each(rows: DataFrame, columns: list[str], work: Callable[[DataFrame], DataFrame], adds: list[str]) -> DataFrame:
    """The rows with the columns that `work` adds, which it works out once for each distinct set of `columns`.

    `work` sees the distinct sets, spread over all cores. The rows are read twice and written first.
    """
    rows = written_once(rows.withColumn("_alike", F.sha2(F.to_json(F.struct(*columns)), 256)), "alike")
    kinds = rows.select("_alike", *columns).dropDuplicates(["_alike"])
    return rows.join(work(spread(kinds, "_alike")).select("_alike", *adds), "_alike").drop("_alike")
