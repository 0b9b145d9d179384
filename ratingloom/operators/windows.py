"""Windows, ordering, paging and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def last_n(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key. Spark keeps n a group before the shuffle, so a hot key moves n rows from each task."""
    by = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= n).drop("_n")


def repeats(value: str, key: list[str], order: list[str]) -> Column:
    """Whether a row's value is that of the row before."""
    return F.coalesce(F.col(value) == F.lag(value).over(Window.partitionBy(*key).orderBy(*order)), F.lit(False))


def request_place(column: str, asked: Column) -> Column:
    """Place in the request, from 1; what was not asked for comes after all that was."""
    place = F.array_position(asked, F.col(column))
    return F.when(place > 0, place).otherwise(F.size(asked) + 1).cast("int")


def numeric_first(column: str) -> list[Column]:
    """Order of ids: by number where they are numbers, then by text."""
    number = F.when(F.col(column).rlike(r"^\d{1,18}$"), F.col(column).cast("long"))
    return [number.asc_nulls_last(), F.col(column)]


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """`limit` rows (1 to 250) from an offset, with the total of all."""
    if not 1 <= limit <= 250 or offset < 0:
        raise ValueError("a page has 1 to 250 rows, from an offset of 0 or more")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(offset + limit).orderBy(*order).offset(offset).crossJoin(F.broadcast(total))


def longest_first(names: Column) -> Column:
    """Names by length, longest first, then by text."""
    keyed = F.transform(names, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def pivot_months(rows: DataFrame, key: list[str], month: str, months: list[str], metrics: list[str]) -> DataFrame:
    """A column for each month and metric. The months are given, so nothing is read twice to find them."""
    return rows.groupBy(*key).pivot(month, months).agg(*[F.max(m).alias(m) for m in metrics])


def unpivot_months(wide: DataFrame, key: list[str], months: list[str], metrics: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("month"), *[F.col(f"`{m}_{x}`").alias(x) for x in metrics]) for m in months])
    return wide.select(*key, F.explode(pairs).alias("_p")).select(*key, "_p.*")


def with_sections(rows: DataFrame, section: str, item: str) -> DataFrame:
    """Section headers with counts (level 0) above their rows (level 1)."""
    heads = rows.groupBy(section).agg(F.count("*").alias("n")).select(section, F.lit(0).alias("level"), F.lit(None).cast("string").alias(item), "n")
    return heads.union(rows.select(section, F.lit(1).alias("level"), item, F.lit(1).cast("long").alias("n")))


def dense(cells: DataFrame, row: str, column: str, width: int, values: list[str]) -> DataFrame:
    """Every cell of each row from column 1 to width; null where none was given."""
    grid = cells.select(row).distinct().withColumn(column, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(width).cast("long"))))
    return grid.join(cells.select(row, column, *values), [row, column], "left")
