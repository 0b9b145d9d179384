"""The monthly report: registry and snapshots as rows, sections, months in columns, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that rows of a section are told apart by before they are numbered.
BEGINNING = 4


def merge_months(snapshots: DataFrame, key: list[str], month: str, requested: str, metrics: list[str], attributes: list[str]) -> DataFrame:
    """One row for each product: attributes of the requested month, or of its last one; first and last month seen.

    Rows that merge keep, for each month, what is known: a null never hides a number.
    """
    newest = F.struct((F.col(month) == requested).alias("asked"), F.col(month).alias("m"))
    return snapshots.groupBy(*key).agg(*[F.max_by(a, newest).alias(a) for a in attributes], F.min(month).alias("first_seen"), F.max(month).alias("last_seen"))


def month_columns(snapshots: DataFrame, key: list[str], month: str, months: list[str], metrics: list[str]) -> DataFrame:
    return snapshots.groupBy(*key).pivot(month, months).agg(*[F.max(m).alias(m) for m in metrics])


def month_totals(snapshots: DataFrame, group: list[str], reviews: str, rating: str, high: Column | None = None) -> DataFrame:
    """Reviews, cards by class (4 and over, below 4, none) and the share of high ones in hundredths of a percent."""
    high = (F.col(rating) >= 400) & (F.col(reviews) > 0)
    low = (F.col(rating) < 400) & (F.col(reviews) > 0)
    none = (F.col(reviews) == 0) & F.col(rating).isNull()
    out = snapshots.groupBy(*group).agg(F.sum(reviews).alias("reviews"), F.count_if(high).alias("high"), F.count_if(low).alias("low"), F.count_if(none).alias("none"))
    return out.withColumn("high_share", F.coalesce(F.expr("(high * 10000) div nullif(high + low + none, 0)"), F.lit(0)))


def report_rows(products: DataFrame, wide: DataFrame, key: list[str], section: str, order: list[str]) -> DataFrame:
    """Rows in print order: each section's header with its count, then its products. `row` numbers them within the section.

    `order` begins with a text. Rows are numbered by its beginning, and shifted by the counts of what begins before, so
    that the largest section is no single task; what meets in one place are counts of beginnings.
    """
    begins = lambda rows: rows.withColumn("_begins", F.coalesce(F.concat(F.lit("1"), F.substring(order[0], 1, BEGINNING)), F.lit("0")))
    counts = begins(products).groupBy(section, "_begins").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(section).orderBy("_begins").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(section, "_begins", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(section, "_begins").orderBy(*order))
    numbered = begins(products.join(wide, key, "left")).withColumn("_inside", inside).join(shifts, [section, "_begins"])
    numbered = numbered.withColumn("row", (F.col("_before") + F.col("_inside")).cast("int")).drop("_begins", "_before", "_inside")
    heads = counts.groupBy(section).agg(F.sum("_n").alias("n_products"))
    return heads.withColumn("row", F.lit(0)).unionByName(numbered.withColumn("n_products", F.lit(None).cast("long")), allowMissingColumns=True)
