"""Aggregations of the pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in order; pre-aggregated, so a hot key is no hot task."""
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}") for c in rest])


def keep_last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}") for c in rest])


def latest_known(value: str, order: str) -> Column:
    """The last value that is not null."""
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def mean_if_complete(score: Column, places: int) -> Column:
    """Mean of whole-number scores if every row has one; hundredths, half up, as a whole number."""
    scale = 10**places
    return F.when(F.count(score) == F.count("*"), ((F.sum(score) * 2 * scale + F.count("*")) / (F.count("*") * 2)).cast("long"))


def reconcile(rows: DataFrame, key: list[str], metrics: list[str], order: str) -> DataFrame:
    """Duplicates of a key as one row: the fullest, its gaps filled from the others by order; metrics that differ raise `conflict`."""
    fullness = sum((F.col(m).isNotNull().cast("int") for m in metrics), F.lit(0))
    ranked = rows.withColumn("_full", fullness)
    out = ranked.groupBy(*key).agg(
        *[F.max_by(F.col(m), F.when(F.col(m).isNotNull(), F.struct("_full", (-F.col(order)).alias("o")))).alias(m) for m in metrics],
        # Two values differ exactly if the least and the greatest do; counting distinct ones would multiply the rows.
        *[F.coalesce(F.min(m) != F.max(m), F.lit(False)).alias(f"_c_{m}") for m in metrics],
        F.count("*").alias("n_rows"),
    )
    conflict = F.greatest(*[F.col(f"_c_{m}") for m in metrics], F.lit(False))
    return out.select(*key, *metrics, "n_rows", conflict.alias("conflict"))


def identical_only(rows: DataFrame, key: list[str], metrics: list[str], message: str) -> DataFrame:
    """One row for each key; duplicates that differ fail the query."""
    out = rows.groupBy(*key).agg(*[F.min(m).alias(m) for m in metrics], *[F.max(m).alias(f"_x_{m}") for m in metrics])
    differs = F.greatest(*[~F.col(m).eqNullSafe(F.col(f"_x_{m}")) for m in metrics], F.lit(False))
    ok = F.when(differs, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)
    return out.filter(ok).select(*key, *metrics)


def collapse_shared(rows: DataFrame, group: list[str], listing: str, month: str, metrics: list[str]) -> DataFrame:
    """Groups whose listings show one set of metrics in every month, and so are one product on several pages."""
    # One set is told from two by its metrics' least and greatest values: numbers, not structs, so that rows are
    # aggregated in hash tables, by group and month before anything is shuffled.
    low, high, known = ([f"_{kind}_{m}" for m in metrics] for kind in ("low", "high", "known"))
    found = [f(m).alias(n) for f, names in ((F.min, low), (F.max, high), (F.count, known)) for m, n in zip(metrics, names)]
    by_month = rows.groupBy(*group, month).agg(F.count("*").alias("_n"), *found)
    one = [(F.col(k) == 0) | ((F.col(k) == F.col("_n")) & (F.col(a) == F.col(b))) for a, b, k in zip(low, high, known)]
    agreed = by_month.groupBy(*group).agg(F.bool_and(reduce(lambda a, b: a & b, one)).alias("one")).filter("one")
    several = rows.select(*group, listing).distinct().groupBy(*group).agg(F.count(listing).alias("listings")).filter("listings > 1")
    return several.join(agreed.drop("one"), group)


def majority(votes: DataFrame, key: str, vote: str, order: str) -> DataFrame:
    """Of at most three votes: the one given twice, else the first; 'unknown' without any."""
    counted = votes.filter(F.col(vote).isNotNull()).groupBy(key, vote).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    picked = counted.groupBy(key).agg(F.max(F.struct((F.col("n") >= 2).alias("won"), (-F.col("at")).alias("at"), vote)).alias("top"))
    return votes.select(key).distinct().join(picked, key, "left").select(key, F.coalesce(F.col(f"top.{vote}"), F.lit("unknown")).alias(vote))


def shortest_label(label: str) -> Column:
    return F.min(F.struct(F.length(label).alias("n"), F.col(label).alias("label")))["label"]


def first_few(values: Column, n: int) -> Column:
    """The first n of a sorted set, and how many more there are."""
    all_ = F.array_sort(values)
    more = F.size(all_) - n
    return F.concat(F.array_join(F.slice(all_, 1, n), ", "), F.when(more > 0, F.concat(F.lit(" + "), more.cast("string"))).otherwise(""))
