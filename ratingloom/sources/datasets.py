"""Captured datasets: items of JSON as observations, by a table of where each site's items carry what.

An item is one listing, or columns of equal length with one listing in each place. Duplicates of a listing merge, or, for
sites whose items must be unique, fail the query if they differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import compact_count, plain_number, rating_to_five, sku
from ..functions.text import let
from ..operators.aggregates import identical_only, reconcile

METRICS = ["product", "url", "reviews", "rating_count", "raw_rating"]


@dataclass(frozen=True)
class Dataset:
    """Names to try in order for each value, and whether duplicates that differ fail."""

    domain: str
    ids: tuple[str, ...]
    product: tuple[str, ...] = ("title", "name")
    url: tuple[str, ...] = ("url", "link")
    reviews: tuple[str, ...] = ("reviewCount", "reviews")
    rating_count: tuple[str, ...] = ("ratingCount",)
    rating: tuple[str, ...] = ("rating",)
    unique: bool = False


#: Sites whose datasets are read, and the names of their identifiers.
OZON = Dataset("ozon.ru", ("sku", "id", "productId"))
WILDBERRIES = Dataset("wildberries.ru", ("nmId", "id"), reviews=("feedbacks", "reviewCount"), rating=("reviewRating", "rating"), unique=True)
YANDEX = Dataset("market.yandex.ru", ("modelId",))


def listings(items: DataFrame, dataset: Dataset, body: str = "item") -> DataFrame:
    """A row for each listing in the items: listing_id and METRICS as they are given; columns of different lengths fail."""
    v = F.col("_v")

    def values(names: tuple[str, ...]):
        # A list is a column; what is none is a column of one.
        each = [F.coalesce(F.try_variant_get(v, f"$.{n}", "array<string>"), F.when(F.try_variant_get(v, f"$.{n}", "string").isNotNull(), F.array(F.try_variant_get(v, f"$.{n}", "string")))) for n in names]
        return F.coalesce(*each)

    columns = {"listing_id": dataset.ids, "product": dataset.product, "url": dataset.url, "reviews": dataset.reviews, "rating_count": dataset.rating_count, "raw_rating": dataset.rating}
    parsed = items.select(F.monotonically_increasing_id().alias("place"), F.try_parse_json(body).alias("_v"))

    def zipped(item):
        n = F.size(item["listing_id"])
        uneven = F.exists(F.array(*[F.size(item[c]) for c in columns]), lambda m: (m >= 0) & (m != n))
        filled = [F.coalesce(item[c], F.array_repeat(F.lit(None).cast("string"), n)).alias(c) for c in columns]
        return F.when(uneven, F.raise_error(F.lit("a dataset item has columns of different lengths"))).otherwise(F.arrays_zip(*filled))

    # One expression, as a filter would work the values out once more.
    rows = let(F.struct(*[values(names).alias(c) for c, names in columns.items()]), zipped).cast(f"array<struct<{', '.join(f'{c}:string' for c in columns)}>>")
    return parsed.select("place", F.posexplode(rows).alias("nth", "r")).select((F.col("place").cast("decimal(38,0)") * 10_000_000_000 + F.col("nth")).alias("place"), sku(F.col("r.listing_id")).alias("listing_id"), "r.product", "r.url", compact_count(F.col("r.reviews")).alias("reviews"), compact_count(F.col("r.rating_count")).alias("rating_count"), plain_number(F.col("r.raw_rating")).alias("raw_rating")).filter("listing_id is not null")


def observations_of(items: DataFrame, dataset: Dataset, body: str = "item") -> DataFrame:
    """One observation for each listing; a count that is not given is no zero, and metrics that differ wait for a person."""
    rows = listings(items, dataset, body)
    if dataset.unique:
        one = identical_only(rows, ["listing_id"], METRICS, f"{dataset.domain}: a listing is given twice and differs").withColumn("conflict", F.lit(False))
    else:
        one = reconcile(rows, ["listing_id"], METRICS, "place")
    count = F.greatest("reviews", "rating_count")
    status = F.when(F.col("conflict") | F.col("reviews").isNull(), "needs_review").when(count > 0, "ok").otherwise("no_reviews")
    return one.select(F.lit(dataset.domain).alias("domain"), "listing_id", "product", "url", "reviews", "rating_count", F.when(count > 0, rating_to_five(F.col("raw_rating"), F.lit(5.0))).alias("rating"), status.alias("status"))
