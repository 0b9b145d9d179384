"""What a local session hands in, against what it was asked for: every violation as a row, so that an import is taken whole or not at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import domain, listing_id
from . import identity as I

#: Minutes that clocks may differ by.
SKEW = 5


def item_problem(issued: Column, now: Column) -> Column:
    """The first thing wrong with one observation: its address, its title, its time, its metrics; null if nothing is."""
    bound = (domain(F.col("canonical_url")) == F.col("domain")) & (listing_id(F.col("canonical_url")) == F.col("listing_id"))
    named = F.regexp_like(F.col("product"), I.brand_pattern(F.col("brand")))
    slack = F.expr(f"INTERVAL {SKEW} MINUTES")
    timely = F.col("captured_at").between(issued - slack, now + slack)
    whole = F.when(F.col("status") == "ok", (F.col("reviews") > 0) & (F.col("rating") > 0)).when(F.col("status") == "no_reviews", (F.col("reviews") == 0) & F.col("rating").isNull()).otherwise(True)
    tests = {"address of another listing": bound, "title of another brand": named, "outside the session": timely, "incomplete metrics": whole}
    return F.coalesce(*[F.when(~F.coalesce(fine, F.lit(False)), name) for name, fine in tests.items()])


def import_problems(session: DataFrame, partitions: DataFrame, items: DataFrame, session_key: str = "session") -> DataFrame:
    """session, subject and problem of every violation.

    session: (session, brand, issued_at, now), the brands asked for; partitions: (session, brand, status, discovered,
    collected); items: (session, domain, listing_id, brand, canonical_url, product, reviews, rating, status, captured_at).
    """
    key = [session_key, "brand"]
    asked = session.select(*key).distinct()
    said = lambda rows, subject, problem: rows.select(session_key, F.col(subject).cast("string").alias("subject"), F.lit(problem).alias("problem") if isinstance(problem, str) else problem.alias("problem"))
    counted = partitions.groupBy(*key).agg(F.count("*").alias("times"), F.max(F.struct("status", "discovered", "collected")).alias("p"))
    seen = items.groupBy(*key).agg(F.count("*").alias("n"))
    known = counted.join(asked, key, "left_semi").join(seen, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    empty = (F.col("p.status") == "no_results") & ((F.col("p.discovered") != 0) | (F.col("p.collected") != 0) | (F.col("n") != 0))
    uneven = (F.col("p.status") == "complete") & ((F.col("p.discovered") == 0) | (F.col("p.discovered") != F.col("p.collected")) | (F.col("p.collected") != F.col("n")))
    times = session.groupBy(session_key).agg(F.max("issued_at").alias("_issued"), F.max("now").alias("_now"))
    tested = items.join(times, session_key).withColumn("_problem", item_problem(F.col("_issued"), F.col("_now")))
    found = [
        said(counted.join(asked, key, "left_anti"), "brand", "a brand that was not asked for"), said(counted.filter("times > 1"), "brand", "a brand twice"), said(asked.join(counted, key, "left_anti"), "brand", "a brand without a result"),
        said(seen.join(asked, key, "left_anti"), "brand", "observations of a brand that was not asked for"), said(items.groupBy(session_key, "listing_id").agg(F.count("*").alias("n")).filter("n > 1"), "listing_id", "a listing twice"),
        said(tested.filter("_problem is not null"), "listing_id", F.col("_problem")), said(known.filter(empty), "brand", "an empty result with counts"), said(known.filter(uneven), "brand", "counts that differ"),
    ]
    return reduce(DataFrame.unionByName, found)
