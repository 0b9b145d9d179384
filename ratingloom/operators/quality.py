"""Data-quality rules of a collection run. Each gives the rows that break it; a run without any may be published.

Tables: `expected` (domain, brand), `partitions` (domain, brand, status, discovered, collected), `exclusions` (domain,
brand), `observations` (domain, listing_id, brand, reviews, rating, status, historical, rating_unavailable,
has_raw_rating, raw_rating) and `errors` (domain, brand, message). Null and missing raw ratings differ: the flag tells.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ["domain", "brand"]
GOOD = ("complete", "no_results")
READ = ("ok", "no_reviews", "not_found")


@dataclass
class Run:
    expected: DataFrame
    partitions: DataFrame
    exclusions: DataFrame
    observations: DataFrame
    errors: DataFrame

    def excluded(self) -> DataFrame:
        return self.exclusions.select(*PAIR).distinct()

    def asked(self, condition: Column | str) -> DataFrame:
        return self.observations.filter(condition)


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key)


def duplicate_exclusion(r: Run) -> DataFrame:
    return repeated(r.exclusions, PAIR)


def exclusion_warning(r: Run) -> DataFrame:
    return r.excluded()


def stray_exclusion(r: Run) -> DataFrame:
    return r.excluded().join(r.expected, PAIR, "left_anti")


def progress(r: Run) -> DataFrame:
    """One row: expected, reported and finished partitions; ok if they are equal."""
    want = r.expected.agg(F.count("*").alias("expected"))
    have = r.partitions.agg(F.count("*").alias("reported"), F.count_if(F.col("status") != "pending").alias("finished"))
    return want.crossJoin(have).withColumn("ok", (F.col("expected") == F.col("reported")) & (F.col("expected") == F.col("finished")))


def unexpected_partition(r: Run) -> DataFrame:
    return r.partitions.select(*PAIR).distinct().join(r.expected, PAIR, "left_anti")


def duplicate_partition(r: Run) -> DataFrame:
    return repeated(r.partitions, PAIR)


def excluded_but_successful(r: Run) -> DataFrame:
    return r.partitions.filter(F.col("status").isin(*GOOD)).select(*PAIR).distinct().join(r.excluded(), PAIR, "left_semi")


def failed_not_excluded(r: Run) -> DataFrame:
    return r.partitions.filter(~F.col("status").isin(*GOOD)).select(*PAIR).distinct().join(r.excluded(), PAIR, "left_anti")


def complete_without_cards(r: Run) -> DataFrame:
    return r.partitions.filter("status = 'complete' and discovered = 0").select(*PAIR).distinct()


def empty_with_counts(r: Run) -> DataFrame:
    return r.partitions.filter("status = 'no_results' and (discovered <> 0 or collected <> 0)").select(*PAIR).distinct()


def missing_partition(r: Run) -> DataFrame:
    return r.expected.join(r.partitions, PAIR, "left_anti").select(*PAIR)


def broken_contract(r: Run) -> DataFrame:
    """Observations that no later rule looks at."""
    bad = F.col("listing_id").isNull() | (F.length("listing_id") == 0) | (F.col("reviews") < 0) | ~F.coalesce(F.col("rating").between(0, 500), F.lit(True)) | F.col("status").isNull()
    return r.observations.filter(F.coalesce(bad, F.lit(False))).select("domain", "listing_id")


def outside_request(r: Run) -> DataFrame:
    return r.observations.join(r.expected, PAIR, "left_anti").select("domain", "listing_id")


def in_excluded_partition(r: Run) -> DataFrame:
    return r.observations.join(r.excluded(), PAIR, "left_semi").select("domain", "listing_id")


def duplicate_key(r: Run) -> DataFrame:
    return repeated(r.observations.select(F.lower("domain").alias("domain"), "listing_id"), ["domain", "listing_id"])


def unread_status(r: Run) -> DataFrame:
    return r.asked(~F.col("status").isin(*READ)).select("domain", "listing_id", "status")


def wrong_zero(r: Run) -> DataFrame:
    return r.asked("status = 'no_reviews' and not (reviews <=> 0 and rating is null)").select("domain", "listing_id")


def incomplete_metrics(r: Run) -> DataFrame:
    """Read cards need reviews and a rating, or a site that says it has none and shows null or zero."""
    none_said = "(rating_unavailable and (rating is not null or not has_raw_rating or coalesce(raw_rating, 0) <> 0))"
    return r.asked(f"status = 'ok' and (coalesce(reviews, 0) <= 0 or (rating is null and not rating_unavailable) or {none_said})").select("domain", "listing_id")


def rating_not_yet(r: Run) -> DataFrame:
    return r.asked("status = 'ok' and rating_unavailable").select("domain", "listing_id")


def wrong_not_found(r: Run) -> DataFrame:
    return r.asked("status = 'not_found' and (not historical or reviews is not null or rating is not null)").select("domain", "listing_id")


def count_mismatch(r: Run) -> DataFrame:
    """Partitions whose counts disagree: collected with discovered, or the snapshot with either."""
    seen = r.observations.groupBy(*PAIR).agg(F.count("*").alias("seen"))
    both = r.partitions.join(seen, PAIR, "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    kind = F.when((F.col("status") == "complete") & (F.col("collected") != F.col("discovered")), "uncollected").when((F.col("status") == "complete") & (F.col("seen") != F.col("collected")), "snapshot").when((F.col("status") == "no_results") & (F.col("seen") != 0), "not_empty")
    return both.select(*PAIR, kind.alias("kind")).filter("kind is not null").distinct()


def unexplained_error(r: Run) -> DataFrame:
    failed = r.partitions.filter(~F.col("status").isin(*GOOD)).select(*PAIR).distinct()
    return r.errors.join(r.excluded(), PAIR, "left_anti").join(failed, PAIR, "left_anti").select(*PAIR, "message").distinct()


BLOCKERS = {
    "duplicate_exclusion": duplicate_exclusion, "stray_exclusion": stray_exclusion, "unexpected_partition": unexpected_partition, "duplicate_partition": duplicate_partition,
    "excluded_but_successful": excluded_but_successful, "failed_not_excluded": failed_not_excluded, "complete_without_cards": complete_without_cards, "empty_with_counts": empty_with_counts,
    "missing_partition": missing_partition, "broken_contract": broken_contract, "outside_request": outside_request, "in_excluded_partition": in_excluded_partition, "duplicate_key": duplicate_key,
    "unread_status": unread_status, "wrong_zero": wrong_zero, "incomplete_metrics": incomplete_metrics, "wrong_not_found": wrong_not_found, "count_mismatch": count_mismatch, "unexplained_error": unexplained_error,
}


def blockers(r: Run) -> DataFrame:
    """All violations as (rule, subject); the progress counts among them."""
    subject = lambda rows: F.concat_ws("/", *[F.col(c).cast("string") for c in rows.columns])
    found = [rows.select(F.lit(name).alias("rule"), subject(rows).alias("subject")) for name, rule in BLOCKERS.items() for rows in (rule(r),)]
    found.append(progress(r).filter("not ok").select(F.lit("progress").alias("rule"), F.concat_ws("/", "expected", "reported", "finished").alias("subject")))
    return reduce(DataFrame.union, found).distinct()


def cell_problems(cells: DataFrame, limit: int = 50_000) -> DataFrame:
    """Cells (tab, r, c, text, number, formula) that a report must not hold, and tabs beyond the limit of cells."""
    kind = F.when((F.col("r") < 0) | (F.col("c") < 0), "place").when(F.col("text").isNotNull() & F.col("number").isNotNull(), "two_values").when(F.isnan("number"), "number").when(F.col("formula").isNotNull() & ~F.col("formula").startswith("="), "formula").when(F.col("formula").isNull() & F.col("text").rlike(r"^[=+@]"), "injection")
    large = cells.groupBy("tab").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("tab", F.lit(None).cast("long").alias("r"), F.lit(None).cast("long").alias("c"), F.lit("too_many").alias("kind"))
    return cells.select("tab", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), kind.alias("kind")).filter("kind is not null").union(large)
