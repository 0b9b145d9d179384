"""The engine's concepts over the retail tables that the queries run on, in Spark and, as CTEs, in SQL.

A listing is a part, a site is a nation's suppliers, a month is a ship month; a line is a written review, an order a
rating, and the quantity, 1 to 50, is the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site_of(nation: str) -> Column:
    return F.concat(F.lit("n"), F.col(nation).cast("string"), F.lit(".example"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", site_of("s_nationkey").alias("domain"))


def on_sites(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Lines with their site as `nation`: a number, as keys of fixed width take little memory where lines are summed."""
    return lines.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")), "l_suppkey")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"), F.col("p_name").alias("product"))


def observations(spark: SparkSession, sf_dir: str, months: list[str] | None = None) -> DataFrame:
    """One row for each site, listing and month: counts of reviews and ratings, and the sum of scores in hundredths.

    Months asked for are a range of dates that the scan can skip row groups by. Lines are summed by their keys before
    names and sites are looked up, so both joins see one row for each order's part of a listing and month at most.
    """
    lines = table(spark, sf_dir, "lineitem")
    if months:
        first, after = f"{min(months)}-01", F.add_months(F.to_date(F.lit(f"{max(months)}-01")), 1)
        lines = lines.filter((F.col("l_shipdate") >= F.lit(first).cast("date")) & (F.col("l_shipdate") < after))
        lines = lines.filter(month_of(F.col("l_shipdate")).isin(months))
    lines = lines.select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity", F.trunc("l_shipdate", "month").alias("month"))
    scores = F.sum((F.col("l_quantity") * 100).cast("long"))
    orders = on_sites(spark, sf_dir, lines).groupBy("nation", "l_partkey", "month", "l_orderkey").agg(F.count("*").alias("n"), scores.alias("score"))
    listings = orders.groupBy("nation", "l_partkey", "month").agg(F.sum("n").alias("reviews"), F.count("*").alias("rating_count"), F.sum("score").alias("score_sum"))
    known = listings.join(products(spark, sf_dir), "l_partkey")
    return known.select(site_of("nation").alias("domain"), F.col("l_partkey").cast("string").alias("listing_id"), "brand", "product", month_of(F.col("month")).alias("month"), "reviews", "rating_count", "score_sum")


OBS = """obs AS (
  SELECT 'n' || s.s_nationkey || '.example' AS domain, CAST(l.l_partkey AS VARCHAR) AS listing_id, p.p_brand AS brand, p.p_name AS product,
         strftime(l.l_shipdate, '%Y-%m') AS month, count(*) AS reviews, count(DISTINCT l.l_orderkey) AS rating_count,
         CAST(sum(CAST(l.l_quantity * 100 AS BIGINT)) AS BIGINT) AS score_sum
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
  GROUP BY 1, 2, 3, 4, 5)"""

RATING = "((score_sum * 10 + reviews * 50) // (reviews * 100))"


def rating() -> Column:
    return ((F.col("score_sum") * 10 + F.col("reviews") * 50) / (F.col("reviews") * 100)).cast("long")


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site and brand with what was discovered (listings) and collected (listings with an order of two lines or more)."""
    obs = observations(spark, sf_dir)
    return obs.groupBy("domain", "brand").agg(F.count_distinct("listing_id").alias("discovered"), F.count_distinct(F.when(F.col("reviews") > 1, F.col("listing_id"))).alias("collected"))


PARTITIONS = OBS + """, parts AS (
  SELECT domain, brand, count(DISTINCT listing_id) AS discovered, count(DISTINCT CASE WHEN reviews > 1 THEN listing_id END) AS collected
  FROM obs GROUP BY domain, brand)"""

EXPECTED = """expected AS (SELECT 'n' || n_nationkey || '.example' AS domain, p_brand AS brand FROM nation, (SELECT DISTINCT p_brand FROM part))"""


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site with every brand. Both sides are dimensions: the product is what is asked for."""
    domains = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".example")).alias("domain"))
    return domains.crossJoin(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct())
