"""Queries of imports, strict numbers and sites that cannot be read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import imports as I
from ..registry import query
from ..sources.connectors import STANDARD
from .bindings import table

WRONG_BRAND, TWICE, LATE, BARE, FOREIGN = "p_partkey % 13 = 1", "p_partkey % 17 = 2", "p_partkey % 19 = 3", "p_partkey % 23 = 4", "p_partkey % 29 = 5"


@query("qa22_import_problems", f"""WITH b AS (SELECT p_brand AS brand, count(*) + count(*) FILTER ({TWICE}) AS n, CAST(substring(p_brand, 7) AS INT) AS k FROM part GROUP BY 1)
  SELECT p_partkey % 1 AS session, CAST(p_partkey AS VARCHAR) AS subject, 'a listing twice' AS problem FROM part WHERE {TWICE}
  UNION ALL SELECT 0, CAST(p_partkey AS VARCHAR), CASE WHEN {FOREIGN} THEN 'address of another listing' WHEN {WRONG_BRAND} THEN 'title of another brand' WHEN {LATE} THEN 'outside the session' ELSE 'incomplete metrics' END FROM part, (SELECT unnest([1, 2]) AS copy) WHERE ({FOREIGN} OR {WRONG_BRAND} OR {LATE} OR {BARE}) AND (copy = 1 OR {TWICE})
  UNION ALL SELECT 0, brand, 'a brand without a result' FROM b WHERE k % 5 = 1 UNION ALL SELECT 0, brand, 'a brand that was not asked for' FROM b WHERE k % 5 = 2 UNION ALL SELECT 0, brand, 'observations of a brand that was not asked for' FROM b WHERE k % 5 = 2
  UNION ALL SELECT 0, brand, 'a brand twice' FROM b WHERE k % 5 = 3 UNION ALL SELECT 0, brand, 'counts that differ' FROM b WHERE k % 5 = 4""")
def qa22_problems(spark, d):
    """One session that asks for most brands; brands and listings with seeded faults."""
    parts = table(spark, d, "part")
    issued, at = F.timestamp_seconds(F.lit(1_780_000_000)), F.timestamp_seconds(F.lit(1_780_001_800))
    k = F.expr("CAST(substring(brand, 7) AS INT) % 5")
    brands = parts.groupBy(F.col("p_brand").alias("brand")).agg((F.count("*") + F.count_if(F.expr(TWICE))).alias("n")).withColumn("session", F.lit(0).cast("long"))
    session = brands.filter(k != 2).select("session", "brand", issued.alias("issued_at"), at.alias("now"))
    results = brands.filter(k != 1).select("session", "brand", F.lit("complete").alias("status"), "n", F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    partitions = results.select("session", "brand", "status", (F.col("n") + F.when(k == 4, 1).otherwise(0)).alias("discovered"), F.col("n").alias("collected"))
    copies = F.explode(F.when(F.expr(TWICE), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    items = parts.select("*", copies).select(
        F.lit(0).cast("long").alias("session"), F.lit("ozon.ru").alias("domain"), F.col("p_partkey").cast("string").alias("listing_id"), F.col("p_brand").alias("brand"), F.concat(F.lit("https://www.ozon.ru/product/x-"), F.col("p_partkey") + F.when(F.expr(FOREIGN), 1).otherwise(0), F.lit("/")).alias("canonical_url"),
        F.when(F.expr(WRONG_BRAND), F.col("p_name")).otherwise(F.concat_ws(" ", "p_brand", "p_name")).alias("product"), F.col("p_size").cast("long").alias("reviews"), F.when(~F.expr(BARE), 4.5).alias("rating"), F.lit("ok").alias("status"), F.when(F.expr(LATE), at + F.expr("INTERVAL 6 MINUTES")).otherwise(at + F.expr("INTERVAL 4 MINUTES")).alias("captured_at"),
    )
    return I.import_problems(session, partitions, items)


@query("nf05_strict_counts", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size END AS n, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_size <= 5 THEN CAST(p_size AS DOUBLE) END WHEN 1 THEN CASE WHEN p_size <= 5 THEN CAST(p_size AS DOUBLE) END WHEN 2 THEN p_size % 5 + 0.5 END AS rating FROM part")
def nf05(spark, d):
    """Counts of digits alone, and ratings from 0 to 5; whatever else stands there is no number."""
    text = F.expr("CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN concat(' ', p_size, ' ') WHEN 2 THEN concat(p_size % 5, ',5') WHEN 3 THEN concat(p_size, ' шт') ELSE concat('-', p_size) END")
    return table(spark, d, "part").select("p_partkey", N.strict_count(text).alias("n"), N.strict_rating(text).alias("rating"))


@query("src06_blocked_sites", "SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN 'eapteka.ru' WHEN 1 THEN 'polza.ru' ELSE 'free.example' END AS domain, CASE WHEN p_partkey % 3 < 2 THEN 'blocked' ELSE 'ok' END AS status, CASE WHEN p_partkey % 3 = 2 THEN p_size END AS reviews FROM part")
def src06(spark, d):
    """Sites that nothing can be read of fail closed, whatever their pages say."""
    html = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.struct(F.lit(4).alias("ratingValue"), F.col("p_size").alias("reviewCount")).alias("aggregateRating"))), F.lit("</script>"))
    url = F.expr("concat('https://www.', CASE p_partkey % 3 WHEN 0 THEN 'eapteka.ru' WHEN 1 THEN 'polza.ru' ELSE 'free.example' END, '/p/', p_partkey)")
    return STANDARD.collect(table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html"))).select("page_id", "domain", "status", "reviews")
