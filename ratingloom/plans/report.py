"""The flagship report and the sinks around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import safe_cell
from ..operators import report as R
from ..operators.joins import upsert
from ..registry import query
from .bindings import OBS, RATING, observations, rating, table

MONTHS = ["1998-04", "1998-05", "1998-06"]
IN_MONTHS = "month IN ('1998-04', '1998-05', '1998-06')"
ALL = f"{OBS}, s AS (SELECT domain, brand, listing_id, product, month, greatest(reviews, rating_count) AS feedback, {RATING} AS rating FROM obs)"
SHOWN = f"{ALL[:-1]} WHERE {IN_MONTHS})"


def shown(spark, d, months: list[str] | None = None):
    """Feedback of every observation, or of those of the months that a report has columns for."""
    obs = observations(spark, d, months)
    return obs.select("domain", "brand", "listing_id", "product", "month", F.greatest("reviews", "rating_count").alias("feedback"), rating().alias("rating"))


TOTALS = "CAST(sum(feedback) AS BIGINT) AS reviews, count(*) FILTER (rating >= 400 AND feedback > 0) AS high, count(*) FILTER (rating < 400 AND feedback > 0) AS low, count(*) FILTER (feedback = 0 AND rating IS NULL) AS none"


@query("flagship", f"WITH {ALL}, t AS (SELECT domain, brand, month, {TOTALS} FROM s GROUP BY 1, 2, 3) SELECT *, CAST(coalesce((high * 10000) // nullif(high + low + none, 0), 0) AS BIGINT) AS high_share FROM t")
def flagship(spark, d):
    """Feedback and rating classes of every site, brand and month."""
    return R.month_totals(shown(spark, d), ["domain", "brand", "month"], "feedback", "rating")


@query("rsh06_report", f"WITH {SHOWN}, p AS (SELECT DISTINCT domain, listing_id FROM s), w AS (SELECT domain, listing_id, " + ", ".join(f"max(CASE WHEN month = '{m}' THEN feedback END) AS \"{m}_feedback\", max(CASE WHEN month = '{m}' THEN rating END) AS \"{m}_rating\"" for m in MONTHS) + """, arg_max(product, month) AS product, min(month) AS first_seen, max(month) AS last_seen FROM s GROUP BY 1, 2)
  SELECT domain, listing_id, product, first_seen, last_seen, """ + ", ".join(f"\"{m}_{x}\"" for m in MONTHS for x in ("feedback", "rating")) + """, row_number() OVER (PARTITION BY domain ORDER BY product, listing_id) AS row, NULL AS n_products FROM w
  UNION ALL SELECT domain, NULL, NULL, NULL, NULL, """ + ", ".join("NULL" for _ in range(6)) + ", 0, count(*) FROM p GROUP BY domain")
def rsh06(spark, d):
    rows = shown(spark, d, MONTHS)
    key = ["domain", "listing_id"]
    products = R.merge_months(rows, key, "month", MONTHS[-1], ["feedback", "rating"], ["product"])
    return R.report_rows(products, R.month_columns(rows, key, "month", MONTHS, ["feedback", "rating"]), key, "domain", ["product", "listing_id"])


@query("snk01_registry_upsert", f"WITH {OBS}, a AS (SELECT listing_id, max(product) AS product, max(month) AS last_seen FROM obs WHERE month < '1998-06' GROUP BY 1), b AS (SELECT listing_id, max(product) AS product, max(month) AS last_seen FROM obs WHERE month = '1998-06' GROUP BY 1) SELECT coalesce(b.listing_id, a.listing_id) AS listing_id, coalesce(b.product, a.product) AS product, coalesce(b.last_seen, a.last_seen) AS last_seen FROM a FULL JOIN b ON a.listing_id = b.listing_id")
def snk01(spark, d):
    seen = observations(spark, d)
    part = lambda rows: rows.groupBy("listing_id").agg(F.max("product").alias("product"), F.max("month").alias("last_seen"))
    return upsert(part(seen.filter("month < '1998-06'")), part(seen.filter("month = '1998-06'")), ["listing_id"])


@query("snk04_new_evidence", "WITH e AS (SELECT event_id, sha256(event_type || '|' || props || '|' || user_id) AS hash FROM events), old AS (SELECT DISTINCT hash FROM e WHERE event_id % 2 = 0) SELECT hash, min(event_id) AS event_id FROM e WHERE event_id % 2 = 1 AND hash NOT IN (SELECT hash FROM old) GROUP BY 1")
def snk04(spark, d):
    hashed = table(spark, d, "events").select("event_id", F.sha2(F.concat_ws("|", "event_type", "props", "user_id"), 256).alias("hash"))
    stored = hashed.filter("event_id % 2 = 0").select("hash").distinct()
    return hashed.filter("event_id % 2 = 1").join(stored, "hash", "left_anti").groupBy("hash").agg(F.min("event_id").alias("event_id"))


@query("snk07_clipboard_rows", "SELECT o_orderkey, concat_ws(chr(9), CAST(o_orderkey AS VARCHAR), CASE WHEN o_custkey % 3 = 0 THEN '''=A' || o_custkey ELSE CASE WHEN o_custkey % 3 = 1 THEN '\"a \"\"b\"\"' || chr(10) || 'c\"' ELSE o_orderpriority END END) AS line FROM orders")
def snk07(spark, d):
    text = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("=A"), F.col("o_custkey").cast("string"))).when(F.col("o_custkey") % 3 == 1, F.lit('a "b"\nc')).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws("\t", F.col("o_orderkey").cast("string"), safe_cell(text)).alias("line"))
