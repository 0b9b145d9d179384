"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import month_of
from ..functions.numbers import percent
from ..operators import aggregates as A
from ..operators.checks import assert_bounded
from ..registry import query
from .bindings import OBS, PARTITIONS, RATING, observations, on_sites, partitions, products, rating, site_of, table


@query("ag01_keep_first", "SELECT lower(p_name) AS key, min(p_partkey) AS pos FROM part GROUP BY 1")
def ag01(spark, d):
    return A.keep_first(table(spark, d, "part").select(F.lower("p_name").alias("key"), F.col("p_partkey").alias("pos")), ["key"], ["pos"])


@query("ag02_keep_last", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def ag02(spark, d):
    return A.keep_last(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("ag03_max_of_counters", f"WITH {OBS} SELECT domain, listing_id, month, greatest(reviews, rating_count) AS feedback FROM obs")
def ag03(spark, d):
    return observations(spark, d).select("domain", "listing_id", "month", F.greatest("reviews", "rating_count").alias("feedback"))


@query("ag04_reconcile_duplicates", """WITH r AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_quantity > 25 THEN CAST(l_quantity AS BIGINT) END AS reviews, CASE WHEN l_discount > 0.04 THEN CAST(round(l_discount * 100) AS BIGINT) END AS rating FROM lineitem),
  f AS (SELECT *, (CASE WHEN reviews IS NULL THEN 0 ELSE 1 END) + (CASE WHEN rating IS NULL THEN 0 ELSE 1 END) AS fullness FROM r),
  a AS (SELECT k, reviews, row_number() OVER (PARTITION BY k ORDER BY fullness DESC, pos, reviews) AS n FROM f WHERE reviews IS NOT NULL), b AS (SELECT k, rating, row_number() OVER (PARTITION BY k ORDER BY fullness DESC, pos, rating) AS n FROM f WHERE rating IS NOT NULL)
  SELECT g.k, a.reviews, b.rating, g.n_rows, g.conflict FROM (SELECT k, count(*) AS n_rows, count(DISTINCT reviews) > 1 OR count(DISTINCT rating) > 1 AS conflict FROM f GROUP BY k) g LEFT JOIN a ON a.k = g.k AND a.n = 1 LEFT JOIN b ON b.k = g.k AND b.n = 1""")
def ag04(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("long")).alias("reviews"), F.when(F.col("l_discount") > 0.04, F.round(F.col("l_discount") * 100).cast("long")).alias("rating"))
    return A.reconcile(rows, ["k"], ["reviews", "rating"], "pos")


@query("ag05_identical_duplicates", "SELECT p_brand AS brand, 0 AS scale FROM part GROUP BY 1")
def ag05(spark, d):
    return A.identical_only(table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.lit(0).alias("scale")), ["brand"], ["scale"], "duplicates differ")


@query("ag06_count_by_partition", f"WITH {OBS} SELECT domain, brand, count(*) AS n FROM obs GROUP BY 1, 2")
def ag06(spark, d):
    return observations(spark, d).groupBy("domain", "brand").agg(F.count("*").alias("n"))


@query("ag07_count_by_status", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders")
def ag07(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("total"), *[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"])


@query("ag08_distinct_brands_and_domains", f"WITH {OBS} SELECT month, count(DISTINCT brand) AS brands, count(DISTINCT domain) AS domains FROM obs GROUP BY 1")
def ag08(spark, d):
    return observations(spark, d).groupBy("month").agg(F.count_distinct("brand").alias("brands"), F.count_distinct("domain").alias("domains"))


@query("ag09_reviews_by_month", f"WITH {OBS} SELECT month, CAST(sum(reviews) AS BIGINT) AS reviews FROM obs GROUP BY 1")
def ag09(spark, d):
    return observations(spark, d).groupBy("month").agg(F.sum("reviews").alias("reviews"))


@query("ag10_rating_classes", f"WITH {OBS}, r AS (SELECT month, CASE WHEN reviews % 3 = 0 THEN 0 ELSE reviews END AS reviews, CASE WHEN reviews % 3 <> 0 THEN {RATING} END AS rating FROM obs) SELECT month, count(*) FILTER (rating >= 400 AND reviews > 0) AS high, count(*) FILTER (rating < 400 AND reviews > 0) AS low, count(*) FILTER (reviews = 0 AND rating IS NULL) AS none FROM r GROUP BY 1")
def ag10(spark, d):
    zero = F.col("reviews") % 3 == 0
    rows = observations(spark, d).select("month", F.when(zero, 0).otherwise(F.col("reviews")).alias("n"), F.when(~zero, rating()).alias("rating"))
    return rows.groupBy("month").agg(
        F.count_if((F.col("rating") >= 400) & (F.col("n") > 0)).alias("high"), F.count_if((F.col("rating") < 400) & (F.col("n") > 0)).alias("low"), F.count_if((F.col("n") == 0) & F.col("rating").isNull()).alias("none")
    )


@query("ag11_share_of_total", f"WITH {OBS} SELECT domain, CAST(floor(coalesce(sum(CASE WHEN {RATING} >= 400 THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN reviews > 1 THEN 1 ELSE 0 END), 0), 0) * 1000 + 1e-6) AS BIGINT) AS per_mille FROM obs GROUP BY 1")
def ag11(spark, d):
    share = A.share(F.count_if(rating() >= 400), F.count_if(F.col("reviews") > 1))
    return observations(spark, d).groupBy("domain").agg(F.floor(share * 1000 + 1e-6).alias("per_mille"))


@query("ag12_mean_of_reviews", "WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_partkey) AS p, CAST(min(l_quantity) AS BIGINT) AS score, min(l_discount) AS dc FROM lineitem GROUP BY 1) SELECT p AS product, count(*) FILTER (dc > 0.02) AS rated, count(*) FILTER (dc <= 0.02) AS unrated, CAST(sum(CASE WHEN dc > 0.02 THEN score END) AS BIGINT) AS total FROM r GROUP BY 1")
def ag12(spark, d):
    lines = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min("l_partkey").alias("product"), F.min("l_quantity").cast("long").alias("score"), F.min("l_discount").alias("dc"))
    scored = F.col("dc") > 0.02
    return lines.groupBy("product").agg(F.count_if(scored).alias("rated"), F.count_if(~scored).alias("unrated"), F.sum(F.when(scored, F.col("score"))).alias("total"))


@query("ag13_mean_if_complete", "SELECT l_orderkey, CASE WHEN count(CASE WHEN l_discount > 0.01 THEN 1 END) = count(*) THEN CAST((sum(CAST(l_quantity AS BIGINT)) * 20 + count(*)) // (count(*) * 2) AS BIGINT) END AS mean_x10 FROM lineitem GROUP BY 1")
def ag13(spark, d):
    lines = table(spark, d, "lineitem").withColumn("score", F.when(F.col("l_discount") > 0.01, F.col("l_quantity").cast("long")))
    return lines.groupBy("l_orderkey").agg(A.mean_if_complete(F.col("score"), 1).alias("mean_x10"))


@query("ag14_frequent_fingerprints", f"WITH {OBS} SELECT domain, month, reviews, rating_count, score_sum, count(*) AS listings FROM obs GROUP BY ALL HAVING count(*) > 1")
def ag14(spark, d):
    return observations(spark, d).groupBy("domain", "month", "reviews", "rating_count", "score_sum").agg(F.count("*").alias("listings")).filter("listings > 1")


@query("ag15_first_and_last_seen", f"WITH {OBS} SELECT domain, listing_id, min(month) AS first_seen, max(CASE WHEN reviews % 5 <> 0 THEN month END) AS last_seen FROM obs GROUP BY 1, 2")
def ag15(spark, d):
    found = F.when(F.col("reviews") % 5 != 0, F.col("month"))
    return observations(spark, d).groupBy("domain", "listing_id").agg(F.min("month").alias("first_seen"), F.max(found).alias("last_seen"))


@query("ag16_latest_known_metric", f"WITH {OBS}, r AS (SELECT *, CASE WHEN score_sum % 3 <> 0 THEN reviews END AS known FROM obs) SELECT domain, listing_id, arg_max(known, month) FILTER (known IS NOT NULL) AS reviews FROM r GROUP BY 1, 2")
def ag16(spark, d):
    rows = observations(spark, d).withColumn("known", F.when(F.col("score_sum") % 3 != 0, F.col("reviews")))
    return rows.groupBy("domain", "listing_id").agg(A.latest_known("known", "month").alias("reviews"))


@query("ag17_canonical_duplicates", f"WITH {OBS} SELECT domain, brand, product, min(month) AS first_seen, max(month) AS last_seen, count(DISTINCT listing_id) AS pages FROM obs GROUP BY 1, 2, 3")
def ag17(spark, d):
    """First and last day of a listing tell its months, so orders and months need not be summed first."""
    lines = on_sites(spark, d, table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate"))
    listings = lines.groupBy("nation", "l_partkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last")).join(products(spark, d).distinct(), "l_partkey")
    seen = listings.groupBy("nation", "brand", "product").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("pages"))
    return seen.select(site_of("nation").alias("domain"), "brand", "product", month_of(F.col("first")).alias("first_seen"), month_of(F.col("last")).alias("last_seen"), "pages")


@query("ag18_shared_aggregates", f"WITH {OBS}, g AS (SELECT domain || '/' || brand || '/' || product AS grp, listing_id, month, reviews FROM obs), k AS (SELECT grp FROM (SELECT grp, month, count(DISTINCT reviews) AS kinds FROM g GROUP BY 1, 2) GROUP BY 1 HAVING max(kinds) = 1) SELECT grp, count(DISTINCT listing_id) AS listings FROM g WHERE grp IN (SELECT grp FROM k) GROUP BY 1 HAVING count(DISTINCT listing_id) > 1")
def ag18(spark, d):
    """Only reviews are compared, so orders need not be told apart."""
    lines = on_sites(spark, d, table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.trunc("l_shipdate", "month").alias("month")))
    listings = lines.groupBy("nation", "l_partkey", "month").agg(F.count("*").alias("reviews")).join(products(spark, d), "l_partkey")
    shared = A.collapse_shared(listings, ["nation", "brand", "product"], "l_partkey", "month", ["reviews"])
    return shared.select(F.concat_ws("/", site_of("nation"), "brand", "product").alias("grp"), "listings")


@query("ag19_combined_label", "SELECT p_brand AS brand, string_agg(size, ', ' ORDER BY size) AS packs FROM (SELECT DISTINCT p_brand, lpad(CAST(p_size AS VARCHAR), 2, '0') AS size FROM part) GROUP BY 1")
def ag19(spark, d):
    packs = F.array_join(F.array_sort(F.collect_set(F.lpad(F.col("p_size").cast("string"), 2, "0"))), ", ")
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(packs.alias("packs"))


@query("ag20_majority_vote", """WITH v AS (SELECT o_orderkey // 3 AS k, o_orderkey AS pos, CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS vote FROM orders),
  c AS (SELECT k, vote, count(*) AS n, min(pos) AS first_at FROM v WHERE vote IS NOT NULL GROUP BY 1, 2), t AS (SELECT k, vote, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN n >= 2 THEN 0 ELSE 1 END, first_at) AS r FROM c)
  SELECT d.k, coalesce(t.vote, 'unknown') AS vote FROM (SELECT DISTINCT k FROM v) d LEFT JOIN t ON t.k = d.k AND t.r = 1""")
def ag20(spark, d):
    votes = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 3).alias("k"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderstatus")).alias("vote"))
    return A.majority(votes, "k", "vote", "pos")


@query("ag21_issue_summary", "SELECT o_orderpriority AS kind, o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers, bool_or(o_totalprice > 400000) AS any_large FROM orders GROUP BY 1, 2")
def ag21(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"))


@query("ag22_variant_groups", "SELECT p_brand AS brand, p_name AS core, count(DISTINCT p_size) AS doses, bool_or(p_size < 5) AS has_short FROM part GROUP BY 1, 2")
def ag22(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_name").alias("core")).agg(F.count_distinct("p_size").alias("doses"), F.bool_or(F.col("p_size") < 5).alias("has_short"))


@query("ag23_shortest_label", "SELECT p_brand AS brand, arg_min(p_name, lpad(CAST(length(p_name) AS VARCHAR), 3, '0') || p_name) AS label FROM part GROUP BY 1")
def ag23(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(A.shortest_label("p_name").alias("label"))


@query("ag24_first_three_variants", "WITH s AS (SELECT DISTINCT p_brand AS brand, p_name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY p_name) AS n, count(*) OVER (PARTITION BY brand) AS c FROM s) SELECT brand, string_agg(p_name, ', ' ORDER BY p_name) FILTER (n <= 3) || CASE WHEN max(c) > 3 THEN ' + ' || CAST(max(c) - 3 AS VARCHAR) ELSE '' END AS variants FROM r GROUP BY 1")
def ag24(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(A.first_few(F.collect_set("p_name"), 3).alias("variants"))


@query("ag25_last_page", "SELECT conv_id, max(turn) + 1 AS pages FROM conversations GROUP BY 1")
def ag25(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("pages"))


@query("ag26_running_usage", "SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN -CAST(round(value * 100) AS BIGINT) ELSE CAST(round(value * 100) AS BIGINT) END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS reserved FROM events")
def ag26(spark, d):
    from pyspark.sql import Window

    cents = F.round(F.col("value") * 100).cast("long")
    signed = F.when(F.col("event_type") == "error", -cents).otherwise(cents)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rangeBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.sum(signed).over(order).alias("reserved"))


@query("ag27_preflight_totals", f"WITH {PARTITIONS} SELECT CAST(sum(discovered) AS BIGINT) AS n_rows, max(collected) AS widest FROM parts")
def ag27(spark, d):
    return partitions(spark, d).agg(F.sum("discovered").alias("n_rows"), F.max("collected").alias("widest"))


@query("ag28_all_any_none", "SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_done, bool_or(o_orderstatus = 'P') AS any_open, NOT bool_or(o_totalprice > 300000) AS none_large FROM orders GROUP BY 1")
def ag28(spark, d):
    done, open_, large = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P", F.col("o_totalprice") > 300000
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_and(done).alias("all_done"), F.bool_or(open_).alias("any_open"), (~F.bool_or(large)).alias("none_large"))


@query("ag29_progress_percent", f"WITH {PARTITIONS} SELECT domain, brand, (collected * 200 + greatest(discovered, 1)) // (greatest(discovered, 1) * 2) AS progress FROM parts")
def ag29(spark, d):
    return partitions(spark, d).select("domain", "brand", percent(F.col("collected"), F.col("discovered")).alias("progress"))


@query("ag30_bounded_partitions", f"WITH {PARTITIONS} SELECT domain, brand FROM parts")
def ag30(spark, d):
    return assert_bounded(partitions(spark, d).select("domain", "brand"), 100_000, "too many partitions")
