"""Queries of windows, sorting, paging and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.urls import column_letters
from ..operators import windows as W
from ..operators.checks import assert_bounded
from ..registry import query
from .bindings import OBS, RATING, observations, rating, table


@query("wn01_first_by_order", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n = 1")
def wn01(spark, d):
    return W.first_of(table(spark, d, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "turn", "role")


@query("wn02_repeated_page", "SELECT conv_id, turn, coalesce(text = lag(text) OVER (PARTITION BY conv_id ORDER BY turn), false) AS repeats FROM conversations")
def wn02(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", W.repeats("text", ["conv_id"], ["turn"]).alias("repeats"))


@query("wn03_exhaustion_proof", "SELECT l_orderkey, l_linenumber, l_partkey, sum(1) OVER w AS seen, sum(1) OVER w >= count(*) OVER (PARTITION BY l_orderkey) AS exhausted FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)")
def wn03(spark, d):
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.count("*").over(by)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", seen.alias("seen"), (seen >= F.count("*").over(Window.partitionBy("l_orderkey"))).alias("exhausted"))


@query("wn04_last_64_events", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 64")
def wn04(spark, d):
    return W.last_n(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 64).select("user_id", "event_id")


@query("wn05_last_six_signatures", "WITH s AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2) SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM s) WHERE n <= 6")
def wn05(spark, d):
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    return W.last_n(last, ["user_id"], ["event_id"], 6)


@query("wn06_checkpoint_progress", f"WITH {OBS}, m AS (SELECT domain, month, count(*) AS done FROM obs GROUP BY 1, 2) SELECT domain, month, done, coalesce(done > lag(done) OVER (PARTITION BY domain ORDER BY month), true) AS advanced FROM m")
def wn06(spark, d):
    done = observations(spark, d).groupBy("domain", "month").agg(F.count("*").alias("done"))
    return done.withColumn("advanced", F.coalesce(F.col("done") > F.lag("done").over(Window.partitionBy("domain").orderBy("month")), F.lit(True)))


@query("wn07_event_sequence", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def wn07(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("sequence"))


@query("wn08_last_known_metric", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def wn08(spark, d):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(by).alias("last_purchase"))


@query("so01_request_order", "SELECT o_orderkey, CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS place FROM orders")
def so01(spark, d):
    asked = F.array(F.lit("2-HIGH"), F.lit("1-URGENT"))
    rows = table(spark, d, "orders").withColumn("place", W.request_place("o_orderpriority", asked))
    return rows.orderBy("place", "o_orderpriority", "o_orderkey").select("o_orderkey", "place")


@query("so02_report_order", f"WITH {OBS}, r AS (SELECT DISTINCT domain, brand, product FROM obs) SELECT domain, brand, product, row_number() OVER (PARTITION BY domain ORDER BY brand, product) AS n FROM r")
def so02(spark, d):
    rows = observations(spark, d).select("domain", "brand", "product").distinct()
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("brand", "product")))


@query("so03_unknown_after_known", "SELECT n_nationkey, n_name, CASE WHEN n_name = 'NATION_7' THEN 1 WHEN n_name = 'NATION_3' THEN 2 ELSE 3 END AS place FROM nation")
def so03(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name", W.request_place("n_name", F.array(F.lit("NATION_7"), F.lit("NATION_3"))).alias("place")).orderBy("place", "n_name")


@query("so04_stable_priority", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal > 5000 THEN 0 ELSE 1 END, s_suppkey) AS n FROM supplier")
def so04(spark, d):
    order = Window.partitionBy("s_nationkey").orderBy(F.when(F.col("s_acctbal") > 5000, 0).otherwise(1), "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.row_number().over(order).alias("n"))


@query("so05_numeric_ids", "SELECT p_brand, CAST(p_partkey AS VARCHAR) AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part")
def so05(spark, d):
    ids = table(spark, d, "part").select("p_brand", F.col("p_partkey").cast("string").alias("id"))
    return ids.withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy(*W.numeric_first("id"))))


@query("so06_selected_first", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_name) AS n FROM customer")
def so06(spark, d):
    order = Window.partitionBy("c_nationkey").orderBy((F.col("c_mktsegment") == "BUILDING").desc(), "c_name")
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(order).alias("n"))


@query("so07_page_of_rows", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200 OFFSET 400")
def so07(spark, d):
    return W.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 400, 200).select("o_orderkey", "total")


@query("so08_top_twenty", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def so08(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_custkey")


@query("so09_cap_is_an_error", "SELECT page_id FROM pages")
def so09(spark, d):
    return assert_bounded(table(spark, d, "pages").select("page_id"), 10_000_000, "more pages than the cap")


@query("so10_longest_first", "WITH n AS (SELECT DISTINCT p_brand, p_name FROM part) SELECT p_brand, string_agg(p_name, '|' ORDER BY length(p_name) DESC, p_name) AS names FROM n GROUP BY 1")
def so10(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(W.longest_first(F.collect_set("p_name")), "|").alias("names"))


MONTHS = ["1998-04", "1998-05", "1998-06"]


@query("rsh01_pivot_months", f"WITH {OBS} SELECT domain, listing_id, " + ", ".join(f"max(CASE WHEN month = '{m}' THEN reviews END) AS \"{m}_reviews\", max(CASE WHEN month = '{m}' THEN {RATING} END) AS \"{m}_rating\"" for m in MONTHS) + " FROM obs WHERE month IN ('1998-04', '1998-05', '1998-06') GROUP BY 1, 2")
def rsh01(spark, d):
    rows = observations(spark, d).filter(F.col("month").isin(MONTHS)).withColumn("rating", rating())
    return W.pivot_months(rows, ["domain", "listing_id"], "month", MONTHS, ["reviews", "rating"])


@query("rsh02_unpivot_sheet", f"WITH {OBS} SELECT domain, listing_id, month, reviews, {RATING} AS rating FROM obs WHERE month IN ('1998-04', '1998-05', '1998-06')")
def rsh02(spark, d):
    wide = rsh01(spark, d)
    return W.unpivot_months(wide, ["domain", "listing_id"], MONTHS, ["reviews", "rating"]).filter("reviews is not null")


@query("rsh03_section_rows", f"WITH {OBS}, r AS (SELECT DISTINCT domain, listing_id FROM obs) SELECT domain, 0 AS level, NULL AS listing_id, count(*) AS n FROM r GROUP BY domain UNION ALL SELECT domain, 1, listing_id, 1 FROM r")
def rsh03(spark, d):
    rows = observations(spark, d).select("domain", "listing_id").distinct()
    return W.with_sections(rows, "domain", "listing_id")


@query("rsh04_dense_grid", "WITH c AS (SELECT DISTINCT l_orderkey AS r, l_linenumber AS c FROM lineitem), r AS (SELECT DISTINCT r FROM c) SELECT r.r, k.c, CASE WHEN c.r IS NULL THEN NULL ELSE 1 END AS filled FROM r CROSS JOIN (SELECT unnest(range(1, 8)) AS c) k LEFT JOIN c ON c.r = r.r AND c.c = k.c")
def rsh04(spark, d):
    cells = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("r"), F.col("l_linenumber").cast("long").alias("c"), F.lit(1).alias("filled")).distinct()
    return W.dense(cells, "r", "c", 7, ["filled"])


@query("rsh05_split_by_brand", f"WITH {OBS} SELECT brand, count(DISTINCT listing_id) AS listings, count(*) AS snapshots FROM obs GROUP BY 1")
def rsh05(spark, d):
    return observations(spark, d).groupBy("brand").agg(F.count_distinct("listing_id").alias("listings"), F.count("*").alias("snapshots"))


@query("rsh07_flatten_months", f"WITH {OBS} SELECT domain, listing_id, month, reviews FROM obs")
def rsh07(spark, d):
    nested = observations(spark, d).groupBy("domain", "listing_id").agg(F.map_from_entries(F.collect_list(F.struct("month", "reviews"))).alias("months"))
    return nested.select("domain", "listing_id", F.explode("months").alias("month", "reviews"))


@query("rsh08_column_letters", "SELECT p_partkey, CASE WHEN p_partkey % 702 + 1 > 26 THEN chr(CAST(64 + (p_partkey % 702) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (p_partkey % 702) % 26 AS INTEGER)) AS letters FROM part")
def rsh08(spark, d):
    return table(spark, d, "part").select("p_partkey", column_letters(F.col("p_partkey") % 702 + 1).alias("letters"))
