"""Queries of the joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import folded
from ..operators import joins as J
from ..operators.checks import assert_none
from ..registry import query
from .bindings import EXPECTED, OBS, PARTITIONS, RATING, expected, observations, partitions, rating, table

MONTH, BEFORE = "1998-06", "1998-05"


@query("jn01_expected_partitions", f"WITH {EXPECTED} SELECT domain, brand FROM expected")
def jn01(spark, d):
    return expected(spark, d)


@query("jn02_previous_partitions", f"WITH {PARTITIONS}, {EXPECTED} SELECT e.domain, e.brand, coalesce(p.discovered, 0) AS discovered, CASE WHEN p.domain IS NULL THEN 'pending' ELSE 'complete' END AS status FROM expected e LEFT JOIN parts p ON p.domain = e.domain AND p.brand = e.brand")
def jn02(spark, d):
    done = partitions(spark, d).withColumn("seen", F.lit(True))
    joined = expected(spark, d).join(done, ["domain", "brand"], "left")
    return joined.select("domain", "brand", F.coalesce("discovered", F.lit(0)).alias("discovered"), F.when(F.col("seen").isNull(), "pending").otherwise("complete").alias("status"))


@query("jn03_never_executed", f"WITH {OBS}, {EXPECTED} SELECT e.domain, e.brand FROM expected e WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.domain = e.domain AND o.brand = e.brand AND o.month = '{MONTH}')")
def jn03(spark, d):
    done = observations(spark, d, [MONTH])
    return expected(spark, d).join(done, ["domain", "brand"], "left_anti")


@query("jn04_preserved_observations", f"WITH {PARTITIONS} SELECT o.domain, o.listing_id, o.month, o.reviews FROM obs o WHERE EXISTS (SELECT 1 FROM parts p WHERE p.domain = o.domain AND p.brand = o.brand AND p.collected * 50 >= p.discovered)")
def jn04(spark, d):
    kept = partitions(spark, d).filter("collected * 50 >= discovered")
    return observations(spark, d).join(kept, ["domain", "brand"], "left_semi").select("domain", "listing_id", "month", "reviews")


@query("jn05_without_excluded", f"WITH {PARTITIONS} SELECT o.domain, o.listing_id, o.month, o.reviews FROM obs o WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.domain = o.domain AND p.brand = o.brand AND p.collected = 0)")
def jn05(spark, d):
    excluded = partitions(spark, d).filter("collected = 0")
    return observations(spark, d).join(excluded, ["domain", "brand"], "left_anti").select("domain", "listing_id", "month", "reviews")


@query("jn06_registry_of_partition", f"WITH {PARTITIONS} SELECT o.domain, o.brand, o.listing_id, min(o.month) AS first_month, max(p.discovered) AS discovered FROM obs o JOIN parts p ON p.domain = o.domain AND p.brand = o.brand GROUP BY 1, 2, 3")
def jn06(spark, d):
    registry = observations(spark, d).groupBy("domain", "brand", "listing_id").agg(F.min("month").alias("first_month"))
    return registry.join(partitions(spark, d).select("domain", "brand", "discovered"), ["domain", "brand"])


@query("jn07_previous_record", f"WITH {OBS} SELECT n.domain, n.listing_id, n.reviews, p.reviews AS previous_reviews FROM obs n LEFT JOIN obs p ON p.domain = n.domain AND p.listing_id = n.listing_id AND p.month = '{BEFORE}' WHERE n.month = '{MONTH}'")
def jn07(spark, d):
    obs = observations(spark, d, [BEFORE, MONTH])
    before = obs.filter(F.col("month") == BEFORE).select("domain", "listing_id", F.col("reviews").alias("previous_reviews"))
    return obs.filter(F.col("month") == MONTH).join(before, ["domain", "listing_id"], "left").select("domain", "listing_id", "reviews", "previous_reviews")


@query("jn08_registry_upsert", f"""WITH {OBS}, old AS (SELECT domain, listing_id, min(month) AS first_seen, max(month) AS last_seen FROM obs WHERE month < '{MONTH}' GROUP BY 1, 2),
  new AS (SELECT domain, listing_id, min(month) AS first_seen, max(month) AS last_seen FROM obs WHERE month = '{MONTH}' GROUP BY 1, 2)
  SELECT coalesce(n.domain, o.domain) AS domain, coalesce(n.listing_id, o.listing_id) AS listing_id, coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(n.last_seen, o.last_seen) AS last_seen
  FROM old o FULL JOIN new n ON o.domain = n.domain AND o.listing_id = n.listing_id""")
def jn08(spark, d):
    # Both sides of the merge come of one table, so it is one aggregate of that table and no join.
    return J.upsert_within(observations(spark, d).filter(F.col("month") <= MONTH), F.col("month") == MONTH, ["domain", "listing_id"], {"first_seen": F.min("month"), "last_seen": F.max("month")}, prefer_old=("first_seen",))


@query("jn09_months_onto_products", f"""WITH {OBS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY domain, listing_id ORDER BY CASE WHEN month = '{MONTH}' THEN 1 ELSE 0 END DESC, month DESC) AS n FROM obs)
  SELECT domain, listing_id, month AS attribute_month, reviews, {RATING} AS rating_x100 FROM ranked WHERE n = 1""")
def jn09(spark, d):
    requested = (F.col("month") == MONTH).cast("int")
    last = J.latest_by(observations(spark, d), ["domain", "listing_id"], [requested.desc(), F.col("month").desc()])
    return last.select("domain", "listing_id", F.col("month").alias("attribute_month"), "reviews", rating().alias("rating_x100"))


@query("jn10_names_in_titles", "WITH words AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part), t AS (SELECT p_partkey, lower(p_name) AS title FROM part) SELECT p_partkey, name FROM t JOIN words ON contains(' ' || title || ' ', ' ' || lower(name) || ' ')")
def jn10(spark, d):
    parts = table(spark, d, "part")
    names = parts.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")).distinct()
    return J.by_words(parts.select("p_partkey", F.lower("p_name").alias("title")), "p_partkey", "title", names.select(F.lower("name").alias("name")), "name")


@query("jn11_ids_in_shards", "WITH shards AS (SELECT s_suppkey AS shard, s_suppkey * 37 AS low, s_suppkey * 37 + 60 AS high FROM supplier) SELECT o_orderkey, shard FROM orders JOIN shards ON o_orderkey BETWEEN low AND high")
def jn11(spark, d):
    shards = table(spark, d, "supplier").select(F.col("s_suppkey").alias("shard"), (F.col("s_suppkey") * 37).alias("low"), (F.col("s_suppkey") * 37 + 60).alias("high"))
    return J.in_range(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", shards, "low", "high", 64).select("o_orderkey", "shard")


@query("jn12_slug_prefix", "WITH seg AS (SELECT p_partkey, replace(lower(p_name), ' ', '-') AS segment FROM part), slugs AS (SELECT DISTINCT split_part(lower(p_name), ' ', 1) AS slug FROM part) SELECT p_partkey, slug FROM seg JOIN slugs ON segment = slug OR starts_with(segment, slug || '-')")
def jn12(spark, d):
    parts = table(spark, d, "part")
    slugs = parts.select(F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1)).alias("slug")).distinct()
    # A slug is a whole number of dash-parted words, so each segment's heads are the only slugs that can match.
    words = F.split(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), "-")
    heads = parts.select("p_partkey", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), "-"))).alias("slug"))
    return heads.join(slugs, "slug").select("p_partkey", "slug")


@query("jn13_brand_aliases", "SELECT p_partkey, p_brand AS brand, lower(p_brand) || ',' || replace(lower(p_brand), '#', ' ') AS aliases FROM part")
def jn13(spark, d):
    parts = table(spark, d, "part")
    brands = parts.select(F.col("p_brand").alias("brand")).distinct()
    dim = brands.select("brand", F.array_join(F.array_distinct(F.array(F.lower("brand"), F.replace(F.lower("brand"), F.lit("#"), F.lit(" ")))), ",").alias("aliases"))
    return parts.select("p_partkey", F.col("p_brand").alias("brand")).join(dim, "brand").select("p_partkey", "brand", "aliases")


@query("jn14_append_history", f"WITH {OBS}, now AS (SELECT DISTINCT domain, listing_id FROM obs WHERE month = '{MONTH}'), past AS (SELECT DISTINCT domain, listing_id FROM obs WHERE month < '{MONTH}') SELECT domain, listing_id, false AS historical FROM now UNION ALL SELECT domain, listing_id, true FROM past p WHERE NOT EXISTS (SELECT 1 FROM now n WHERE n.domain = p.domain AND n.listing_id = p.listing_id)")
def jn14(spark, d):
    obs = observations(spark, d)
    refs = lambda rows, old: rows.select("domain", "listing_id").distinct().withColumn("historical", F.lit(old))
    return J.append_missing(refs(obs.filter(F.col("month") == MONTH), False), refs(obs.filter(F.col("month") < MONTH), True), ["domain", "listing_id"])


@query("jn15_rebind_listing", "SELECT l_orderkey, l_linenumber, p_name AS product FROM lineitem JOIN part ON p_partkey = l_partkey")
def jn15(spark, d):
    refs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id"))
    found = refs.join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("product")), "id", "left")
    return assert_none(found, F.col("product").isNull(), "a reference has no listing").select("l_orderkey", "l_linenumber", "product")


@query("jn16_publishable_items", f"WITH {PARTITIONS} SELECT o.domain, o.listing_id, o.month FROM obs o WHERE o.reviews > 1 AND EXISTS (SELECT 1 FROM parts p WHERE p.domain = o.domain AND p.brand = o.brand AND p.collected > 0)")
def jn16(spark, d):
    good = partitions(spark, d).filter("collected > 0")
    return observations(spark, d).filter(F.col("reviews") > 1).join(good, ["domain", "brand"], "left_semi").select("domain", "listing_id", "month")


@query("jn17_cell_diff", """WITH a AS (SELECT o_orderkey AS r, 1 AS c, o_orderstatus AS t, o_totalprice AS v FROM orders WHERE o_orderkey % 7 <> 0),
  b AS (SELECT o_orderkey AS r, 1 AS c, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS t, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 5 <> 0)
  SELECT coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, CASE WHEN b.r IS NULL THEN 'missing' WHEN a.r IS NULL THEN 'unexpected' WHEN a.t IS DISTINCT FROM b.t THEN 'text' ELSE 'number' END AS kind
  FROM a FULL JOIN b ON a.r = b.r AND a.c = b.c WHERE a.r IS NULL OR b.r IS NULL OR a.t IS DISTINCT FROM b.t OR NOT (abs(a.v - b.v) <= 1e-9)""")
def jn17(spark, d):
    cells = table(spark, d, "orders").select(F.col("o_orderkey").alias("r"), F.lit(1).alias("c"), F.col("o_orderstatus").alias("t"), F.col("o_totalprice").alias("v"))
    found = cells.withColumn("t", F.when(F.col("r") % 11 == 0, "X").otherwise(F.col("t"))).withColumn("v", F.when(F.col("r") % 13 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return J.cell_diff(cells.filter("r % 7 <> 0"), found.filter("r % 5 <> 0"), ["r", "c"], "t", "v")


@query("jn18_undominated_variants", """WITH v AS (SELECT p_brand AS brand, p_partkey AS k, list_distinct(string_split(p_name, ' ')) AS t FROM part UNION ALL SELECT p_brand, -p_partkey - 1, [split_part(p_name, ' ', 1)] FROM part)
  SELECT brand, k FROM v WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.brand = v.brand AND len(o.t) > len(v.t) AND list_has_all(o.t, v.t))""")
def jn18(spark, d):
    parts = table(spark, d, "part")
    words = F.split("p_name", " ")
    rich = parts.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("k"), F.array_distinct(words).alias("t"))
    poor = parts.select(F.col("p_brand").alias("brand"), (-F.col("p_partkey") - 1).alias("k"), F.array(F.element_at(words, 1)).alias("t"))
    return J.undominated(rich.union(poor), ["brand"], "t", "k").select("brand", "k")


@query("jn19_proven_by_siblings", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE CASE WHEN min(CASE WHEN p_size % 3 = 0 THEN p_type END) OVER w = max(CASE WHEN p_size % 3 = 0 THEN p_type END) OVER w THEN min(CASE WHEN p_size % 3 = 0 THEN p_type END) OVER w END END AS proven FROM part WINDOW w AS (PARTITION BY p_brand, p_name)")
def jn19(spark, d):
    known = F.when(F.col("p_size") % 3 == 0, F.col("p_type"))
    sole = table(spark, d, "part").groupBy("p_brand", "p_name").agg(F.min(known).alias("least"), F.max(known).alias("most"))
    joined = table(spark, d, "part").join(sole, ["p_brand", "p_name"])
    return joined.select("p_partkey", F.coalesce(known, F.when(F.col("least") == F.col("most"), F.col("least"))).alias("proven"))


@query("jn20_family_inherits", "WITH e AS (SELECT p_brand, count(DISTINCT p_type) AS n, min(p_type) AS sole FROM part WHERE p_size <= 2 GROUP BY 1) SELECT p_partkey, CASE WHEN p_size <= 2 THEN p_type WHEN n = 1 THEN sole END AS inherited FROM part LEFT JOIN e USING (p_brand)")
def jn20(spark, d):
    return J.inherit_sole(table(spark, d, "part"), "p_brand", "p_type", F.col("p_size") <= 2).select("p_partkey", "inherited")


@query("jn21_overlapping_merges", """WITH m AS (SELECT s_suppkey AS k, s_nationkey AS tab, s_suppkey % 17 AS r0, s_suppkey % 17 + 1 + s_suppkey % 4 AS r1, s_suppkey % 11 AS c0, s_suppkey % 11 + 1 + s_suppkey % 3 AS c1 FROM supplier)
  SELECT a.tab, a.k AS first, b.k AS second FROM m a JOIN m b ON a.tab = b.tab AND a.k < b.k AND a.r0 < b.r1 AND b.r0 < a.r1 AND a.c0 < b.c1 AND b.c0 < a.c1""")
def jn21(spark, d):
    k = F.col("s_suppkey")
    merges = table(spark, d, "supplier").select(k.alias("k"), F.col("s_nationkey").alias("tab"), (k % 17).alias("r0"), (k % 17 + 1 + k % 4).alias("r1"), (k % 11).alias("c0"), (k % 11 + 1 + k % 3).alias("c1"))
    return J.overlapping(merges, "k", ["tab"], ("r0", "r1", "c0", "c1"))


@query("jn22_profile_version", "WITH p AS (SELECT n_nationkey AS k, n_nationkey % 4 AS version, CASE WHEN n_nationkey % 5 = 0 THEN 'draft' ELSE 'approved' END AS status FROM nation) SELECT s_suppkey, CASE WHEN p.k IS NULL THEN 'missing' WHEN p.status <> 'approved' THEN 'unapproved' ELSE 'changed' END AS problem FROM supplier LEFT JOIN p ON p.k = s_nationkey WHERE p.k IS NULL OR p.status <> 'approved' OR p.version <> s_suppkey % 4")
def jn22(spark, d):
    profiles = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_nationkey") % 4).alias("version"), F.when(F.col("n_nationkey") % 5 == 0, "draft").otherwise("approved").alias("status"))
    joined = table(spark, d, "supplier").join(profiles, "s_nationkey", "left")
    problem = F.when(F.col("status").isNull(), "missing").when(F.col("status") != "approved", "unapproved").when(F.col("version") != F.col("s_suppkey") % 4, "changed")
    return joined.select("s_suppkey", problem.alias("problem")).filter("problem is not null")


@query("jn23_brand_set_equality", "WITH a AS (SELECT DISTINCT p_brand AS brand FROM part WHERE p_size < 49), b AS (SELECT DISTINCT p_brand AS brand FROM part WHERE p_size > 48 OR p_brand LIKE '%1%') SELECT coalesce(a.brand, b.brand) AS brand, CASE WHEN a.brand IS NULL THEN 'second' ELSE 'first' END AS side FROM a FULL JOIN b ON a.brand = b.brand WHERE a.brand IS NULL OR b.brand IS NULL")
def jn23(spark, d):
    brands = table(spark, d, "part").withColumnRenamed("p_brand", "brand")
    return J.one_sided(brands.filter("p_size < 49"), brands.filter("p_size > 48 or brand like '%1%'"), ["brand"])


@query("jn24_key_collisions", "WITH c AS (SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1) SELECT p_partkey, p_name AS key, p_brand AS owner, 'needs_review' AS status FROM part WHERE p_name IN (SELECT p_name FROM c)")
def jn24(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("key"), F.col("p_brand").alias("owner"))
    return J.collisions(rows, "key", "owner").select("p_partkey", "key", "owner", F.lit("needs_review").alias("status"))


@query("st01_union_of_months", f"WITH {OBS} SELECT month FROM obs WHERE reviews > 1 UNION SELECT strftime(o_orderdate, '%Y-%m') FROM orders UNION SELECT '2002-01'")
def st01(spark, d):
    months = observations(spark, d).filter("reviews > 1").select("month")
    return months.union(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM"))).union(spark.createDataFrame([("2002-01",)], "month string")).distinct()


@query("st02_union_of_refs", "SELECT id, min(rank) AS source_rank FROM (SELECT o_custkey AS id, 1 AS rank FROM orders UNION ALL SELECT l_partkey, 2 FROM lineitem UNION ALL SELECT p_partkey, 3 FROM part) GROUP BY id")
def st02(spark, d):
    source = lambda name, column, rank: table(spark, d, name).select(F.col(column).alias("id"), F.lit(rank).alias("rank"))
    found = source("orders", "o_custkey", 1).unionByName(source("lineitem", "l_partkey", 2)).unionByName(source("part", "p_partkey", 3))
    return found.groupBy("id").agg(F.min("rank").alias("source_rank"))


@query("st03_except_both_ways", "SELECT k, 'missing' AS side FROM (SELECT p_size AS k FROM part EXCEPT ALL SELECT p_partkey % 60 FROM part) UNION ALL SELECT k, 'extra' FROM (SELECT p_partkey % 60 AS k FROM part EXCEPT ALL SELECT p_size FROM part)")
def st03(spark, d):
    side = lambda k: table(spark, d, "part").select(k.cast("long").alias("k"))
    a, b = side(F.col("p_size")), side(F.col("p_partkey") % 60)
    return a.exceptAll(b).withColumn("side", F.lit("missing")).union(b.exceptAll(a).withColumn("side", F.lit("extra")))


@query("st04_valid_selection", "SELECT p_partkey AS id FROM part WHERE p_size > 20 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def st04(spark, d):
    return table(spark, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("id")).intersect(table(spark, d, "lineitem").filter("l_quantity > 40").select("l_partkey"))


@query("st05_symmetric_toggle", "WITH s AS (SELECT DISTINCT p_brand AS brand FROM part WHERE p_size < 30), t AS (SELECT DISTINCT p_brand AS brand FROM part WHERE p_brand LIKE '%2%') (SELECT brand FROM s EXCEPT SELECT brand FROM t) UNION (SELECT brand FROM t EXCEPT SELECT brand FROM s)")
def st05(spark, d):
    brands = table(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_size")
    chosen, toggled = brands.filter("p_size < 30").select("brand").distinct(), brands.filter("brand like '%2%'").select("brand").distinct()
    return chosen.join(toggled, "brand", "left_anti").union(toggled.join(chosen, "brand", "left_anti"))


@query("st06_subset_of_modifiers", "SELECT p_partkey, list_has_all(['small', 'large', 'widget', 'gear', 'bolt'], string_split(lower(p_name), ' ')) AS plain FROM part")
def st06(spark, d):
    allowed = F.array(*map(F.lit, ("small", "large", "widget", "gear", "bolt")))
    return table(spark, d, "part").select("p_partkey", (F.size(F.array_except(F.split(folded(F.col("p_name")), " "), allowed)) == 0).alias("plain"))
