"""Queries of the payload readers and extraction helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import normalize_text, without_tags
from ..operators import identity
from ..operators.joins import by_words
from ..registry import query
from ..sources import payloads as R
from ..sources.connectors import STANDARD
from .bindings import table


def pages(spark, d):
    return table(spark, d, "pages")


@query("ex01_anchors", "SELECT page_id, len(regexp_extract_all(html, '(?is)<a\\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>', 1)) AS anchors, array_to_string(list_transform(regexp_extract_all(html, '(?is)<a\\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>', 1), lambda x: x), ' ') AS hrefs FROM pages")
def ex01(spark, d):
    found = R.anchors(pages(spark, d)).groupBy("page_id").agg(F.count("*").alias("anchors"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "href"))), lambda s: s["href"]), " ").alias("hrefs"))
    return pages(spark, d).select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("anchors", F.lit(0)).alias("anchors"), F.coalesce("hrefs", F.lit("")).alias("hrefs"))


@query("ex03_sole_candidate", "WITH c AS (SELECT l_orderkey AS page, l_partkey AS id, l_linenumber = 1 AS exact FROM lineitem), s AS (SELECT page, count(*) AS n, count(*) FILTER (exact) AS hits, max(id) FILTER (exact) AS hit, max(id) AS any_id FROM c GROUP BY 1) SELECT page, CASE WHEN hits = 1 THEN hit WHEN hits = 0 AND n = 1 THEN any_id END AS id, CASE WHEN hits = 1 OR (hits = 0 AND n = 1) THEN 'bound' ELSE 'ambiguous' END AS outcome FROM s")
def ex03(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("id"), (F.col("l_linenumber") == 1).alias("exact"))
    return identity.sole(rows, "page", "id", "exact")


@query("ex07_non_product_pages", "SELECT page_id, regexp_matches(url, '/(de|fr)/') AS listing FROM pages")
def ex07(spark, d):
    return pages(spark, d).select("page_id", F.col("url").rlike("/(de|fr)/").alias("listing"))


@query("ex08_explicit_empty", "SELECT page_id, CASE WHEN html ILIKE '%not found%' OR html ILIKE '%no results%' THEN 'empty' WHEN html ILIKE '%<article%' THEN 'present' ELSE 'unknown' END AS proof FROM pages")
def ex08(spark, d):
    html = F.lower("html")
    return pages(spark, d).select("page_id", F.when(html.contains("not found") | html.contains("no results"), "empty").when(html.contains("<article"), "present").otherwise("unknown").alias("proof"))


@query("ex09_block_pages", "SELECT page_id, regexp_matches(lower(html), 'captcha|access denied|are you a robot') AS blocked FROM pages")
def ex09(spark, d):
    return pages(spark, d).select("page_id", F.lower("html").rlike("captcha|access denied|are you a robot").alias("blocked"))


@query("ex11_variant_groups", "SELECT l_orderkey, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS group_id FROM (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem) GROUP BY 1")
def ex11(spark, d):
    ids = F.array_sort(F.collect_set("l_partkey"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("group_id"))


@query("ex14_brand_of_title", "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_brand ELSE 'unbranded' END AS brand FROM part")
def ex14(spark, d):
    """The prefix that a stored title has, else the known brand that stands in it, else none."""
    parts = table(spark, d, "part")
    titles = parts.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" — ", "p_brand", "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", "p_name", "p_brand", F.lit("отзывы"))).otherwise(F.col("p_name")).alias("title"))
    stored = F.nullif(F.regexp_extract("title", r"^(.{1,80}?)\s+[—–]\s+\S", 1), F.lit(""))
    brands = parts.select(F.col("p_brand").alias("named"), normalize_text(F.col("p_brand")).alias("known")).distinct()
    met = by_words(titles.select("p_partkey", normalize_text(F.col("title")).alias("words")), "p_partkey", "words", brands.select("known"), "known").join(brands, "known")
    met = met.groupBy("p_partkey").agg(F.max_by("named", F.length("known")).alias("named"))
    return titles.join(met, "p_partkey", "left").select("p_partkey", F.coalesce(stored, "named", F.lit("unbranded")).alias("brand"))


@query("ex19_custom_sites", "SELECT count(*) AS custom FROM nation WHERE n_name NOT IN ('NATION_1', 'NATION_2')")
def ex19(spark, d):
    known = spark.createDataFrame([("NATION_1",), ("NATION_2",)], "n_name string")
    return table(spark, d, "nation").join(F.broadcast(known), "n_name", "left_anti").agg(F.count("*").alias("custom"))


@query("ex20_request_checks", "SELECT c_custkey, CASE WHEN length(c_name) > 40 THEN 'long' WHEN NOT regexp_matches(c_name, '^[A-Za-z0-9#]+$') THEN 'token' ELSE 'fine' END AS verdict FROM customer")
def ex20(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.length("c_name") > 40, "long").when(~F.col("c_name").rlike("^[A-Za-z0-9#]+$"), "token").otherwise("fine").alias("verdict"))


@query("ex21_chunks_of_eight", "SELECT conv_id, turn // 8 AS chunk, count(*) AS n FROM conversations GROUP BY 1, 2")
def ex21(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 8).alias("chunk")).agg(F.count("*").alias("n"))


@query("fmt06_visible_counts", "SELECT page_id, length(html) AS n_html, length(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS n_title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def fmt06(spark, d):
    return pages(spark, d).select("page_id", F.length("html").alias("n_html"), F.length(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("n_title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))


@query("fmt08_sitemap_locations", "SELECT page_id, url FROM pages")
def fmt08(spark, d):
    xml = F.concat(F.lit("<urlset><url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url></urlset>"))
    return pages(spark, d).select("page_id", F.explode(R.locations(xml)).alias("url"))


@query("fmt10_nested_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def fmt10(spark, d):
    outer = F.to_json(F.struct(F.col("props").alias("state")))
    inner = F.try_variant_get(F.try_parse_json(outer), "$.state", "string")
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json(inner), "$.k", "int").alias("k"))


@query("fmt11_alternative_paths", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.data.k') AS INTEGER), CAST(json_extract_string(props, '$.k') AS INTEGER)) AS k FROM events")
def fmt11(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.data.k", "int"), F.try_variant_get(v, "$.k", "int")).alias("k"))


@query("fmt13_columns_to_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def fmt13(spark, d):
    packed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    columns = table(spark, d, "lineitem").groupBy("l_orderkey").agg(packed.alias("s")).select("l_orderkey", F.col("s.l_linenumber").alias("l_linenumber"), F.col("s.l_partkey").alias("l_partkey"))
    return R.rows_of_columns(columns, ["l_linenumber", "l_partkey"])


@query("fmt01_json_ld_products", "SELECT p_partkey AS page_id, p_name AS name, CAST(p_partkey AS VARCHAR) AS sku, CAST(NULL AS VARCHAR) AS url, CAST(p_size % 5 + 1 AS DOUBLE) AS rating, CAST(NULL AS DOUBLE) AS best, CAST(p_size AS BIGINT) AS reviews, CAST(NULL AS BIGINT) AS ratings FROM part")
def fmt01(spark, d):
    """Products of JSON-LD made of the parts table, as pages carry it."""
    product = F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("sku"), F.struct(F.lit("AggregateRating").alias("@type"), (F.col("p_size") % 5 + 1).alias("ratingValue"), F.col("p_size").alias("reviewCount")).alias("aggregateRating"))
    html = F.concat(F.lit('<html><script type="application/ld+json">{"@graph":['), F.to_json(product), F.lit("]}</script></html>"))
    return R.json_ld(table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@query("fmt04_microdata_products", "SELECT p_partkey AS page_id, p_name AS name, CAST(NULL AS VARCHAR) AS sku, CAST(NULL AS VARCHAR) AS url, CAST(p_size % 5 + 1 AS DOUBLE) AS rating, CAST(NULL AS DOUBLE) AS best, CAST(p_size AS BIGINT) AS reviews, CAST(NULL AS BIGINT) AS ratings FROM part")
def fmt04(spark, d):
    html = F.format_string('<div itemscope><span itemprop="name">%s</span><meta itemprop="ratingValue" content="%d"><meta itemprop="reviewCount" content="%d"></div>', F.col("p_name"), F.col("p_size") % 5 + 1, F.col("p_size"))
    return R.microdata(table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@query("fmt16_table_cells", """SELECT p_partkey, r, c, text FROM (SELECT p_partkey, 0 AS r, 0 AS c, p_brand AS text FROM part UNION ALL SELECT p_partkey, 0, 1, p_name FROM part UNION ALL SELECT p_partkey, 1, 0, '' FROM part UNION ALL SELECT p_partkey, 1, 1, CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT p_partkey, 2, 0, p_type FROM part UNION ALL SELECT p_partkey, 2, 1, '' FROM part)""")
def fmt16(spark, d):
    """A table of each part, with a cell over two rows and one over two columns."""
    html = F.format_string('<p>x</p><table><tr><td rowspan="2">%s</td><th>%s</th></tr><tr><td> <b>%d</b> </td></tr><tr><td colspan="2">%s</td></tr></table>', "p_brand", "p_name", "p_size", "p_type")
    return R.table_cells(table(spark, d, "part").select("p_partkey", html.alias("html")), "p_partkey")


@query("fmt19_robots_rules", "SELECT page_id, NOT (starts_with(p, '/de') AND NOT starts_with(p, '/de/1')) AS allowed FROM (SELECT page_id, '/' || split_part(url, '/', 4) || '/' || split_part(url, '/', 5) AS p FROM pages)")
def fmt19(spark, d):
    path = F.concat(F.lit("/"), F.split_part("url", F.lit("/"), F.lit(4)), F.lit("/"), F.split_part("url", F.lit("/"), F.lit(5)))
    return pages(spark, d).select("page_id", R.robots_allowed(F.lit("User-agent: *\nDisallow: /de\nAllow: /de/1\n"), path).alias("allowed"))


@query("src02_connectors", "SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[a-z]+://(?:www\\.)?([^/?#:]+)', 1)), '^reviews\\.', 'market.') AS domain, 'generic' AS connector FROM pages")
def src02(spark, d):
    return STANDARD.resolve(pages(spark, d).select(U.domain(F.col("url")).alias("domain")).distinct())


@query("src26_generic_collect", """WITH q AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages), p AS (SELECT page_id, url, regexp_replace(bare, '\\?.*$', '') AS path, list_filter(string_split(CASE WHEN contains(bare, '?') THEN regexp_extract(bare, '\\?(.*)$', 1) ELSE '' END, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_|yclid$|gclid$|srsltid$|at$|from$|ref)')) AS kept FROM q)
  SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://(?:www\\.)?([^/?#:]+)', 1)), '^reviews\\.', 'market.') AS domain, substr(sha256(url), 1, 20) AS listing_id, CASE WHEN len(kept) > 0 THEN path || '?' || array_to_string(kept, '&') ELSE path END AS canonical_url,
    CAST(NULL AS VARCHAR) AS product, CAST(NULL AS BIGINT) AS reviews, CAST(NULL AS BIGINT) AS rating_count, CAST(NULL AS DOUBLE) AS raw_rating, CAST(NULL AS DOUBLE) AS raw_rating_scale, CAST(NULL AS DOUBLE) AS rating, 'not_found' AS status FROM p""")
def src26(spark, d):
    return STANDARD.collect(pages(spark, d))


@query("fmt07_visible_text_sizes", """SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))) AS n_visible FROM pages""")
def fmt07(spark, d):
    return pages(spark, d).select("page_id", F.length(without_tags(F.col("html"))).alias("n_visible"))
