"""Queries of titles, review decisions and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import projections as P
from ..registry import query
from ..sources import payloads as R
from .bindings import table


@query("sf02_clean_evidence", "SELECT page_id, substr(trim(regexp_replace(nfc_normalize(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '\\s+', ' ', 'g')), 1, 120) AS title FROM pages")
def sf02(spark, d):
    return table(spark, d, "pages").select("page_id", T.cleaned(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), 120).alias("title"))


@query("sf06_remove_names", "SELECT p_partkey, trim(regexp_replace(CASE WHEN contains(' ' || p_name || ' ', ' widget ') THEN replace(' ' || p_name || ' ', ' widget ', ' ') ELSE p_name END, '\\s+', ' ', 'g')) AS rest FROM part")
def sf06(spark, d):
    return table(spark, d, "part").select("p_partkey", T.without_words(F.col("p_name"), ["widget"]).alias("rest"))


@query("sf11_friendly_texts", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'waits for a person' ELSE 'in progress' END AS said FROM orders")
def sf11(spark, d):
    cases = [(F.col("o_orderstatus") == "F", "done"), (F.col("o_orderstatus") == "P", "waits for a person")]
    return table(spark, d, "orders").select("o_orderkey", P.first_case(cases, "in progress").alias("said"))


@query("sf15_fuller_titles", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' 10 шт' ELSE p_name || ' ' || p_type END AS title FROM part")
def sf15(spark, d):
    short = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" 10 шт"))).otherwise(F.concat(F.substring("p_name", 1, 3), F.lit("…")))
    return table(spark, d, "part").select("p_partkey", T.fuller_title(short, F.concat_ws(" ", "p_name", "p_type")).alias("title"))


@query("prj08_accepted_unseen", "SELECT p_partkey, p_size % 3 = 0 AND p_type = 'PROMO' AND p_size > 10 AS accepted FROM part")
def prj08(spark, d):
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_size") % 3 == 0, "ok").otherwise("blocked").alias("status"), F.when(F.col("p_type") == "PROMO", "variant").otherwise("family").alias("granularity"), F.lit("exact").alias("confidence"),
        F.array(F.struct(F.when(F.col("p_size") > 10, "sku").otherwise("ean").alias("type"), F.col("p_partkey").cast("string").alias("value"))).alias("identifiers"),
    )
    return rows.select("p_partkey", P.accepts_itself(rows).alias("accepted"))


@query("prj10_status_after_identity", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'not_found' WHEN p_size % 5 = 0 THEN 'needs_review' ELSE 'ok' END AS status FROM part")
def prj10(spark, d):
    granularity = F.when(F.col("p_size") % 7 == 0, "not_product").when(F.col("p_size") % 5 == 0, "unresolved").otherwise("variant")
    return table(spark, d, "part").select("p_partkey", P.status_after_identity(F.lit("ok"), granularity).alias("status"))


@query("prj11_not_found", "WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'not_found' ELSE 'ok' END AS status, o_custkey AS reviews, o_orderkey % 3 = 0 AS gone, o_custkey % 2 = 0 AS known FROM orders) SELECT id, CASE WHEN status = 'not_found' AND known THEN NULL ELSE reviews END AS reviews, status = 'not_found' AND known AS historical, CASE WHEN status = 'not_found' AND NOT known THEN 'needs_review' ELSE status END AS status FROM r WHERE NOT (status = 'not_found' AND NOT known AND gone)")
def prj11(spark, d):
    orders = table(spark, d, "orders")
    rows = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "not_found").otherwise("ok").alias("status"), F.col("o_custkey").alias("reviews"), (F.col("o_orderkey") % 3 == 0).alias("explicitly_missing"))
    return P.settle_not_found(rows, orders.filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("id")), ["id"]).select("id", "reviews", "historical", "status")


@query("prj12_confirmable", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority NOT LIKE '1%'")
def prj12(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "needs_review").otherwise("ok")
    problem = F.when(F.col("o_orderpriority").startswith("1"), "blocked")
    return table(spark, d, "orders").filter(P.a_person_can_confirm(status, F.col("o_custkey"), problem)).select("o_orderkey")


@query("ex02_next_pages", "SELECT page_id, concat('https://s', page_id, '.example/', CASE WHEN page_id % 3 = 0 THEN 'next' ELSE 'list' END, '?page=', page_id % 5 + 2) AS next FROM pages WHERE page_id % 4 <> 3")
def ex02(spark, d):
    """Links of a made-up page for each page: one that leads on, unless it leads to another site; a bare one and a relative one."""
    site = "concat('https://', CASE WHEN page_id % 4 = 3 THEN 'other' ELSE concat('s', page_id) END, '.example')"
    onward = f"concat('<a href=\"', CASE WHEN page_id % 4 = 3 THEN {site} ELSE '' END, CASE WHEN page_id % 3 = 0 THEN '/next' ELSE '/list' END, '?page=', page_id % 5 + 2, '#top\">2</a>')"
    html = F.expr(f"concat('<a href=\"/about\">about</a> ', {onward}, ' <a class=\"x\" href=\"/item/', page_id, '\">item</a>')")
    return R.next_pages(table(spark, d, "pages").select("page_id", F.expr("concat('https://s', page_id, '.example')").alias("url"), html.alias("html")))


@query("ex04_absolute_links", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat(regexp_extract(u, '^(https://[^/]+)', 1), '/x/', page_id) WHEN 1 THEN concat('https:', regexp_extract(u, '^https:(//[^/]+)', 1), '/y') WHEN 2 THEN concat(regexp_replace(u, '/[^/]*$', ''), '/z') END AS link FROM (SELECT page_id, concat('https://', regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '/list/', page_id) AS u FROM pages)")
def ex04(spark, d):
    """Rooted, scheme-less and relative links of every page's own address; those of another site are none."""
    base = F.concat(F.lit("https://"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.lit("/list/"), F.col("page_id").cast("string"))
    href = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/x/"), F.col("page_id").cast("string"), F.lit("#top"))).when(F.col("page_id") % 4 == 1, F.concat(F.regexp_extract(base, "^https:(//[^/]+)", 1), F.lit("/y"))).when(F.col("page_id") % 4 == 2, "z").otherwise("https://elsewhere.example/z")
    return table(spark, d, "pages").select("page_id", R.absolute(href, base).alias("link"))


@query("ex06_telling_attributes", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Форма выпуска' WHEN 1 THEN 'Дозировка' ELSE 'Pack size' END AS name FROM part WHERE p_partkey % 6 IN (0, 1, 4)")
def ex06(spark, d):
    name = "CASE p_partkey % 6 WHEN 0 THEN 'Форма выпуска' WHEN 1 THEN 'Дозировка' WHEN 2 THEN 'Цена за упаковку' WHEN 3 THEN 'Отзывы' WHEN 4 THEN 'Pack size' ELSE p_name END"
    return R.telling_attributes(table(spark, d, "part").select("p_partkey", F.expr(name).alias("name")))


@query("ex18_readiness", "SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS read, count(*) FILTER (o_orderstatus = 'P') AS waiting, count(*) = count(*) FILTER (o_orderstatus <> 'P') AS ready FROM orders GROUP BY 1")
def ex18(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "P", "needs_review").otherwise("ok").alias("status"))
    return P.ready_to_publish(rows, "o_custkey")
