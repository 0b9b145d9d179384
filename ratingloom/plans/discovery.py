"""Queries of tiles, titles, site profiles and search frontiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spread import spread
from ..registry import query
from ..sources import frontier as R
from ..sources import markup as M
from ..sources import profiling as P
from ..sources import tiles as T
from .bindings import table

#: A listing of an order's lines; a tile in six has two counters, one in five no counter, and links stand in menus as well.
TILE = """concat('<div class="w"><div><a href="/product/p-', p, '/?x=1"><img src="i.png"></a><a href="/product/p-', p, '/">Товар ', p, ' ', repeat('x', CAST(p % 7 AS INT)), '</a></div><p><span>', p % 5, ',', p % 10, '</span>', CASE WHEN p % 5 <> 0 THEN concat('<span>', p % 900, CASE WHEN p % 2 = 0 THEN ' отзывов' ELSE ' оценок' END, '</span>') ELSE '' END, CASE WHEN p % 6 = 1 THEN concat('<b>', p % 900 + 1, ' reviews</b>') ELSE '' END, '</p></div>')"""


def listings(spark, d):
    """A page for each order, with a tile for each of its parts."""
    lines = spread(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey")
    pages = lines.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.collect_set("l_partkey").alias("parts"))
    pages = pages.withColumn("tiles", F.array_join(F.expr(f"transform(sort_array(parts), p -> {TILE})"), ""))
    return pages.select("page_id", F.concat(F.lit('<nav><a href="/help">2</a><span>77 отзывов</span></nav><div id="grid">'), "tiles", F.lit("</div><footer>3,3</footer>")).alias("html"))


@query("ex12_tiles", """WITH t AS (SELECT DISTINCT l_orderkey AS page_id, l_partkey AS p FROM lineitem)
  SELECT t.page_id, CAST(p AS VARCHAR) AS listing_id, concat('Товар ', p, CASE WHEN p % 7 > 0 THEN ' ' || repeat('x', p % 7) ELSE '' END) AS title, CASE WHEN p % 5 <> 0 AND p % 6 = 1 THEN 'several counters' END AS problem,
    CASE WHEN NOT (p % 5 <> 0 AND p % 6 = 1) THEN CASE WHEN p % 5 <> 0 THEN p % 900 WHEN p % 6 = 1 THEN p % 900 + 1 END END AS reviews, CASE WHEN NOT (p % 5 <> 0 AND p % 6 = 1) THEN p % 5 + (p % 10) / 10.0 END AS rating
  FROM t""")
def ex12(spark, d):
    """Tiles of a page's grid; what stands outside it is no tile's."""
    return T.tiles(listings(spark, d), r"/product/p-(\d+)/", within="#grid").select("page_id", "listing_id", "title", "problem", "reviews", "rating")


CARD = """concat('{"', CASE p_partkey % 3 WHEN 0 THEN 'nm_id' WHEN 1 THEN 'nmId' ELSE 'id' END, '":', CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END + p_partkey, ',"imt_name":"', CASE WHEN p_partkey % 7 = 0 THEN 'Иное' ELSE p_brand END, ' капсулы', CASE WHEN p_partkey % 4 = 0 THEN ' №5' WHEN p_partkey % 13 = 0 THEN '...' ELSE '' END, '","options":[{"name":"Цвет","value":"9"},{"name":"Количество в упаковке","value":"', p_size % 30 + 2, '"}]}')"""


@query("ex13_card_titles", "SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND (p_partkey % 4 = 0 OR p_partkey % 13 <> 0) THEN concat(p_brand, ' капсулы №', CASE WHEN p_partkey % 4 = 0 THEN 5 ELSE p_size % 30 + 2 END) END AS title FROM part")
def ex13(spark, d):
    """Titles of cards that are this listing's and name its brand, with the pack of their options."""
    return spread(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").select("p_partkey", T.card_title(F.expr(CARD), F.col("p_partkey").cast("string"), F.col("p_brand")).alias("title"))


REVIEWED = """concat('<div><p class="x Review-ReasonToTrustText">Товар — ', p_brand, ' саше ', p_size, ' мг</p><p class="Review-ReasonToTrustText">Товар — Иное</p><p class="Review-Text">Товар — ', p_brand, ' не то</p></div><script>s={"reasonToTrust":{"text":"Product - ', p_brand, ' \\\\u0442аблетки ', p_size, '"},"reasonToTrust":{"text":"Купил"}}</script>')"""


@query("ex10_reviewed_titles", "SELECT p_partkey, concat(p_brand, ' саше ', p_size, ' мг | ', p_brand, ' таблетки ', p_size) AS titles, concat(p_brand, CASE WHEN p_partkey % 2 = 0 THEN concat(' саше ', p_size, ' мг') ELSE concat(' таблетки ', p_size) END) AS of_form FROM part")
def ex10(spark, d):
    """What a page's reviews are of, and which of it may be of a model in sachets or in tablets."""
    rows = M.with_tree(table(spark, d, "part").select("p_partkey", "p_brand", F.expr(REVIEWED).alias("html")))
    rows = rows.select("p_partkey", T.reviewed_titles(F.col("tree"), F.col("p_brand")).alias("titles"))
    model = F.when(F.col("p_partkey") % 2 == 0, "порошок в саше").otherwise("таблетки для рассасывания")
    fits = F.filter("titles", lambda t: T.of_one_form(model, t))
    return rows.select("p_partkey", F.array_join("titles", " | ").alias("titles"), F.array_join(fits, " | ").alias("of_form"))


@query("ex15_fallback_titles", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('Зорлан ', p_size, ' мг') WHEN 1 THEN 'Общая карточка отзывов' ELSE concat('Отзывчивый ', p_name) END AS title FROM part")
def ex15(spark, d):
    text = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('зорлан, ', p_size, ' мг: отзывы / цена (инструкция  по применению) index.html') WHEN 1 THEN ' Купить — лекарственное средство | аналоги' ELSE concat('отзывчивый [', p_name, '] detail') END")
    return table(spark, d, "part").select("p_partkey", T.fallback_title(text).alias("title"))


#: Pages of one site for each nation: suppliers are pages, of three kinds by key.
SITE_PAGE = """concat('<html><title>', CASE WHEN s_suppkey % 4 = 0 THEN 'Иное' ELSE 'Зорлан' END, '</title><form action="/find" method="GET"><input name="', CASE WHEN s_suppkey % 3 = 0 THEN 'q' ELSE 'search' END, '"></form><a href="/catalog?query=abc&x=1">Каталог</a>',
  CASE WHEN s_nationkey % 2 = 0 THEN '<div class="pagination"><a class="next" href="?page=2">»</a></div>' ELSE '<script>new IntersectionObserver(f)</script>' END, '<div class="', CASE WHEN s_suppkey % 5 = 0 THEN 'catalog-item' ELSE 'product-card' END, '"><a href="/p/zorlan-', s_suppkey, '/', s_suppkey, '">Зорлан</a></div><a href="https://other.example/zorlan">Зорлан</a>',
  CASE WHEN s_suppkey % 3 = 0 THEN '5 оценок' ELSE '5 отзывов' END, '</html>')"""


def site_pages(spark, d):
    rows = table(spark, d, "supplier").select(F.expr("concat('https://n', s_nationkey, '.example/list/', s_suppkey)").alias("url"), F.lit("Зорлан").alias("brand"), F.expr(SITE_PAGE).alias("html"))
    return M.with_tree(rows)


@query("src27_site_profiles", """WITH s AS (SELECT 'n' || s_nationkey || '.example' AS domain, s_nationkey AS k, s_suppkey AS p, s_suppkey % 4 <> 0 AS named, s_suppkey % 3 = 0 AS third, s_suppkey % 5 = 0 AS fifth FROM supplier),
  n AS (SELECT domain, any_value(k) AS k, count(*) AS n, count(*) FILTER (third) AS thirds, count(*) FILTER (fifth) AS fifths, count(*) FILTER (named) AS voters, count(*) FILTER (named AND third) AS ratings, count(*) FILTER (named AND NOT third) AS reviews FROM s GROUP BY 1)
  SELECT domain, n AS n_pages, concat('https://', domain, CASE thirds WHEN n THEN '/find?q={query}' WHEN 0 THEN '/find?search={query}' ELSE '/catalog?query={query}&x=1' END) AS search_template, CASE WHEN fifths > n - fifths THEN '.catalog-item a[href]' ELSE '.product-card a[href]' END AS product_links, CASE WHEN k % 2 = 0 THEN '.pagination a.next' END AS next_page, k % 2 = 1 AS endless, '/p/{s}/{n}' AS link_shape, n AS link_shape_support,
    CASE WHEN voters = 0 THEN 'unknown' WHEN ratings > reviews THEN 'ratings' ELSE 'reviews' END AS meaning, least(n, 12) AS n_examples FROM n""")
def src27(spark, d):
    """Every site's profile from its own pages, by support."""
    found = P.profile_sites(site_pages(spark, d))
    return found.select("domain", "n_pages", "search_template", "product_links", "next_page", "endless", "link_shape", "link_shape_support", "meaning", F.size("examples").cast("long").alias("n_examples"))


@query("ex16_search_templates", """SELECT s_suppkey, concat('https://n', s_nationkey, '.example/find?', CASE WHEN s_suppkey % 3 = 0 THEN 'q' ELSE 'search' END, '={query} https://n', s_nationkey, '.example/catalog?query={query}&x=1') AS templates FROM supplier""")
def ex16(spark, d):
    """Search addresses that forms and links of a page show."""
    rows = site_pages(spark, d)
    return rows.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("s_suppkey"), F.array_join(P.search_templates(F.col("tree"), F.col("url")), " ").alias("templates"))


@query("src26_search_frontier", """WITH o AS (SELECT o_custkey AS search, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
  p AS (SELECT search, count(DISTINCT l_partkey) AS products FROM o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
  SELECT o.search, count(*) AS pages, CAST(floor(log2(max(k))) AS INTEGER) AS depth, true AS exhausted, coalesce(any_value(p.products), 0) AS products FROM o LEFT JOIN p ON p.search = o.search GROUP BY 1""")
def src26_frontier(spark, d):
    """Searches of customers over pages of their orders: page k leads to pages 2k and 2k + 1, and back to its own."""
    from pyspark.sql import Window

    nth = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("k"))
    address = lambda k: F.concat(F.lit("https://c"), F.col("o_custkey").cast("string"), F.lit(".example/s?page="), k.cast("string"))
    pages = nth.select("o_custkey", "o_orderkey", "k", address(F.col("k")).alias("url"), F.max("k").over(Window.partitionBy("o_custkey")).alias("n"))
    links = pages.select("url", F.explode(F.filter(F.array(F.struct((F.col("k") * 2).alias("t")), F.struct((F.col("k") * 2 + 1).alias("t")), F.struct(F.col("k").alias("t"))), lambda s: s["t"] <= F.col("n"))).alias("s"), "o_custkey").select("url", address(F.col("s.t")).alias("next"))
    starts = pages.filter("k = 1").select(F.col("o_custkey").alias("search"), "url")
    products = pages.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("product")), "o_orderkey").select("url", "product")
    return R.discovered(R.follow(starts, links, pages.select("url")), products)
