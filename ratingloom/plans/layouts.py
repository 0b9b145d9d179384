"""Queries of site layouts, over a page of each part in the layout of one site or another.

n counts a page's reviews, none for every seventh size; the score is the parts' own. What a page says elsewhere, of other
products or of whole groups, is written in as well and must not be read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spread import spread
from ..registry import query
from ..sources import layouts as L
from ..sources import markup as M
from .bindings import table

N = "(CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size END)"
SCORE = "concat(p_size % 4 + 1, '.', p_size % 10)"
SCORED = "(p_size % 4 + 1 + (p_size % 10) / 10.0)"
WHOLE = "(p_size % 5 + 1)"
H1 = "concat('<h1>', p_brand, ' гель</h1>')"
LD = f"""concat('<script type="application/ld+json">[{{"@type":"Product","name":"', p_brand, '","sku":"', p_partkey, '","aggregateRating":{{"@type":"AggregateRating","reviewCount":"', {N}, '","ratingValue":', {SCORE}, '}}}}]</script>')"""
MICRO = f"""concat('<div itemprop="aggregateRating"><meta itemprop="reviewCount" content="', {N}, '"><meta itemprop="ratingValue" content="', {SCORE}, '"></div>')"""
EACH = f"CASE WHEN {N} = 0 THEN array() ELSE transform(sequence(1, CAST({N} AS INT)), i -> concat({{0}}, i, {{1}}, {WHOLE}, {{2}})) END"


def items(before: str, between: str, after: str, join: str) -> str:
    return f"array_join({EACH.format(repr(before), repr(between), repr(after))}, '{join}')"


#: Site: address, page, identifier, and the score that the page shows.
MARKETS = {
    "ozon.ru": ("concat('https://www.ozon.ru/product/p-', p_partkey, '/')", f"concat({H1}, {LD})", "CAST(p_partkey AS VARCHAR)", SCORED),
    "wildberries.ru": ("concat('https://www.wildberries.ru/catalog/', p_partkey)", f"""concat('{{"nmId":', p_partkey, ',"imt_name":"', p_brand, '","nmFeedbacks":', {N}, ',"nmReviewRating":', {SCORE}, ',"feedbacks":9999,"reviewRating":1}}')""", "CAST(p_partkey AS VARCHAR)", SCORED),
    "market.yandex.ru": ("concat('https://market.yandex.ru/product--x/', p_partkey)", f"concat({H1}, {LD})", "CAST(p_partkey AS VARCHAR)", SCORED),
    "megamarket.ru": ("concat('https://megamarket.ru/catalog/details/x-', p_partkey)", f"""concat('<div itemscope itemtype="https://schema.org/Product"><meta itemprop="sku" content="', p_partkey, '">', {H1}, '</div><script>window.__APP__={{"reviewInfo":{{"reviewsCount":', {N}, ',"rating":', {SCORE}, '}}}}</script>')""", "CAST(p_partkey AS VARCHAR)", SCORED),
}
REVIEW_SITES = {
    "irecommend.ru": ("concat('https://irecommend.ru/content/p-', p_partkey)", f"""concat({H1}, '<a href="/x?noderef=', p_partkey, '">+</a><div class="fivestar-summary"><p class="average-rating"><span>', {SCORE}, '</span></p></div><a class="read-all-reviews-link">Читать все отзывы <b class="counter">', {N}, '</b></a>')""", "CAST(p_partkey AS VARCHAR)", SCORED),
    "otzovik.com": ("concat('https://otzovik.com/reviews/p_', p_partkey, '/')", f"""concat({H1}, '<a data-pid="', p_partkey, '">x</a>', {MICRO})""", "CAST(p_partkey AS VARCHAR)", SCORED),
    "vseotzyvy.ru": ("concat('https://vseotzyvy.ru/item/', p_partkey, '/reviews-x/')", f"concat({H1}, {MICRO})", "CAST(p_partkey AS VARCHAR)", SCORED),
    "pravogolosa.net": ("concat('https://pravogolosa.net/otzyvcategory?page=show_category&catid=', p_partkey)", f"""concat('<h1 class="contentheading">', p_brand, '</h1><p>все отзывы ', {N}, '</p><i title="Рейтинг::Оценка объекта отзыва ', {SCORE}, ' из 5">x</i>')""", "CAST(p_partkey AS VARCHAR)", SCORED),
    "med-otzyv.ru": ("concat('https://med-otzyv.ru/lekarstva/', p_partkey, '-x')", f"concat('<title>', p_brand, ' — ', {N}, ' отзывов врачей</title>', {H1})", "CAST(p_partkey AS VARCHAR)", "NULL"),
}
PHARMACIES = {
    "okapteka.ru": ("concat('https://okapteka.ru/product/p', p_partkey)", f"""concat({H1}, {items('<div itemprop="review" data-id="', '"><meta itemprop="ratingValue" content="', '"></div>', '')}, '<div class="s-reviews-wrapper">', CASE WHEN {N} = 0 THEN '<h1>Отзывы</h1>' ELSE '' END, '</div>')""", "concat('p', p_partkey)", WHOLE),
    "rigla.ru": ("concat('https://www.rigla.ru/product/p', p_partkey)", f"""concat({H1}, '<script>window.__INITIAL_STATE__={{"product":{{"reviews":{{"items":[', {items('{"id":', ',"ratings":[{"value":', '}]}', ',')}, ']}}}}}};(function(){{}}())</script>')""", "concat('p', p_partkey)", WHOLE),
    "budzdorov.ru": ("concat('https://www.budzdorov.ru/product/p', p_partkey)", f"""concat({H1}, '<i allreviewsqty="', {N}, '"></i><script>window.__INITIAL_STATE__={{"productView":{{"reviews":[', {items('{"id":', ',"ratings":[{"attribute_code":"вкус","value":1},{"attribute_code":"Оценка","value":', '}]}', ',')}, ']}}}};</script>')""", "concat('p', p_partkey)", WHOLE),
    "zdravcity.ru": ("concat('https://www.zdravcity.ru/p_x', p_partkey, '.html')", f"concat({H1}, {LD})", "concat('x', p_partkey)", SCORED),
    "farmlend.ru": ("concat('https://farmlend.ru/product/', p_partkey)", f"""concat({H1}, CASE WHEN {N} = 0 THEN '<p>Пока еще никто не оставил отзыв</p>' ELSE concat('<p>Общий рейтинг ', replace({SCORE}, '.', ','), ' на основе ', {N}, ' отзывов покупателей</p>') END)""", "CAST(p_partkey AS VARCHAR)", SCORED),
    "asna.ru": ("concat('https://www.asna.ru/cards/x-', p_partkey)", f"""concat('<div class="productPage__content product__item" itemscope><meta itemprop="sku" content="', p_partkey, '">', {H1}, '<div itemprop="aggregateRating"><meta itemprop="reviewCount" content="', p_size, '"><meta itemprop="ratingValue" content="', {SCORE}, '"></div><i class="product__ratingText">(', p_size, ')</i><div id="feedbackListContainer" class="product__feedbackList">', CASE WHEN {N} = 0 THEN '<p class="product__feedbackEmpty">нет отзывов</p>' ELSE '<p class="product__feedbackItem" itemtype="https://schema.org/Review">x</p>' END, '</div></div>')""", "CAST(p_partkey AS VARCHAR)", SCORED),
    "apteka.ru": ("concat('https://apteka.ru/product/p', p_partkey, '/')", f"""concat({H1}, {LD}, '<div class="variantButton" aria-selected="false"><p class="ItemRating"><b class="caption3"><span>777</span></b></p></div><div class="variantButton" aria-selected="true"><p class="ItemRating"><b class="caption3"><span>', {N}, '</span></b></p></div>')""", "concat('p', p_partkey)", SCORED),
    "etabl.ru": ("concat('https://etabl.ru/product/x=', p_partkey, '/')", f"concat({H1}, {MICRO})", "concat('x=', p_partkey)", SCORED),
    "eapteka.ru": ("concat('https://www.eapteka.ru/goods/id', p_partkey, '/')", f"""concat({H1}, '<section class="sec-item__reviews" data-entity-reviews="', p_partkey, '"><p class="sec-item__reviews-header">', {N}, ' отзывов</p><i class="sec-item__rating-value">', {SCORE}, '</i><div class="reviews-application-container"></div></section>')""", "CAST(p_partkey AS VARCHAR)", SCORED),
}


def chosen(sites: dict, part: int) -> str:
    return "CASE p_partkey % {} {} END".format(len(sites), " ".join(f"WHEN {i} THEN {v if part < 0 else v[part]}" for i, v in enumerate([f"'{d}'" for d in sites] if part < 0 else list(sites.values()))))


def expected(sites: dict) -> str:
    return f"SELECT p_partkey AS page_id, {chosen(sites, -1)} AS domain, {chosen(sites, 2)} AS listing_id, {N} AS reviews, CAST(CASE WHEN {N} > 0 THEN {chosen(sites, 3)} END AS DOUBLE) AS rating, CASE WHEN {N} > 0 THEN 'ok' ELSE 'no_reviews' END AS status FROM part"


def observed(spark, d, sites: dict):
    rows = spread(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").select(F.col("p_partkey").alias("page_id"), F.expr(chosen(sites, 0)).alias("url"), F.col("p_brand").alias("brand"), F.expr(chosen(sites, 1)).alias("html"))
    known = [x for x in L.LAYOUTS if x.domain in sites]
    return L.observations(M.with_tree(rows), layouts=known).select("page_id", "domain", "listing_id", "reviews", "rating", "status")


@query("src10_market_pages", expected(MARKETS))
def src10(spark, d):
    """Pages of markets; counters of a whole group of listings are no listing's own."""
    return observed(spark, d, MARKETS)


@query("src17_review_sites", expected(REVIEW_SITES))
def src17(spark, d):
    return observed(spark, d, REVIEW_SITES)


@query("src19_pharmacy_pages", expected(PHARMACIES))
def src19(spark, d):
    """Pages of pharmacies: lists of reviews, states, texts, microdata; an empty list overrules a counter left over."""
    return observed(spark, d, PHARMACIES)


ODD = f"""CASE p_partkey % 6 WHEN 0 THEN '<title>Доступ ограничен</title>' WHEN 1 THEN concat({H1}, '<form class="x Captcha-form"></form>') WHEN 2 THEN concat('<script src="captcha.js"></script>', {H1}, {MICRO}) WHEN 3 THEN concat({H1}, '<p>отзывов пока нет</p>')
  WHEN 4 THEN concat('<title>', p_brand, ': инструкция по применению</title>', {H1}, {MICRO}) ELSE concat({H1}, '<p>Много отзывов</p>') END"""


@query("ex09_page_outcomes", f"SELECT p_partkey AS page_id, CASE p_partkey % 6 WHEN 0 THEN 'blocked' WHEN 1 THEN 'blocked' WHEN 2 THEN CASE WHEN {N} > 0 THEN 'ok' ELSE 'no_reviews' END WHEN 3 THEN 'no_reviews' WHEN 4 THEN 'not_product' ELSE 'parser_changed' END AS status FROM part")
def ex09_outcomes(spark, d):
    """Kept out, empty by its own words, editorial, or without proof of anything: none of these is zero unless it says so."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.expr("concat('https://otzyv.pro/category/a/', p_partkey, '-x.html')").alias("url"), F.col("p_brand").alias("brand"), F.expr(ODD).alias("html"))
    return L.observations(M.with_tree(rows), layouts=[x for x in L.LAYOUTS if x.domain == "otzyv.pro"]).select("page_id", "status")
