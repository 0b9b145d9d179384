"""Pages in the layouts of sites, each with what must and must not be published of it."""

import pytest

from ratingloom.sources import layouts as L
from ratingloom.sources import markup as M

LD = '<script type="application/ld+json">{"@graph":[{"@type":"Organization"},{"@type":["Product"],"sku":"%s","name":"Зорлан","aggregateRating":{"reviewCount":"%s","ratingValue":"%s"}}]}</script>'
MICRO = '<div itemprop="aggregateRating"><meta itemprop="reviewCount" content="%s"><meta itemprop="ratingValue" content="%s"></div>'
STATE = '<script>window.__INITIAL_STATE__={"product":{"reviews":{"items":[%s]}},"productView":{"reviews":[%s]}};(function(){var s;}());</script>'
H1 = "<h1>Зорлан гель</h1>"
#: address, page, and (listing, reviews, rating, status, problem).
CASES = [
    ("https://www.ozon.ru/product/zorlan-77/", H1 + LD % ("77", 12, 4.5), ("77", 12, 4.5, "ok", None)),
    ("https://www.wildberries.ru/x", '{"nmId": 5, "imt_name": "Зорлан", "nmFeedbacks": 3, "nmReviewRating": 4.7, "feedbacks": 900}', ("5", 3, 4.7, "ok", None)),
    ("https://www.wildberries.ru/y", '{"nmId": 6, "imt_name": "Зорлан", "feedbacks": 900, "reviewRating": 4.7}', ("6", None, None, "parser_changed", None)),
    ("https://market.yandex.ru/product--zorlan/31", H1 + LD % ("31", 8, "4,1"), ("31", 8, 4.1, "ok", None)),
    ("https://market.yandex.ru/product--zorlan/32", H1 + LD % ("31", 8, "4,1"), ("32", None, None, "needs_review", "data of another product")),
    ("https://megamarket.ru/x", '<div itemscope itemtype="https://schema.org/Product"><meta itemprop="sku" content="9"><h1 itemprop="name">Зорлан</h1></div><script>window.__APP__={"reviewInfo":{"reviewsCount":4,"rating":4.25}}</script>', ("9", 4, 4.25, "ok", None)),
    ("https://irecommend.ru/content/zorlan", H1 + '<a href="/node?noderef=55">+</a><p>Среднее: 4,4 (1 200 голосов)</p><p>Читать все отзывы 340</p>', ("55", 1200, 4.4, "ok", None)),
    ("https://irecommend.ru/content/zorlan", H1 + "<p>отзывов пока нет</p><script src='captcha-checker.js'></script>", ("zorlan", 0, None, "no_reviews", None)),
    ("https://otzyv.pro/category/x/12-zorlan.html", "<title>Зорлан отзывы</title>" + H1 + MICRO % (7, 3.5), ("12", 7, 3.5, "ok", None)),
    ("https://otzyv.pro/category/x/13-zorlan.html", "<title>Зорлан: отзывы врачей</title>" + H1 + MICRO % (1, 5), ("13", None, None, "not_product", None)),
    ("https://vseotzyvy.ru/item/3/reviews-zorlan", H1 + MICRO % (7, 3) + MICRO % (8, 3), ("3", None, None, "parser_changed", None)),
    ("https://www.otzyvru.com/zorlan", '<h1 data-id="21">Зорлан</h1>' + MICRO % (2, 5), ("21", 2, 5.0, "ok", None)),
    ("https://otzovik.com/reviews/zorlan_gel/", H1 + '<a data-pid="123"></a>' + MICRO % (0, 0), ("123", 0, None, "no_reviews", None)),
    ("https://otzovik.com/reviews/other/", "<h1>Иное</h1>" + MICRO % (4, 4), ("other", None, None, "needs_review", "another product")),
    ("https://pravogolosa.net/otzyvcategory?page=show_category&catid=8", '<h1 class="contentheading">Зорлан</h1><p>все отзывы 14</p><i title="Рейтинг::Оценка объекта отзыва 3,5 из 5">x</i>', ("8", 14, 3.5, "ok", None)),
    ("https://med-otzyv.ru/lekarstva/7-zorlan", "<title>Зорлан — 1 012 отзывов врачей</title>" + H1, ("7", 1012, None, "ok", None)),
    ("https://okapteka.ru/product/zorlan", H1 + "".join(f'<div itemprop="review" data-id="{i}"><meta itemprop="ratingValue" content="{s}"></div>' for i, s in ((1, 5), (2, 4), (3, 4))) + '<div class="s-reviews-wrapper"></div>', ("zorlan", 3, 4.33, "ok", None)),
    ("https://okapteka.ru/product/zorlan", H1 + "".join(f'<div itemprop="review" data-id="1"><meta itemprop="ratingValue" content="{s}"></div>' for s in (5, 4)), ("zorlan", None, None, "needs_review", "reviews without their own id and score")),
    ("https://okapteka.ru/product/zorlan", H1 + '<div class="s-reviews-wrapper"><h1>Отзывы на Зорлан</h1></div>', ("zorlan", 0, None, "no_reviews", None)),
    ("https://www.rigla.ru/product/zorlan-1", H1 + STATE % ('{"id":1,"ratings":[{"value":5}]},{"id":2,"ratings":[{"value":4}]}', ""), ("zorlan-1", 2, 4.5, "ok", None)),
    ("https://www.rigla.ru/product/zorlan-1", H1 + STATE % ('{"id":1,"ratings":[{"value":5},{"value":1}]}', ""), ("zorlan-1", None, None, "needs_review", "reviews without their own id and score")),
    ("https://www.rigla.ru/product/zorlan-1", H1 + STATE % ("", ""), ("zorlan-1", 0, None, "no_reviews", None)),
    ("https://www.budzdorov.ru/product/zorlan", H1 + '<a allreviewsqty="2"></a>' + STATE % ("", '{"id":1,"ratings":[{"attribute_code":"Оценка","value":3}]},{"id":2,"ratings":[{"attribute_code":"x","value":1}]}'), ("zorlan", 2, 3.0, "ok", None)),
    ("https://www.budzdorov.ru/product/zorlan", H1 + '<a allreviewsqty="3"></a>' + STATE % ("", '{"id":1,"ratings":[{"attribute_code":"оценка","value":3}]}'), ("zorlan", None, None, "needs_review", "counters disagree")),
    ("https://farmlend.ru/product/5", H1 + "<p>Общий рейтинг 4,9 на основе 1 024 отзывов покупателей</p>", ("5", 1024, 4.9, "ok", None)),
    ("https://farmlend.ru/product/5", H1 + "<p>Пока еще никто не оставил отзыв</p>", ("5", 0, None, "no_reviews", None)),
    ("https://farmlend.ru/product/5", H1, ("5", None, None, "parser_changed", None)),
    ("https://www.asna.ru/cards/x", '<div class="productPage__content product__item" itemscope><meta itemprop="sku" content="4">' + H1 + MICRO % (2, 5) + '<i class="product__ratingText">5 (2)</i><div id="feedbackListContainer" class="product__feedbackList"><p class="product__feedbackItem" itemtype="x/Review"></p></div></div>', ("4", 2, 5.0, "ok", None)),
    ("https://www.asna.ru/cards/x", '<div class="productPage__content product__item" itemscope><meta itemprop="sku" content="4">' + H1 + MICRO % (2, 5) + '<div id="feedbackListContainer"><p class="product__feedbackEmpty">нет отзывов</p></div></div>', ("4", 0, None, "no_reviews", None)),
    ("https://www.asna.ru/cards/x", '<div class="productPage__content product__item" itemscope><meta itemprop="sku" content="4">' + H1 + MICRO % (2, 5) + '<i class="product__ratingText">5 (2)</i></div>', ("4", None, None, "needs_review", "a counter without reviews")),
    ("https://apteka.ru/product/zorlan-1/", H1 + LD % ("1", 6, 4.8) + '<div class="variantButton" aria-selected="true"><div class="ItemRating"><b class="caption3"><span>6</span></b></div></div>', ("zorlan-1", 6, 4.8, "ok", None)),
    ("https://apteka.ru/product/zorlan-1/", H1 + LD % ("1", 6, 4.8), ("zorlan-1", None, None, "needs_review", "counters disagree")),
    ("https://uteka.ru/a/zorlan/reviews/", "<title>Доступ ограничен</title>", ("zorlan", None, None, "blocked", None)),
    ("https://uteka.ru/a/zorlan/reviews/", H1 + '<form id="captcha-form"></form>', ("zorlan", None, None, "blocked", None)),
    ("https://uteka.ru/a/zorlan/reviews/", H1 + LD % ("1", 3, 9), ("zorlan", None, None, "needs_review", "no rating")),
    ("https://www.zdravcity.ru/p_zorlan.html", H1 + LD % ("1", 3, 4), ("zorlan", 3, 4.0, "ok", None)),
    ("https://nfapteka.ru/zorlan.html", H1 + '<input name="productId" value="88">' + MICRO % (1, 4) + '<div id="review"><div class="testimonial" itemscope itemtype="x/Review"><p itemprop="reviewRating"><meta itemprop="ratingValue" content="4"></p></div></div>', ("88", 1, 4.0, "ok", None)),
    ("https://www.eapteka.ru/goods/id9/", H1 + '<section class="sec-item__reviews" data-entity-reviews="9"><p class="sec-item__reviews-header">17 отзывов</p><i class="sec-item__rating-value">4.2</i><div class="reviews-application-container"></div></section>', ("9", 17, 4.2, "ok", None)),
    ("https://etabl.ru/product/zorlan=4/", H1 + MICRO % (3, 4), ("zorlan=4", 3, 4.0, "ok", None)),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, url, "Зорлан", html) for i, (url, html, _) in enumerate(CASES)] + [(900, "https://nobody.example/", "Зорлан", H1), (901, "https://uteka.ru/a/zorlan/reviews/", "Зорлан", None)]
    return {r.page_id: r for r in L.observations(M.with_tree(spark.createDataFrame(rows, "page_id long, url string, brand string, html string"))).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_layout(found, i):
    r = found[i]
    assert (r.listing_id, r.reviews, r.rating, r.status, r.problem) == CASES[i][2]


def test_other_sites_and_empty_pages(found):
    assert 900 not in found and found[901].status in ("parser_changed", "needs_review") and found[901].reviews is None
    assert len(found) == len(CASES) + 1
