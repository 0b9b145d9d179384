"""Sites as layouts: where each one's pages keep title, identifier, counters and reviews, as data.

A layout is a few rules; every rule is an expression over a page's tree, and a page's site chooses its layout, so pages of
all sites are read in one pass and never meet. What the rules find is weighed the same way everywhere: counters of a page
that disagree are never published, an explicit empty list overrules a counter that was left over, a list of reviews counts
only if each has its own identifier and score, and a page without proof of anything is 'parser_changed', never zero.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import plain_number
from ..functions.urls import domain
from ..operators import identity as I
from . import markup as M

#: Words in the title of a page that keeps visitors out, and the elements that put them to a test.
BLOCKED_TITLE = r"(?iu)captcha|access denied|forbidden|temporarily unavailable|unusual traffic|enable javascript|доступ\s+(?:ограничен|запрещен)|проверка\s+браузера|не робот|слишком много запросов"
CHALLENGES = ", ".join(f"{tag}[{attribute}*='captcha' i]" for tag in ("iframe", "form", "input") for attribute in ("id", "class", "name", "src"))
CHALLENGE_TEXT = r"(?iu)подтвердите,?\s+что\s+вы\s+не\s+робот|verify\s+you\s+are\s+human"
#: Words of a page without reviews.
NO_REVIEWS = r"(?iu)отзывов\s+(?:пока\s+)?нет|нет\s+отзывов|(?<!\d)0\s+отзыв"
SCALE = 5.0


@dataclass(frozen=True)
class Rule:
    """One place of a value: an element's attribute or text by selector, the page's text by pattern, microdata, JSON-LD, the page's JSON, or the address."""

    kind: str
    where: str
    attribute: str | None = None
    pattern: str | None = None


def css(selector: str, attribute: str | None = None, pattern: str | None = None) -> Rule:
    return Rule("css", selector, attribute, pattern)


def text(pattern: str) -> Rule:
    return Rule("text", pattern)


def address(pattern: str) -> Rule:
    return Rule("address", pattern)


def micro(name: str, root: str = "") -> Rule:
    return Rule("micro", name, root)


def ld(path: str) -> Rule:
    return Rule("ld", path)


def json(path: str) -> Rule:
    return Rule("json", path)


@dataclass(frozen=True)
class Reviews:
    """A page's own list of reviews: elements (selector, id attribute, score selector) or an array in its state (path, with id and scores)."""

    items: str | None = None
    id_attribute: str = "data-id"
    score: str = "[itemprop='ratingValue']"
    state: str | None = None
    #: Which of a review's scores is the whole one, by its attribute code; None: the only one.
    code: str | None = None


@dataclass(frozen=True)
class Layout:
    domain: str
    listing: tuple[Rule, ...]
    title: str = "h1"
    count: tuple[Rule, ...] = ()
    rating: tuple[Rule, ...] = ()
    ratings: tuple[Rule, ...] = ()
    reviews: Reviews | None = None
    #: The counter that visitors see: it must be the one that the data states.
    visible: tuple[Rule, ...] = ()
    #: What shows the list of reviews, and what shows that it is empty.
    listed: str | None = None
    empty: str | None = None
    zero: str | None = None
    editorial: str | None = None
    #: Sites that show no rating with their counter.
    unrated: bool = False
    #: The id that the data states must be the listing's.
    bound: Rule | None = None
    scale: float = field(default=SCALE)


STATE = "window.__INITIAL_STATE__="
MICRODATA = {"count": (ld("reviewCount"), micro("reviewCount")), "rating": (ld("ratingValue"), micro("ratingValue")), "ratings": (ld("ratingCount"),), "zero": NO_REVIEWS}
#: Layouts of sites, as their pages are written.
LAYOUTS = [
    Layout("ozon.ru", (ld("sku"), address(r"/product/(?:[^/]*-)?(\d+)")), count=(ld("reviewCount"),), rating=(ld("ratingValue"),), ratings=(ld("ratingCount"),)),
    Layout("wildberries.ru", (json("nm_id"), json("nmId"), json("id")), title="", count=(json("nmFeedbacks"),), rating=(json("nmReviewRating"),)),
    Layout("market.yandex.ru", (address(r"/product--[^/]+/(\d+)"),), count=(ld("reviewCount"),), rating=(ld("ratingValue"),), ratings=(ld("ratingCount"),), zero=r"(?iu)(?:^|\s)0\s+(?:текстов\S*\s+)?отзыв|(?:^|\s)0\s+(?:written\s+)?review", bound=ld("sku")),
    Layout("megamarket.ru", (css("[itemtype$='/Product'] meta[itemprop='sku']", "content"),), title="[itemtype$='/Product'] h1", count=(css("script", M.SCRIPT, r'"reviewsCount"\s*:\s*(\d+)'),), rating=(css("script", M.SCRIPT, r'"reviewInfo"[\s\S]*"rating"\s*:\s*([0-5](?:\.\d+)?)\s*[,}]'),)),
    Layout("irecommend.ru", (css("a[href*='noderef=']", "href", r"noderef=(\d+)"), address(r"/content/([a-z0-9-]+)")), "[itemprop='itemReviewed'] [itemprop='name'], h1, .product-header", (css(".read-all-reviews-link .counter"), text(r"(?iu)Читать\s+все\s+отзывы\s*(\d[\d\s ]*)")), (css(".fivestar-summary .average-rating span, .average-rating span"), text(r"(?iu)Среднее\s*:\s*(\d+(?:[.,]\d+)?)")), (text(r"(?iu)\((\d[\d\s ]*)\s+голос"),), zero=NO_REVIEWS),
    Layout("otzyv.pro", (address(r"/(\d+)-[^/]+\.html"),), editorial=r"(?iu)отзывы?\s+(?:врач|невролог|пациент)|инструкци[ия]\s+по\s+применению|совет\S*\s+и\s+инструкц", **MICRODATA),
    Layout("vseotzyvy.ru", (address(r"/item/(\d+)/"),), **MICRODATA),
    Layout("otzyvru.com", (css("h1[data-id]", "data-id"), address(r"\.com/(?:amp/)?([a-z0-9-]+)/?$")), **MICRODATA),
    Layout("uteka.ru", (address(r"/([^/]+)/reviews/$"),), **MICRODATA),
    Layout("megapteka.ru", (address(r"-(\d+)/?$"),), **MICRODATA),
    Layout("otzovik.com", (css("[data-pid]", "data-pid", r"^(\d+)$"), address(r"/reviews/([a-z0-9_-]+)")), **MICRODATA),
    Layout("ru.otzyv.com", (address(r"\.com/([a-z0-9-]+)/?$"),), **MICRODATA),
    Layout("pravogolosa.net", (address(r"[?&]catid=(\d+)"),), "h1.contentheading, h1", (text(r"(?iu)все\s+отзывы\s+(\d[\d\s ]*)"),), (css("[title*='Рейтинг::Оценка объекта отзыва']", "title", r"(?iu)([\d.,]+)\s+из\s+5"),), (text(r"(?iu)все\s+отзывы\s+(\d[\d\s ]*)"),)),
    Layout("med-otzyv.ru", (address(r"/(\d+)-[^/]+"),), count=(css("title", None, r"(?iu)(\d[\d\s ]*)\s+отзыв(?:а|ов)?\s+(?:врачей|пациентов)"),), unrated=True),
    Layout("okapteka.ru", (address(r"/(?:product|pg)/([^/]+)"),), reviews=Reviews("[itemprop='review']"), listed=".s-reviews-wrapper", empty=".s-reviews-wrapper > h1"),
    Layout("rigla.ru", (address(r"/product/([^/?#]+)"),), reviews=Reviews(state="$.product.reviews.items")),
    Layout("budzdorov.ru", (address(r"/product/([^/?#]+)"),), reviews=Reviews(state="$.productView.reviews", code="оценка"), visible=(css("[allreviewsqty]", "allreviewsqty"),)),
    Layout("zdravcity.ru", (address(r"/p_([^/.]+)"),), count=(css("#__NEXT_DATA__", M.SCRIPT, r'"reviewsCount"\s*:\s*(\d+)'), ld("reviewCount")), rating=(ld("ratingValue"),), ratings=(ld("ratingCount"),)),
    Layout("farmlend.ru", (address(r"/product/(\d+)"),), count=(text(r"(?iu)(?:Общий рейтинг|Overall rating)\s*[0-5](?:[.,]\d+)?\s*(?:на основе|based on)\s*(\d[\d\s ]*)"),), rating=(text(r"(?iu)(?:Общий рейтинг|Overall rating)\s*([0-5](?:[.,]\d+)?)\s*(?:на основе|based on)"),), zero=r"(?iu)никто не оставил отзыв|No one has left a review yet"),
    Layout("asna.ru", (css(".productPage__content meta[itemprop='sku']", "content"),), count=(micro("reviewCount", ".productPage__content"),), rating=(micro("ratingValue", ".productPage__content"),), visible=(css(".product__ratingText", None, r"\((\d[\d\s ]*)\)"),), listed="#feedbackListContainer .product__feedbackItem", empty=".product__feedbackEmpty, .product__feedback-empty, #feedbackListContainer [data-empty-reviews]"),
    Layout("polza.ru", (css("meta[itemprop='sku']", "content"),), count=(micro("reviewCount"),), rating=(micro("ratingValue"),), visible=(css("#review_block .reviews__amount"),), listed="#review_block .review-item", empty="#review_block .reviews__empty, #review_block .reviews-empty, #review_block [data-empty-reviews]"),
    Layout("apteka.ru", (address(r"/product/([^/?#]+)"),), count=(ld("reviewCount"),), rating=(ld("ratingValue"),), ratings=(ld("ratingCount"),), visible=(css(".variantButton[aria-selected='true'] .ItemRating .caption3 span"),), zero=r"(?iu)Отзывы\s*0(?!\d)|нет отзывов"),
    Layout("nfapteka.ru", (css("input[name='productId']", "value"), css("[data-id]", "data-id")), count=(micro("reviewCount"),), rating=(micro("ratingValue"),), reviews=Reviews("#review .testimonial[itemscope]", "", "[itemprop='reviewRating'] [itemprop='ratingValue']"), listed="#review", empty="#review > h2 + a"),
    Layout("etabl.ru", (address(r"/product/([a-z0-9-]+=\d+)"),), count=(ld("reviewCount"), micro("reviewCount")), rating=(ld("ratingValue"), micro("ratingValue")), zero=NO_REVIEWS),
    Layout("eapteka.ru", (css("[data-entity-reviews]", "data-entity-reviews"), address(r"/goods/id(\d+)")), count=(css(".sec-item__reviews-header", None, r"(\d[\d\s ]*)"),), rating=(css(".sec-item__rating-value"),), listed=".sec-item__reviews .reviews-application-container", empty=".sec-item__reviews-empty, [data-empty-reviews]"),
]


def ld_product(tree: Column) -> Column:
    """The first product with a rating, or the first product, of a page's JSON-LD: a script's object, its list, or its graph."""
    scripts = F.transform(M.select(tree, "script[type='application/ld+json']"), lambda n: F.try_parse_json(n["attrs"][M.SCRIPT]))
    none = F.array().cast("array<variant>")
    listed = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array(v))
    nodes = F.flatten(F.transform(F.filter(scripts, lambda v: v.isNotNull()), lambda v: F.coalesce(listed(v), none)))
    kind = lambda v: F.concat_ws(" ", F.try_variant_get(v, "$['@type']", "array<string>"), F.try_variant_get(v, "$['@type']", "string"))
    products = F.filter(nodes, lambda v: kind(v).rlike(r"(^|[\s\"])Product($|[\s\"])"))
    rated = lambda p: F.filter(p, lambda v: F.try_variant_get(v, "$.aggregateRating", "variant").isNotNull())
    return M.let(products, lambda p: F.coalesce(F.get(rated(p), F.lit(0)), F.get(p, F.lit(0))))


def value_of(rule: Rule, tree: Column, url: Column, data: Column) -> Column:
    """A rule's value; `data` has what rules share: the product of the page's JSON-LD and the page as JSON."""
    if rule.kind == "address":
        return M.let(F.regexp_extract(url, "(?i)" + rule.where, 1), some)
    if rule.kind == "text":
        return M.let(F.regexp_extract(tree["text"], rule.where, 1), some)
    if rule.kind == "ld":
        place = f"$.{rule.where}" if rule.where in ("sku", "name") else f"$.aggregateRating.{rule.where}"
        return F.try_variant_get(data["ld"], place, "string")
    if rule.kind == "json":
        return F.try_variant_get(data["json"], f"$.{rule.where}", "string")
    if rule.kind == "micro":
        # Two elements with different values, or two sums of ratings, tell nothing.
        inside = f"{rule.attribute} " if rule.attribute else ""
        found = F.array_distinct(F.transform(M.select(tree, f"{inside}[itemprop='aggregateRating'] [itemprop='{rule.where}']"), lambda n: F.coalesce(M.tidy(n["attrs"]["content"]), M.text_of(tree, n))))
        return M.let(found, lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))
    values = F.transform(M.select(tree, rule.where), lambda n: M.tidy(n["attrs"][rule.attribute]) if rule.attribute else M.text_of(tree, n))
    if rule.pattern:
        values = F.transform(values, lambda v: M.let(F.regexp_extract(v, rule.pattern, 1), some))
    return F.get(F.array_compact(values), F.lit(0))


def some(text: Column) -> Column:
    return F.when(text != "", text)


def first_value(rules: tuple[Rule, ...], tree: Column, url: Column, data: Column) -> Column:
    return F.coalesce(*[value_of(r, tree, url, data) for r in rules]) if rules else F.lit(None).cast("string")


def whole(value: Column) -> Column:
    return M.let(plain_number(value), lambda number: F.when((number >= 0) & (number == F.floor(number)), number.cast("long")))


def listed_reviews(reviews: Reviews, tree: Column) -> Column:
    """(id, scores) of each review of the list; null if the page has no list."""
    if reviews.state:
        scripts = F.transform(M.select(tree, "script"), lambda n: n["attrs"][M.SCRIPT])
        state = F.get(F.filter(scripts, lambda s: F.contains(s, F.lit(STATE))), F.lit(0))
        body = F.regexp_replace(F.substring_index(F.substring_index(state, STATE, -1), ";(function", 1), r";\s*$", "")
        items = F.try_variant_get(F.try_parse_json(body), reviews.state, "array<variant>")
        scores = lambda v: F.coalesce(F.try_variant_get(v, "$.ratings", "array<variant>"), F.array().cast("array<variant>"))
        of_code = lambda s: F.lower(F.try_variant_get(s, "$.attribute_code", "string")) == reviews.code if reviews.code else F.lit(True)
        return F.transform(items, lambda v: F.struct(F.try_variant_get(v, "$.id", "string").alias("id"), F.transform(F.filter(scores(v), of_code), lambda s: F.try_variant_get(s, "$.value", "double")).alias("scores")))
    found = F.struct(M.select(tree, reviews.items).alias("items"), M.select(tree, f"{reviews.items} {reviews.score}").alias("scores"))
    identity = lambda n: M.tidy(n["attrs"][reviews.id_attribute]) if reviews.id_attribute else n["id"].cast("string")
    score = lambda n: plain_number(F.coalesce(M.tidy(n["attrs"]["content"]), M.text_of(tree, n)))
    return M.let(found, lambda s: F.transform(s["items"], lambda n: F.struct(identity(n).alias("id"), F.transform(F.filter(s["scores"], lambda v: M.contains(n, v)), score).alias("scores"))))


READ = "title string, listing_id string, count long, rating double, ratings long, visible long, listed boolean, empty boolean, zero boolean, editorial boolean, bound boolean, n_items int, sound boolean, mean double"


def read(layout: Layout, tree: Column, url: Column) -> Column:
    """What a layout's rules find on a page, as READ."""
    rules = [*layout.listing, *layout.count, *layout.rating, *layout.ratings, *layout.visible, *([layout.bound] if layout.bound else []), *([] if layout.title else [json("name")])]
    needs, none = {r.kind for r in rules}, F.lit(None).cast("variant")
    data = F.struct((ld_product(tree) if "ld" in needs else none).alias("ld"), (F.try_parse_json(tree["text"]) if "json" in needs else none).alias("json"))
    summary = M.let(listed_reviews(layout.reviews, tree), lambda items: summed(layout.reviews, items)) if layout.reviews else F.lit(None).cast("struct<n_items:int,sound:boolean,mean:double>")
    known = F.struct(data.alias("data"), summary.alias("items"))
    return M.let(known, lambda k: M.let(first_value(layout.listing, tree, url, k["data"]), lambda listing: read_with(layout, tree, url, k["data"], k["items"], listing)))


def summed(reviews: Reviews, items: Column) -> Column:
    """How many reviews a list has, whether each has an id and a score of its own, and the mean; all null without a list."""
    scores, ids = F.flatten(F.transform(items, lambda r: r["scores"])), F.transform(items, lambda r: r["id"])
    one_each = lambda values: F.forall(items, lambda r: (F.size(r["scores"]) == 1) if not reviews.code else F.size(r["scores"]) <= 1) & F.forall(values, lambda s: s.isNotNull() & s.between(0, 5))
    distinct = lambda values: F.forall(values, lambda i: i.isNotNull()) & (F.size(F.array_distinct(values)) == F.size(values))
    hundredths = lambda values: F.aggregate(values, F.lit(0).cast("decimal(20,4)"), lambda a, s: (a + s.cast("decimal(10,4)")).cast("decimal(20,4)"))
    mean = lambda values: F.when(F.size(values) > 0, F.round(hundredths(values) / F.size(values), 2).cast("double"))
    each = F.struct(scores.alias("scores"), ids.alias("ids"))
    return M.let(each, lambda e: F.struct(F.size(items).alias("n_items"), (one_each(e["scores"]) & distinct(e["ids"])).alias("sound"), mean(e["scores"]).alias("mean")))


def read_with(layout: Layout, tree: Column, url: Column, data: Column, items: Column, listing: Column) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    there = lambda selector: F.size(M.select(tree, selector)) > 0 if selector else none("boolean")
    of = lambda rule: value_of(rule, tree, url, data)
    first = lambda rules: first_value(rules, tree, url, data)
    title = F.coalesce(M.first_text(tree, layout.title), M.first_attribute(tree, "meta[property='og:title']", "content")) if layout.title else F.coalesce(of(json("imt_name")), of(json("name")))
    bound = F.coalesce(of(layout.bound) == listing, F.lit(False)) if layout.bound else F.lit(True)
    parts = {
        "title": title, "listing_id": listing, "count": whole(first(layout.count)), "rating": plain_number(first(layout.rating)), "ratings": whole(first(layout.ratings)),
        "visible": whole(first(layout.visible)), "listed": there(layout.listed), "empty": there(layout.empty), "zero": F.concat_ws(" ", M.first_text(tree, "title"), tree["text"]).rlike(layout.zero) if layout.zero else F.lit(False),
        "editorial": M.first_text(tree, "title").rlike(layout.editorial) if layout.editorial else F.lit(False), "bound": bound, "n_items": items["n_items"], "sound": items["sound"], "mean": items["mean"],
    }
    kinds = dict(p.split(" ") for p in READ.split(", "))
    return F.struct(*[v.cast(kinds[n]).alias(n) for n, v in parts.items()])


def is_blocked(tree: Column) -> Column:
    """Whether a page keeps visitors out: by its title, a test's element, or its words; scripts that lie dormant do not count."""
    return F.coalesce(M.first_text(tree, "title").rlike(BLOCKED_TITLE), F.lit(False)) | (F.size(M.select(tree, CHALLENGES)) > 0) | tree["text"].rlike(CHALLENGE_TEXT)


def observations(pages: DataFrame, key: str = "page_id", url: str = "url", brand: str = "brand", layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """A row for each page of a site with a layout: key, domain, listing_id, title, reviews, rating_count, rating, status, problem.

    ok and no_reviews carry metrics; blocked, not_product, needs_review (with the problem) and parser_changed never do.
    """
    tree, site = F.col("tree"), domain(F.col(url))
    rows = pages.select(key, site.alias("domain"), F.col(brand).alias("_brand"), F.col(url).alias("_url"), "tree").filter(F.col("domain").isin([x.domain for x in layouts]))
    found = None
    for x in layouts:
        one = read(x, tree, F.col("_url"))
        found = F.when(F.col("domain") == x.domain, one) if found is None else found.when(F.col("domain") == x.domain, one)
    has = lambda name: F.col("domain").isin([x.domain for x in layouts if getattr(x, name)] or [""])
    rows = rows.select(key, "domain", "_brand", found.alias("f"), is_blocked(tree).alias("_blocked"))
    # A list counts by itself; beside a counter it must agree with it.
    listed_only = has("reviews") & ~has("count")
    counted = F.when(listed_only, F.when(F.col("f.sound"), F.col("f.n_items").cast("long"))).otherwise(F.greatest("f.count", "f.ratings"))
    shown_empty = F.coalesce(F.col("f.empty"), F.lit(False)) & (F.coalesce(F.col("f.n_items"), F.lit(0)) == 0)
    reviews = F.when(shown_empty, F.lit(0).cast("long")).otherwise(F.coalesce(counted, F.when(F.col("f.zero"), F.lit(0).cast("long"))))
    rating = F.when(listed_only, F.col("f.mean")).otherwise(F.col("f.rating"))
    rows = rows.withColumns({"_reviews": reviews, "_rating": rating})
    wanted = F.col("_reviews") > 0
    named = F.regexp_like(F.coalesce(F.col("f.title"), F.lit("")), I.brand_pattern(F.col("_brand")))
    problem = (
        F.when(F.col("f.listing_id").isNull(), "no identifier").when(~F.col("f.bound"), "data of another product").when(~F.coalesce(named, F.lit(False)), "another product")
        .when(listed_only & ~F.coalesce(F.col("f.sound"), F.lit(True)), "reviews without their own id and score")
        .when(wanted & has("visible") & ~F.coalesce(F.col("f.visible") == F.col("_reviews"), F.lit(False)), "counters disagree")
        .when(wanted & has("listed") & ~F.coalesce(F.col("f.listed"), F.lit(False)), "a counter without reviews")
        .when(wanted & has("reviews") & has("count") & (F.col("f.n_items") == 0), "a counter without reviews")
        .when(wanted & ~has("unrated") & ~F.coalesce(F.col("_rating").between(0.01, SCALE), F.lit(False)), "no rating")
    )
    proven = F.col("_reviews").isNotNull()
    status = (
        F.when(F.col("f.editorial"), "not_product").when(F.col("_blocked") & F.col("f.count").isNull(), "blocked").when(~proven & F.col("f.n_items").isNull() & problem.isNull(), "parser_changed")
        .when(problem.isNotNull(), "needs_review").when(~proven, "parser_changed").when(wanted, "ok").otherwise("no_reviews")
    )
    good = status.isin("ok", "no_reviews")
    return rows.select(key, "domain", "f.listing_id", "f.title", F.when(good, F.col("_reviews")).alias("reviews"), F.when(good, F.col("f.ratings")).alias("rating_count"), F.when(good & wanted & ~has("unrated"), F.col("_rating")).alias("rating"), status.alias("status"), F.when(status == "needs_review", problem).alias("problem"))
