"""How a site is read, inferred from its pages: search addresses, links of products, next pages, what its counters count.

Every page proposes; proposals are counted by site before they are compared, and the best supported one wins, ties going
to the earlier one of the lists. A site's profile is one row, however many pages it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import domain
from ..operators import identity as I
from . import markup as M
from .payloads import absolute

#: Parameters and fields of searches, and selectors of product links and next pages, the surest first.
QUERY_NAMES = ("q", "query", "search", "keyword", "s")
SEARCH_INPUT = ", ".join(["input[type='search'][name]", *[f"input[name='{n}']" for n in QUERY_NAMES]])
PRODUCT_LINKS = ("[itemtype*='Product'] a[href]", "[data-product-id] a[href]", ".product-card a[href]", ".product-item a[href]", ".catalog-item a[href]")
NEXT_PAGES = ("a[rel='next']", ".pagination a.next", ".pagination__next", "a.next", "[data-next-page]")
ENDLESS = r"(?i)IntersectionObserver|infinite[-_ ]?scroll|load[-_ ]?more"
MEANINGS = ("reviews", "ratings", "feedback")
#: Example pages that are kept of a site.
EXAMPLES = 12
TEMPLATE = "{query}"


def search_templates(tree: Column, url: Column) -> Column:
    """Addresses of searches that a page's forms and links show, with the place of the words."""
    inputs = M.select(tree, SEARCH_INPUT)
    forms = F.filter(M.select(tree, "form"), lambda f: F.coalesce(F.lower(f["attrs"]["method"]), F.lit("get")) == "get")

    def of_form(s: Column, form: Column) -> Column:
        name = F.get(F.filter(s["inputs"], lambda i: M.contains(form, i)), F.lit(0))["attrs"]["name"]
        action = F.coalesce(absolute(F.nullif(form["attrs"]["action"], F.lit("")), url), F.regexp_extract(url, r"^(https?://[^/?#]+)", 1))
        return F.when(name.isNotNull(), F.concat(action, F.when(F.contains(action, F.lit("?")), "&").otherwise("?"), name, F.lit(f"={TEMPLATE}")))

    asked = r"([?&](?:" + "|".join(QUERY_NAMES) + r"))=[^&#]*"
    leads = lambda a: a["attrs"]["href"].rlike(asked) & F.concat_ws(" ", a["attrs"]["href"], M.text_of(tree, a)).rlike("(?i)search|find|query|catalog|поиск|каталог")
    of_links = F.transform(F.filter(M.select(tree, "a[href]"), leads), lambda a: F.regexp_replace(absolute(a["attrs"]["href"], url), asked, f"$1={TEMPLATE}".replace("{", "\\{").replace("}", "\\}")))
    both = M.let(F.struct(forms.alias("forms"), inputs.alias("inputs")), lambda s: F.transform(s["forms"], lambda f: of_form(s, f)))
    return F.array_distinct(F.array_compact(F.concat(both, of_links)))


def link_shape(url: Column) -> Column:
    """The path of an address with its numbers as {n} and its words of letters and numbers as {s}: what addresses of one kind share."""
    path = F.regexp_replace(F.regexp_replace(url, r"^https?://[^/?#]+", ""), r"[?#].*$", "")
    parts = F.transform(F.split(path, "/"), lambda p: F.when(p.rlike(r"^\d+$"), "{n}").when(p.rlike(r"\d") | p.rlike("-"), "{s}").otherwise(p))
    return F.array_join(parts, "/")


def named_links(tree: Column, url: Column, brand: Column) -> Column:
    """Links of a page, on its own site, whose text or address names the brand."""
    links = F.transform(M.select(tree, "a[href]"), lambda a: F.struct(absolute(a["attrs"]["href"], url).alias("url"), M.text_of(tree, a).alias("title")))
    return F.filter(links, lambda a: a["url"].isNotNull() & F.regexp_like(F.concat_ws(" ", a["title"], F.regexp_replace(a["url"], r"[-_+/]", " ")), I.brand_pattern(brand)))


def counter_meaning(tree: Column) -> Column:
    """What a page counts: by its data first, then by its words."""
    scripts = F.array_join(F.transform(M.select(tree, "script"), lambda n: n["attrs"][M.SCRIPT]), " ")
    data = F.when(F.contains(scripts, F.lit('"reviewCount"')), "reviews").when(F.contains(scripts, F.lit('"ratingCount"')), "ratings")
    text = tree["text"]
    return F.coalesce(data, F.when(text.rlike(r"(?iu)(?<!\p{L})(отзыв|reviews?(?!\p{L}))"), "reviews").when(text.rlike(r"(?iu)(?<!\p{L})(оцен(ок|ки)|ratings?(?!\p{L}))"), "ratings").when(text.rlike(r"(?i)\bfeedback\b"), "feedback"))


def best(proposals: DataFrame, name: str) -> DataFrame:
    """domain and the best supported proposal: rows are domain, value, place (in the list of proposals; less is surer)."""
    counted = proposals.groupBy("domain", "value").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    return counted.groupBy("domain").agg(F.max_by("value", F.struct("n", -F.col("place"), "value")).alias(name), F.max("n").alias(f"{name}_support"))


def profile_sites(pages: DataFrame, brand: str = "brand", url: str = "url") -> DataFrame:
    """One row for each site of pages with `tree`: search_template, product_links, next_page, endless, link_shape, meaning, each with its support, n_pages and examples.

    Meanings are voted on by pages that name the brand, link shapes by links that do.
    """
    tree, address = F.col("tree"), F.col(url)
    signs = lambda selectors: F.array_compact(F.transform(F.array(*[F.struct(F.lit(i).alias("place"), F.when(F.size(M.select(tree, s)) > 0, s).alias("value")) for i, s in enumerate(selectors)]), lambda s: F.when(s["value"].isNotNull(), s)))
    named = F.regexp_like(F.concat_ws(" ", M.first_text(tree, "h1"), M.first_text(tree, "title")), I.brand_pattern(F.col(brand)))
    read = pages.select(
        domain(address).alias("domain"), search_templates(tree, address).alias("templates"), signs(PRODUCT_LINKS).alias("products"), signs(NEXT_PAGES).alias("nexts"),
        F.exists(F.transform(M.select(tree, "script"), lambda n: n["attrs"][M.SCRIPT]), lambda s: s.rlike(ENDLESS)).alias("endless"),
        named_links(tree, address, F.col(brand)).alias("links"), F.when(F.coalesce(named, F.lit(False)), counter_meaning(tree)).alias("meaning"),
    )
    first = lambda column: read.select("domain", F.get(column, F.lit(0)).alias("v")).filter("v is not null").select("domain", "v.value", "v.place")
    templates = read.select("domain", F.posexplode("templates").alias("place", "value")).select("domain", "value", "place")
    shapes = read.select("domain", F.explode("links").alias("l")).select("domain", link_shape(F.col("l.url")).alias("value"), F.lit(0).alias("place"))
    order = F.array_position(F.array(*map(F.lit, MEANINGS)), F.col("meaning")).cast("int")
    meanings = read.filter("meaning is not null").select("domain", F.col("meaning").alias("value"), order.alias("place"))
    # The first examples by address, without holding all of a site's: distinct ones are ranked by one aggregate of small arrays.
    links = read.select("domain", F.explode("links").alias("l")).select("domain", "l.url", F.coalesce("l.title", F.lit("")).alias("title")).groupBy("domain", "url").agg(F.max("title").alias("title"))
    salted = links.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(32)))
    few = lambda rows, *keys: rows.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("url", "title"))), 1, EXAMPLES).alias("e"))
    examples = few(few(salted, "domain", "salt").select("domain", F.inline("e")), "domain").select("domain", F.col("e").alias("examples"))
    sites = read.groupBy("domain").agg(F.count("*").alias("n_pages"), F.max("endless").alias("endless"))
    for table in (best(templates, "search_template"), best(first("products"), "product_links"), best(first("nexts"), "next_page"), best(shapes, "link_shape"), best(meanings, "meaning"), examples):
        sites = sites.join(table, "domain", "left")
    return sites.withColumns({"endless": F.col("endless") & F.col("next_page").isNull(), "meaning": F.coalesce("meaning", F.lit("unknown"))})


def candidate_templates(domains: DataFrame) -> DataFrame:
    """Search addresses to try where a site's pages show none."""
    tries = F.array(*[F.concat(F.lit("https://"), F.col("domain"), F.lit(t)) for t in ("/?s={query}", "/search?q={query}", "/search/?q={query}", "/catalogsearch/result/?q={query}")])
    return domains.select("domain", F.posexplode(tries).alias("place", "template"))
