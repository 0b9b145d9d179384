"""What a product page proves of its product: typed texts of the page, for identity to decide on.

One row of a page becomes a few rows of candidate texts, by selectors over its tree; what lies in a review is no
evidence of the product. A text counts if the identity engine finds a form, a pack or a strength in it. JSON-LD is walked
level by level in the JVM. The rows of a page meet again once, by its key; they are a few dozen at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_walk import levels
from ..functions.text import let
from ..operators import identity as I
from . import markup as M
from .payloads import IDLE, TELLING, absolute
from .sinks import written_once

#: Where pages keep what visitors write.
REVIEWS = ", ".join(
    ["[itemprop='review']", "[itemprop='reviewBody']", "[itemtype*='schema.org/Review']", "[itemtype*='/Review']", "[data-review-id]", "[data-reviewid]", "article[class*='review']", "li[class*='review']"]
    + [f"[class*='{word}']" for word in ("review-item", "review_item", "review-card", "comment-item", "comment_item")]
)
#: Where pages keep the variants on offer, and the description of the product.
OPTIONS = [f"[{data}*='product-variant']{role}" for data in ("data-testid", "data-test") for role in ("[role='option']", " [role='option']")]
OPTIONS += [f"[class*='{word}'] {option}" for word in ("product-variant", "product__variant") for option in ("option", "[role='option']")]
OPTIONS += ["[data-test='release-form-badge']", "select[aria-label*='вариант' i] option", "select[aria-label*='упаков' i] option", "select[name*='variant' i] option", "select[name*='product' i] option"]
DESCRIPTIONS = ["[itemprop='description']"] + [f"[{attribute}*='{word}']" for attribute, word in (("data-testid", "product-description"), ("data-test", "product-description"), ("id", "product-description"), ("class", "product-description"), ("class", "product__description"))]
#: Words of links that lead to instructions.
INSTRUCTIONS = r"(?iu)инструк|состав|форм[аы][-_\s]+выпуск|instruction|composition|dosage-form"
#: Fields of a JSON-LD product that tell it apart, and what each is called.
FIELDS = {"name": "Название", "model": "Модель", "dosageForm": "Лекарственная форма", "strength": "Дозировка", "packageSize": "Количество в упаковке", "size": "Размер/фасовка", "weight": "Масса"}
IDENTIFIERS = {"sku": "sku", "productID": "product_id", "mpn": "product_id", "gtin": "gtin", "gtin8": "gtin", "gtin12": "gtin", "gtin13": "gtin", "gtin14": "gtin"}
#: Levels of a JSON-LD script that are read.
LEVELS = 12
NODES = "array<struct<path:string,v:variant,in_variant:boolean,inherited:boolean,members:map<string,variant>,items:array<variant>,named:boolean,product:boolean>>"


def tells(text: Column) -> Column:
    """Whether a text has a form, a pack or a strength."""
    return I.has_form(text) | I.has_measure(text)


def row(source: str, block: Column, text: Column, label: Column | None = None, area: Column | None = None) -> Column:
    return F.struct(F.lit(source).alias("source"), block.cast("int").alias("block"), (F.lit(None).cast("string") if label is None else label).alias("label"), text.alias("text"), (F.lit(False) if area is None else area).alias("area"))


def pairs(tree: Column, reviews: Column) -> Column:
    """Name and value of each row of a table and of each term of a list, by table and list."""
    tables = M.outside(M.select(tree, "table"), reviews)
    cells = M.select(tree, "tr > th, tr > td")

    def of_row(s: Column, tr: Column) -> Column:
        mine = F.filter(s["cells"], lambda c: c["parent"] == tr["id"])
        block = F.array_max(F.transform(F.filter(s["tables"], lambda t: M.contains(t, tr)), lambda t: t["id"]))
        rest = F.array_join(F.transform(F.slice(mine, 2, 1000), lambda c: M.text_of(tree, c)), " ")
        return F.when((F.size(mine) > 1) & block.isNotNull(), row("attribute", block, rest, M.text_of(tree, F.get(mine, F.lit(0)))))

    of_tables = M.let(F.struct(tables.alias("tables"), cells.alias("cells"), M.select(tree, "tr").alias("rows")), lambda s: F.array_compact(F.transform(s["rows"], lambda tr: of_row(s, tr))))
    terms = M.outside(M.select(tree, "dl > dt"), reviews)
    values = M.select(tree, "dt + dd")
    value = lambda s, t: F.get(F.filter(s["values"], lambda d: d["id"] == t["last"] + 1), F.lit(0))
    of_lists = M.let(F.struct(terms.alias("terms"), values.alias("values")), lambda s: F.transform(s["terms"], lambda t: row("attribute", t["parent"], M.text_of(tree, value(s, t)), M.text_of(tree, t))))
    return F.concat(of_tables, of_lists)


def page_texts(tree: Column) -> Column:
    """All candidate texts of a page."""
    return M.let(M.select(tree, REVIEWS), lambda reviews: texts_outside(tree, reviews))


def texts_outside(tree: Column, reviews: Column) -> Column:
    found = lambda selector: M.outside(M.select(tree, selector), reviews)
    attribute = lambda n, *names: F.coalesce(*[M.tidy(n["attrs"][a]) for a in names])
    shown = lambda n, *names: F.coalesce(attribute(n, *names), M.text_of(tree, n))
    title = F.coalesce(M.first_text(tree, "h1"), M.first_attribute(tree, "meta[property='og:title']", "content"), M.first_text(tree, "title"))
    about = F.coalesce(M.first_attribute(tree, "meta[name='description']", "content"), M.first_attribute(tree, "meta[property='og:description']", "content"))
    areas = M.select(tree, "[itemtype*='Product'], [data-product-id], [data-testid*='product-card'], [data-test*='product-card'], figure")
    images = F.struct(areas.alias("areas"), found("img[alt], img[title], img[aria-label], figure figcaption").alias("images"))
    headings = M.let(found("h2, h3, h4, summary, [role='tab']"), lambda hs: F.transform(hs, lambda h: row("instruction", h["id"], M.let(M.next_of(tree, h), lambda n: M.text_of(tree, n)), M.text_of(tree, h))))
    links = F.filter(found("a[href]"), lambda a: F.concat_ws(" ", a["attrs"]["href"], M.text_of(tree, a)).rlike(INSTRUCTIONS))
    return F.concat(
        F.array(row("title", F.lit(0), title), row("meta", F.lit(0), about)),
        pairs(tree, reviews),
        F.transform(found(", ".join(OPTIONS)), lambda n: row("variant", n["id"], shown(n, "content", "aria-label", "title"))),
        F.transform(found(", ".join(DESCRIPTIONS)), lambda n: row("description", n["id"], shown(n, "content"))),
        headings,
        F.transform(links, lambda a: row("link", a["id"], M.text_of(tree, a))),
        F.transform(M.select(tree, "meta[property='og:image:alt'], meta[name='twitter:image:alt']"), lambda n: row("image", n["id"], attribute(n, "content"), area=F.lit(True))),
        M.let(images, lambda s: F.transform(s["images"], lambda n: row("image", n["id"], shown(n, "alt", "title", "aria-label"), area=F.exists(s["areas"], lambda a: M.contains(a, n))))),
    )


def telling_texts(pages: DataFrame, key: str, brand: str) -> DataFrame:
    """key, source, block and text of what counts; attributes of one table or list are one text."""
    rows = pages.select(key, brand, F.posexplode(page_texts(F.col("tree"))).alias("place", "t")).select(key, brand, "place", "t.*").filter("text is not null")
    text, named = F.col("text"), F.regexp_like(F.col("text"), I.brand_pattern(F.col(brand)))
    label_tells = F.col("label").rlike(TELLING) & ~F.col("label").rlike(IDLE)
    counts = (
        F.when(F.col("source").isin("title", "meta"), True)
        .when(F.col("source") == "attribute", label_tells & tells(F.concat_ws(": ", "label", "text")))
        .when(F.col("source") == "instruction", label_tells & tells(text))
        .when(F.col("source").isin("variant", "link"), tells(text))
        .when(F.col("source") == "image", tells(text) & ((F.col("area") & I.has_form(text)) | named))
        .when(F.col("source") == "description", I.has_form(text) & (I.has_measure(text) | named))
    )
    said = F.concat_ws(": ", F.when(F.col("source").isin("attribute", "instruction"), F.col("label")), "text")
    rows = rows.filter(counts).select(key, F.when(F.col("source") == "link", "instruction").otherwise(F.col("source")).alias("source"), "block", "place", said.alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), "; ")
    return rows.groupBy(key, "source", "block").agg(F.min("place").alias("place"), joined.alias("text"))


# JSON-LD


def of_variant(v: Column, path: str) -> Column:
    """The plain text at a path; what is an object gives its name or value."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{path}{inner}", "string") for inner in (".name", ".value", "")])


def ld_nodes(pages: DataFrame, key: str, brand: str) -> DataFrame:
    """Products and variants of the brand in a page's JSON-LD: key, path, in_variant and the node.

    A node counts if it is a product, or stands under hasVariant, and names the brand; what stands under hasVariant of a
    node that names the brand need not name it again. A script's levels stay in its row, so only what counts is a row.
    """
    texts = F.transform(M.select(F.col("tree"), "script[type='application/ld+json']"), lambda n: F.regexp_replace(F.trim(n["attrs"][M.SCRIPT]), r"^(?:<!--|<!\[CDATA\[)|(?:-->|\]\]>)$", ""))
    scripts = pages.select(F.col(key).alias("_key"), I.brand_pattern(F.col(brand)).alias("_brand"), F.posexplode(texts).alias("nth", "text"))
    scripts = scripts.select("_key", "_brand", F.concat(F.lit("$"), "nth").alias("path"), F.try_parse_json("text").alias("v")).filter("v is not null")

    def node(path: Column, v: Column, in_variant: Column, inherited: Column) -> Column:
        members, items = F.try_variant_get(v, "$", "map<string,variant>"), F.try_variant_get(v, "$", "array<variant>")
        said = F.concat_ws("\n", *[of_variant(v, field) for field in ("name", "brand", "manufacturer")])
        kinds = F.lower(F.concat_ws(" ", F.try_variant_get(v, "$['@type']", "array<string>"), F.try_variant_get(v, "$['@type']", "string")))
        named = members.isNotNull() & F.coalesce(F.regexp_like(said, F.col("_brand")), F.lit(False))
        product = members.isNotNull() & kinds.rlike(r"(^|[\s\"/\[,])product($|[\s\",\]])")
        parts = {"path": path, "v": v, "in_variant": in_variant, "inherited": inherited, "members": members, "items": items, "named": named, "product": product}
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    def below(n: Column) -> Column:
        of_members = F.transform(F.map_entries(n["members"]), lambda e: let(e["key"] == "hasVariant", lambda here: node(F.concat(n["path"], F.lit("."), e["key"]), e["value"], here, here & (n["named"] | n["inherited"]))))
        of_items = F.transform(n["items"], lambda v, i: node(F.concat(n["path"], F.format_string("[%06d]", i)), v, n["in_variant"], n["inherited"]))
        return F.filter(F.coalesce(of_members, of_items, F.array().cast(NODES)), lambda c: c["members"].isNotNull() | c["items"].isNotNull())

    counts = lambda n: n["members"].isNotNull() & (n["product"] | n["in_variant"]) & (n["named"] | (n["in_variant"] & n["inherited"]))
    kept = lambda nodes: F.transform(F.filter(nodes, counts), lambda n: F.struct(n["path"].alias("path"), n["in_variant"].alias("in_variant"), n["v"].alias("v")))
    top = F.array(node(F.col("path"), F.col("v"), F.lit(False), F.lit(False)))
    return scripts.select(F.col("_key").alias(key), F.explode(levels(top, below, LEVELS, kept)).alias("n")).select(key, "n.*")


def ld_texts(nodes: DataFrame, key: str) -> DataFrame:
    """key, path, in_variant, and each node's telling fields and properties as one text, its identifiers and its pictures."""
    labelled = [F.when(of_variant(F.col("v"), field).isNotNull(), F.concat(F.lit(f"{label}: "), M.tidy(of_variant(F.col("v"), field)))) for field, label in FIELDS.items()]
    more = F.coalesce(F.try_variant_get("v", "$.additionalProperty", "array<variant>"), F.array(F.try_variant_get("v", "$.additionalProperty", "variant")))
    name = lambda p: F.coalesce(F.try_variant_get(p, "$.name", "string"), F.try_variant_get(p, "$.propertyID", "string"))
    value = lambda p: F.coalesce(F.try_variant_get(p, "$.value", "string"), F.try_variant_get(p, "$.valueReference", "string"))
    properties = F.transform(F.filter(more, lambda p: name(p).rlike(TELLING) & ~name(p).rlike(IDLE) & value(p).isNotNull()), lambda p: F.concat(M.tidy(name(p)), F.lit(": "), M.tidy(value(p))))
    text = F.array_join(F.concat(F.array_compact(F.array(*labelled)), F.coalesce(properties, F.array().cast("array<string>"))), "; ")
    ids = F.array_compact(F.array(*[F.when(of_variant(F.col("v"), field).isNotNull(), F.struct(F.lit(kind).alias("type"), of_variant(F.col("v"), field).alias("value"))) for field, kind in IDENTIFIERS.items()]))
    pictures = F.coalesce(F.try_variant_get("v", "$.image", "array<string>"), F.array_compact(F.array(F.coalesce(F.try_variant_get("v", "$.image.url", "string"), F.try_variant_get("v", "$.image.contentUrl", "string"), F.try_variant_get("v", "$.image", "string")))))
    return nodes.select(key, "path", "in_variant", F.nullif(text, F.lit("")).alias("text"), ids.alias("identifiers"), pictures.alias("images"))


# The whole


def instruction_urls(tree: Column, url: Column) -> Column:
    links = F.filter(M.select(tree, "a[href]"), lambda a: F.concat_ws(" ", a["attrs"]["href"], M.text_of(tree, a)).rlike(INSTRUCTIONS))
    return F.array_distinct(F.array_compact(F.transform(links, lambda a: absolute(a["attrs"]["href"], url))))


def page_evidence(pages: DataFrame, key: str = "page_id", brand: str = "brand", url: str = "url", shared: bool = False) -> DataFrame:
    """Pages with `tree` as cards that identity.identify() reads: key, brand, title, variants, strong, weak, family; identifiers, image_urls, instruction_urls.

    `shared` is for sites whose pages are of all variants together: their page texts describe reviews, so no description
    counts, and a page is a family's unless its title alone proves a variant.
    """
    pages = written_once(pages, "pages")  # three parts of what follows read the trees
    texts = telling_texts(pages, key, brand).select(key, "source", "place", "text")
    texts = texts.filter(~F.col("source").isin("meta", "description")) if shared else texts
    ld = written_once(ld_texts(ld_nodes(pages, key, brand), key), "nodes")
    told = ld.filter("text is not null")
    of_ld = told.select(key, F.explode(F.array_compact(F.array(F.struct(F.lit("json_ld").alias("source"), "path", "text"), F.when(F.col("in_variant") & tells(F.col("text")), F.struct(F.lit("variant").alias("source"), "path", "text"))))).alias("t")).select(key, "t.*")
    rows = of_ld.select(key, "source", F.lit(-1).alias("place"), "path", "text").unionByName(texts.select(key, "source", "place", F.lit("").alias("path"), "text"))
    # Of equal texts of one kind the first stays.
    same = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}%№.,]+", " ")
    rows = rows.groupBy(key, "source", same.alias("same")).agg(F.min(F.struct("place", "path", "text")).alias("t"))
    listed = lambda *kinds: F.transform(F.array_sort(F.collect_list(F.when(F.col("source").isin(*kinds), F.col("t")))), lambda t: t["text"])
    variants = F.count_if(F.col("source") == "variant")
    cards = rows.groupBy(key).agg(F.get(listed("title"), F.lit(0)).alias("title"), listed("variant").alias("variants"), listed("json_ld").alias("strong"), listed("attribute", "meta", "description", "instruction", "image").alias("weak"), (variants > 1).alias("several"))
    marks = ld.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("identifiers"))).alias("identifiers"), F.array_distinct(F.flatten(F.collect_list("images"))).alias("images"))
    kept = pages.select(key, brand, url, M.first_attribute(F.col("tree"), "meta[property='og:image']", "content").alias("_image"), instruction_urls(F.col("tree"), F.col(url)).alias("instruction_urls"))
    out = kept.join(cards, key, "left").join(marks, key, "left")
    none = F.array().cast("array<string>")
    pictures = F.filter(F.concat(F.coalesce("images", none), F.array_compact(F.array("_image"))), lambda u: u.startswith("https://"))
    family = F.coalesce("several", F.lit(False)) | (F.lit(shared) & ~I.proves_variant(F.coalesce("title", F.lit("")), F.col(brand)))
    return out.select(key, brand, url, F.coalesce("title", F.lit("")).alias("title"), *[F.coalesce(c, none).alias(c) for c in ("variants", "strong", "weak")], family.alias("family"), "identifiers", F.array_distinct(pictures).alias("image_urls"), "instruction_urls")
