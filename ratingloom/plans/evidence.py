"""Queries of page evidence, selectors and JSON walks, over pages written of the parts table and over the table of pages.

A written page is one of four kinds: its product stands in JSON-LD, in its title, in variants under a group, or in a list
of attributes; reviews and other products on it say something else, which must not count.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.json_walk import first_of_names, walk
from ..functions.spread import spread
from ..operators import identity as I
from ..registry import query
from ..sources import captured
from ..sources import evidence as E
from ..sources import markup as M
from ..sources.connectors import STANDARD
from .bindings import table

COUNT = "(p_size % 30 + 2)"
PRODUCT = f"concat('капсулы ', p_size, ' мг №', {COUNT})"
SECOND = f"concat('капсулы ', p_size + 1, ' мг №', {COUNT})"
LD = f"""CASE p_partkey % 4
  WHEN 0 THEN concat('<script type="application/ld+json">{{"@graph":[{{"@type":["Thing","Product"],"name":"', p_brand, '","brand":{{"@type":"Brand","name":"', p_brand, '"}},"dosageForm":"капсулы","strength":"', p_size, ' мг","packageSize":', {COUNT}, ',"sku":', p_partkey, ',"image":"https://x.example/i/', p_partkey, '.jpg","review":{{"@type":"Review","name":"', p_brand, ' капсулы 999 мг №99"}}}}]}}</script>')
  WHEN 2 THEN concat('<script type="application/ld+json">[{{"@type":"ProductGroup","name":"', p_brand, ' все","hasVariant":[{{"@type":"Product","name":"', {PRODUCT}, '"}},{{"name":"', {SECOND}, '"}}]}},{{"@type":"Product","name":"Иное капсулы 7 мг №7"}}]</script><script type="application/ld+json">{{oops</script>')
  ELSE '' END"""
DECOYS = """'<ul><li class="user-review">Форма выпуска <table><tr><th>Форма выпуска</th><td>капсулы 999 мг №99</td></tr></table></li></ul><div data-review-id="5"><dl><dt>Дозировка</dt><dd>999 мг</dd></dl><img alt="капсулы 999 мг №99"></div><div class="related"><span class="score">1.0</span></div>'"""
BODY = f"""CASE p_partkey % 4 WHEN 1 THEN concat('<img alt="', p_brand, ' ', {PRODUCT}, '"><img alt="вид"><p class="score" data-rating="4.', p_size % 10, '">x</p>')
  WHEN 3 THEN concat('<dl><dt>Форма выпуска</dt><dd>капсулы</dd><dt>Дозировка</dt><dd>', p_size, ' мг</dd><dt>Отзывы</dt><dd>по 5 капсул</dd><dt>Количество в упаковке</dt><dd>', {COUNT}, '</dd></dl><a href="/doc/', p_partkey, '">Инструкция</a>') ELSE '<b class="score">4</b><b class="score">5</b>' END"""
HTML = f"concat('<html><head><title>t</title>', {LD}, '</head><body><h1> ', p_brand, CASE WHEN p_partkey % 4 = 1 THEN concat('\n', {PRODUCT}) ELSE '' END, '</h1>', {DECOYS}, {BODY}, '</body></html>')"


def pages(spark, d):
    rows = spread(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").select(F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("brand"), F.expr("concat('https://x.example/p/', p_partkey)").alias("url"), F.expr(HTML).alias("html"))
    return M.with_tree(rows)


FIELDS = f"concat('Название: ', p_brand, '; Лекарственная форма: капсулы; Дозировка: ', p_size, ' мг; Количество в упаковке: ', {COUNT})"


@query("pi15_page_evidence", f"""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 4 = 1 THEN concat(p_brand, ' ', {PRODUCT}) ELSE p_brand END AS title,
  CASE p_partkey % 4 WHEN 0 THEN {FIELDS} WHEN 2 THEN concat('Название: ', {PRODUCT}, ' | Название: ', {SECOND}) ELSE '' END AS strong, CASE p_partkey % 4 WHEN 2 THEN concat('Название: ', {PRODUCT}, ' | Название: ', {SECOND}) ELSE '' END AS variants,
  CASE p_partkey % 4 WHEN 1 THEN concat(p_brand, ' ', {PRODUCT}) WHEN 3 THEN concat('Форма выпуска: капсулы; Дозировка: ', p_size, ' мг; Количество в упаковке: ', {COUNT}) ELSE '' END AS weak, p_partkey % 4 = 2 AS family,
  CASE WHEN p_partkey % 4 = 0 THEN concat('sku:', p_partkey) ELSE '' END AS identifiers, CASE WHEN p_partkey % 4 = 0 THEN concat('https://x.example/i/', p_partkey, '.jpg') ELSE '' END AS image_urls, CASE WHEN p_partkey % 4 = 3 THEN concat('https://x.example/doc/', p_partkey) ELSE '' END AS instruction_urls FROM part""")
def pi15(spark, d):
    """Texts of each kind; reviews, other products and broken scripts do not count."""
    found = E.page_evidence(pages(spark, d))
    joined = [F.array_join(c, " | ").alias(c) for c in ("strong", "variants", "weak", "image_urls", "instruction_urls")]
    return found.select("page_id", "title", *joined, "family", F.coalesce(F.array_join(F.transform("identifiers", lambda i: F.concat_ws(":", i["type"], i["value"])), " "), F.lit("")).alias("identifiers"))


@query("pi15_identified_pages", f"""SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 2 THEN concat('Общий рейтинг: ', {PRODUCT}, '; ', {SECOND}) ELSE {PRODUCT} END AS label, CASE p_partkey % 4 WHEN 2 THEN 'family' ELSE 'variant' END AS granularity FROM part""")
def pi15_identified(spark, d):
    """Page evidence through the identity engine: where a title says nothing, the page does."""
    return I.identify(E.page_evidence(pages(spark, d)), "brand", "title").select("page_id", "label", "granularity")


@query("fmt03_json_ld_evidence", f"""SELECT p_partkey AS page_id, 'false' AS in_variant, {FIELDS} AS text FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'true', concat('Название: ', unnest([{PRODUCT}, {SECOND}])) FROM part WHERE p_partkey % 4 = 2""")
def fmt03(spark, d):
    """Products of the brand in JSON-LD; variants under a group that names the brand need not name it."""
    return E.ld_texts(E.ld_nodes(pages(spark, d), "page_id", "brand"), "page_id").select("page_id", F.col("in_variant").cast("string").alias("in_variant"), "text")


@query("ex05_texts_by_kind", "SELECT p_partkey AS page_id, unnest(CASE p_partkey % 4 WHEN 1 THEN ['image', 'title'] WHEN 3 THEN ['attribute', 'title'] ELSE ['title'] END) AS source, 1 AS n FROM part")
def ex05(spark, d):
    return E.telling_texts(pages(spark, d), "page_id", "brand").groupBy("page_id", "source").agg(F.count("*").cast("int").alias("n"))


OPTIONS = f"""concat('<h2>Форма выпуска</h2><p>Капсулы по ', p_size, ' мг</p><h3>Отзывы</h3><p>капсулы 3 мг</p><div class="product-variant big"><select><option>', {PRODUCT}, '<option>', {SECOND}, '<option>все</select></div>',
  '<ul data-testid="x-product-variant-y"><li role="option" aria-label="', {SECOND}, '">да</li><li>', {PRODUCT}, '</li></ul><div id="product-description">', p_brand, ' капсулы</div><p class="comment-item"><span itemprop="description">капсулы 8 мг</span></p><a href="/a">Состав: капсулы ', p_size, ' мг</a><figure><img src="/i.png"><figcaption>Капсулы №', {COUNT}, '</figcaption></figure>')"""


@query("ex05_visible_texts", f"""SELECT p_partkey AS page_id, unnest([concat('description|', p_brand, ' капсулы'), concat('image|Капсулы №', {COUNT}), concat('instruction|Состав: капсулы ', p_size, ' мг'), concat('instruction|Форма выпуска: Капсулы по ', p_size, ' мг'), concat('variant|', {PRODUCT}), concat('variant|', {SECOND}), concat('variant|', {SECOND})]) AS text FROM part""")
def ex05_visible(spark, d):
    """Options, instruction sections, descriptions and captions, and none of what stands in comments."""
    rows = spread(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").select(F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("brand"), F.expr(OPTIONS).alias("html"))
    return E.telling_texts(M.with_tree(rows), "page_id", "brand").select("page_id", F.concat_ws("|", "source", "text").alias("text"))


@query("fmt05_configured_selectors", f"""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 4 = 1 THEN concat(p_brand, ' ', {PRODUCT}) ELSE p_brand END AS name, CASE WHEN p_partkey % 4 = 1 THEN concat('4.', p_size % 10) END AS rating, p_partkey % 4 IN (0, 2) AS ambiguous FROM part""")
def fmt05(spark, d):
    """Values of configured selectors: several elements are ambiguous, and so is one among related products."""
    return M.configured(pages(spark, d), "body > h1", "p.score, b.score").select("page_id", "name", "rating", "ambiguous")


@query("fmt05_page_elements", r"""SELECT page_id, len(regexp_extract_all(html, '<li><a href="')) AS links, len(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p[ >]')) AS paragraphs, array_to_string(regexp_extract_all(html, '<li><a href="([^"]*)"', 1), ' ') AS hrefs FROM pages""")
def fmt05_pages(spark, d):
    """Elements of real pages, unclosed paragraphs and all."""
    tree = F.col("tree")
    links = M.select(tree, "nav > ul li > a[href]")
    return M.with_tree(table(spark, d, "pages")).select("page_id", F.size(links).cast("long").alias("links"), F.size(M.select(tree, "article p")).cast("long").alias("paragraphs"), F.array_join(F.transform(links, lambda n: n["attrs"]["href"]), " ").alias("hrefs"))


@query("fmt07_attribute_pairs", f"""SELECT p_partkey AS page_id, concat('Форма выпуска=капсулы; Дозировка=', p_size, ' мг; Отзывы=по 5 капсул; Количество в упаковке=', {COUNT}) AS pairs FROM part WHERE p_partkey % 4 = 3""")
def fmt07_pairs(spark, d):
    """Rows of tables and terms of lists that stand outside reviews."""
    found = F.transform(E.pairs(F.col("tree"), M.select(F.col("tree"), E.REVIEWS)), lambda r: F.concat_ws("=", r["label"], r["text"]))
    return pages(spark, d).select("page_id", F.array_join(found, "; ").alias("pairs")).filter("pairs <> ''")


NESTED = """concat('{"k":', p_size, ',"a":[{"k":"', p_brand, '"},[', p_partkey, ',{"deep":{"er":null}}]],"t":true}')"""


@query("uf09_key_walk", """SELECT p_partkey, unnest(['$', '$.a', '$.a[0]', '$.a[0].k', '$.a[1]', '$.a[1][0]', '$.a[1][1]', '$.a[1][1].deep', '$.a[1][1].deep.er', '$.k', '$.t']) AS path, unnest(['object', 'array', 'object', 'string', 'array', 'bigint', 'object', 'object', 'void', 'bigint', 'boolean']) AS kind,
  unnest([0, 1, 2, 3, 2, 3, 3, 4, 5, 1, 1]) AS depth, unnest([NULL, NULL, NULL, p_brand, NULL, CAST(p_partkey AS VARCHAR), NULL, NULL, NULL, CAST(p_size AS VARCHAR), 'true']) AS value FROM part""")
def uf09(spark, d):
    """Every value of nested JSON, whatever its keys are called."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(NESTED).alias("body"))
    return walk(rows, "p_partkey", "body").select("p_partkey", "path", "kind", "depth", F.when(~F.col("kind").isin("object", "array"), F.col("value")).alias("value"))


@query("uf09_first_of_names", "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def uf09_names(spark, d):
    return first_of_names(table(spark, d, "events"), "event_id", "props", ["k", "key"])


@query("src01_captured_pages", r"SELECT page_id, regexp_extract(lower(url), '^[a-z]+://(?:www\.)?([^/?#:]+)', 1) AS domain, url, length(html) AS n_html FROM pages")
def src01(spark, d):
    """The table of pages by the engine's own data source."""
    captured.register(spark)
    found = spark.read.format("captured_pages").load(f"{d}/pages.parquet")
    return found.select("page_id", "domain", "url", F.length("html").alias("n_html"))


@query("src01_connector_rows", r"SELECT page_id, regexp_extract(lower(url), '^[a-z]+://(?:www\.)?([^/?#:]+)', 1) AS domain, 'not_found' AS status, CAST(NULL AS VARCHAR) AS product FROM pages")
def src01_rows(spark, d):
    """The generic connector over the data source: pages that carry no product."""
    captured.register(spark)
    return STANDARD.collect(spark.read.format("captured_pages").load(f"{d}/pages.parquet")).select("page_id", "domain", "status", "product")
