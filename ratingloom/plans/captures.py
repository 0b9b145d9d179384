"""Queries of datasets, files and sinks: what is written of a table, read back, and compared with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spread import spread
from ..operators import projections as P
from ..registry import query
from ..sources import datasets as D
from ..sources import payloads as R
from ..sources import sinks as S
from ..sources.publications import Publications, RevisionTaken
from .bindings import table


def place(spark, name: str) -> str:
    return S.scratch_path(spark, name)


#: Zero is no identifier.
LISTED = "SELECT '{domain}' AS domain, CAST({key} AS VARCHAR) AS listing_id, p_name AS product, CAST({key} % 7 AS BIGINT) AS reviews, CASE WHEN {key} % 7 > 0 THEN CAST(({key} % 41 + 10) * 10 AS BIGINT) END AS rating_x100, CASE WHEN {key} % 7 > 0 THEN 'ok' ELSE 'no_reviews' END AS status FROM part WHERE {key} > 0{where}"


@query("src11_dataset_columns", LISTED.format(domain="ozon.ru", key="p_partkey", where=" AND p_partkey IN (SELECT l_partkey FROM lineitem)"))
def src11(spark, d):
    """Items with a column for each value, an order's listings in each; a listing of many orders merges."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey").agg(F.collect_list(F.struct("p_partkey", "p_name")).alias("s"))
    item = F.to_json(F.struct(F.transform("s", lambda v: F.concat(F.lit("0"), v["p_partkey"].cast("string"))).alias("sku"), F.col("s.p_name").alias("title"), F.transform("s", lambda v: v["p_partkey"] % 7).alias("reviewCount"), F.transform("s", lambda v: (v["p_partkey"] % 41 + 10) / 10).alias("rating")))
    return D.observations_of(lines.select(item.alias("item")), D.OZON).select("domain", "listing_id", "product", "reviews", (F.col("rating") * 100).cast("long").alias("rating_x100"), "status")


@query("src13_dataset_unique", LISTED.format(domain="wildberries.ru", key="p_partkey", where=""))
def src13(spark, d):
    """Items of single listings, every third one given twice alike."""
    parts = spread(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    item = F.to_json(F.struct(F.col("p_partkey").alias("nmId"), F.col("p_name").alias("name"), (F.col("p_partkey") % 7).alias("feedbacks"), ((F.col("p_partkey") % 41 + 10) / 10).alias("reviewRating")))
    return D.observations_of(parts.union(parts.filter("p_partkey % 3 = 0")).select(item.alias("item")), D.WILDBERRIES).select("domain", "listing_id", "product", "reviews", (F.col("rating") * 100).cast("long").alias("rating_x100"), "status")


@query("src15_dataset_models", "SELECT CAST(p_partkey AS VARCHAR) AS listing_id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS reviews, CASE WHEN p_partkey % 5 = 0 THEN 'needs_review' ELSE 'ok' END AS status FROM part WHERE p_partkey % 9 > 0")
def src15(spark, d):
    """A model without a count waits for a person, one without an id is none; counts are also written in thousands."""
    model, count = F.when(F.col("p_partkey") % 9 > 0, F.col("p_partkey").cast("string")).otherwise("none"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_size").cast("string"))
    item = F.to_json(F.struct(model.alias("modelId"), F.col("p_name").alias("title"), count.alias("reviewCount"), F.lit("4,5").alias("rating")))
    return D.observations_of(table(spark, d, "part").select(item.alias("item")), D.YANDEX).select("listing_id", "reviews", "status")


ODD_TEXT = "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' \"q\"' WHEN 1 THEN ', c' WHEN 2 THEN ' \ttab' ELSE ' l1' END)"


@query("fmt14_quoted_csv", f"SELECT p_partkey, {ODD_TEXT} AS text FROM part")
def fmt14(spark, d):
    path = place(spark, "csv")
    table(spark, d, "part").select("p_partkey", F.concat(F.expr(ODD_TEXT), F.lit("\nsecond line")).alias("text")).write.option("quoteAll", True).option("escape", '"').csv(path)
    read = spark.read.schema("p_partkey long, text string").option("escape", '"').option("multiLine", True).csv(path)
    return read.select("p_partkey", F.replace("text", F.lit("\nsecond line"), F.lit("")).alias("text"))


@query("fmt15_clipboard_fields", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN ' \"q\"' ELSE '' END) AS name FROM part")
def fmt15(spark, d):
    """Clipboard rows, quoted where they must be, as fields again."""
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ' "q"').otherwise(""))
    line = F.concat_ws("\t", F.col("p_size").cast("string"), T.safe_cell(name))
    fields = F.from_csv(line, "size string, name string", {"sep": "\t", "quote": '"', "escape": '"'})
    return table(spark, d, "part").select("p_partkey", fields.alias("f")).select("p_partkey", "f.*")


@query("fmt12_embedded_state", "SELECT p_partkey, p_name AS name, CAST(p_size AS INTEGER) AS n FROM part")
def fmt12(spark, d):
    """An object in a script, with braces and quotes in its strings."""
    state = F.to_json(F.struct(F.struct(F.col("p_name").alias("name"), F.lit('} "x" {').alias("odd"), F.col("p_size").alias("n")).alias("review")))
    html = F.concat(F.lit("<script>var a = {}; window.STATE = "), state, F.lit("; next({});</script>"))
    found = R.embedded_state(table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html")), "window.STATE")
    v = F.try_parse_json("state")
    return found.select(F.col("page_id").alias("p_partkey"), F.try_variant_get(v, "$.review.name", "string").alias("name"), F.try_variant_get(v, "$.review.n", "int").alias("n"))


@query("fmt09_nested_sitemaps", "SELECT DISTINCT page_id FROM pages")
def fmt09(spark, d):
    """Sitemaps that list sitemaps, as a tree over the pages; every page is listed by one that the first one leads to."""
    rows = table(spark, d, "pages").select(F.col("page_id").cast("long").alias("k"))
    last = rows.agg(F.max("k")).first()[0]
    maps = spark.range(0, (last or 0) // 8 + 1).select(F.col("id").alias("m"))
    entry = lambda kind, n: F.concat(F.lit(f"<loc>https://m.example/{kind}/"), n.cast("string"), F.lit("</loc>"))
    nested = F.array_join(F.transform(F.filter(F.array(F.col("m") * 2 + 1, F.col("m") * 2 + 2), lambda n: n <= (last or 0) // 8), lambda n: entry("maps", n)), "")
    pages = F.array_join(F.transform(F.filter(F.sequence(F.col("m") * 8, F.col("m") * 8 + 7), lambda n: n <= (last or 0)), lambda n: entry("pages", n)), "")
    captured = maps.select(entry("maps", F.col("m")).alias("url"), F.concat(nested, pages).alias("xml")).withColumn("url", F.regexp_extract("url", "<loc>(.*)</loc>", 1))
    found = R.listed(captured, "https://m.example/maps/0", "/maps/")
    return found.select(F.regexp_extract("url", r"/pages/(\d+)$", 1).cast("long").alias("page_id"))


@query("fmt18_text_as_markup", "SELECT doc_id, md5('<p>' || replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '</p>' || chr(10) || '<p>') || '</p>') AS markup FROM documents")
def fmt18(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(R.markup_of(F.col("text"))).alias("markup"))


@query("snk02_replaced_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (strftime(o_orderdate, '%Y-%m') = '1997-06') AS again FROM orders GROUP BY 1")
def snk02(spark, d):
    """All months written, one of them written again: the others stay, and the one is there once."""
    path = place(spark, "months")
    rows = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.lit(0).alias("again"))
    S.replace_month(rows, path)
    S.replace_month(rows.filter("month = '1997-06'").withColumn("again", F.lit(1)), path)
    written = spark.read.schema("o_orderkey long, again int, month string").parquet(path)
    return written.groupBy("month").agg(F.count("*").alias("n"), F.sum("again").alias("again"))


@query("snk03_full_replace", "SELECT p_partkey, p_name FROM part")
def snk03(spark, d):
    path = place(spark, "registry")
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    S.replace_all(parts.withColumn("p_name", F.lit("spoilt")), path)
    S.replace_all(parts, path)
    return spark.read.schema(parts.schema).parquet(path)


@query("snk05_published_report", "SELECT 'first' AS run, true AS written, count(*) AS n FROM part UNION ALL SELECT 'same', false, count(*) FROM part UNION ALL SELECT 'changed', true, count(*) FROM part")
def snk05(spark, d):
    """A report is published once for one content: the second time nothing is written, and a change is."""
    path = place(spark, "sheets")
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    changed = parts.withColumn("p_size", F.col("p_size") + 1)
    runs = [("first", parts), ("same", parts), ("changed", changed)]
    done = [(name, S.publish(spark, rows, path, "sheet", "2026-07")) for name, rows in runs]
    return spark.createDataFrame(done, "run string, written boolean").join(F.broadcast(parts.agg(F.count("*").alias("n"))))


@query("snk06_commit_markers", "SELECT unnest(['a', 'a', 'b']) AS writer, unnest([1, 2, 3]) AS number, count(*) + unnest([0, 0, 1]) AS n FROM part")
def snk06(spark, d):
    """Two writers of one sheet: one publishes twice, the other comes too late with its first and repeats it onto the latest revision."""
    path = place(spark, "publications")
    rows = table(spark, d, "part").select("p_partkey", "p_size")
    more = rows.unionByName(rows.agg((F.max("p_partkey") + 1).alias("p_partkey"), F.first(F.lit(0).cast("int")).alias("p_size")).select(*[F.col(c).cast(t).alias(c) for c, t in rows.dtypes]))
    one, two = Publications(spark, path, "a"), Publications(spark, path, "b")
    first, _ = one.publish(rows, "sheet", "2026-07", onto=0)
    try:
        two.publish(more, "sheet", "2026-07", onto=0)
    except RevisionTaken:
        one.publish(rows.withColumn("p_size", F.col("p_size") + 1), "sheet", "2026-07", onto=first.number)
        two.publish(more, "sheet", "2026-07", onto=two.revision("sheet", "2026-07").number)
    return one.history().select(F.substring_index("writer", ":", 1).alias("writer"), "number", F.substring_index("hash", "-", 1).cast("long").alias("n"))


@query("snk08_json_dump", "SELECT p_brand AS brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1")
def snk08(spark, d):
    """Rows as JSON lines beside a summary; the summary is read back."""
    path = place(spark, "dump")
    S.dump_json(table(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_size"), path, ["brand"], {"n": F.count("*"), "total": F.sum("p_size")})
    return spark.read.schema("brand string, n long, total long").json(f"{path}/summary")


@query("prj09_collapsed_pages", "SELECT p_partkey, p_partkey % 4 = 1 AND p_size > 1 AS collapses FROM part")
def prj09(spark, d):
    """A shared rating of several pages whose title names something of its own."""
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 4 == 0, "variant").otherwise("family").alias("granularity"), F.when(F.col("p_partkey") % 4 == 2, "exact").otherwise("partial").alias("confidence"), F.lit(None).cast("int").alias("variant_count"), F.lit(True).alias("family"),
        F.array().cast("array<string>").alias("variants"), F.col("p_brand").alias("brand"), F.concat("p_brand", F.when(F.col("p_partkey") % 4 == 3, F.lit(" отзывы цена")).otherwise(F.concat(F.lit(" отзывы "), "p_name"))).alias("product"), F.col("p_size").alias("discovered"),
    )
    return rows.select("p_partkey", P.collapses_pages(T.normalize_text(F.col("brand")), T.normalize_text(F.col("product"))).alias("collapses"))


@query("prj19_title_evidence", "SELECT p_partkey, 'listing' AS scope, trim(p_name) AS title, CASE WHEN p_partkey % 2 = 0 THEN 'https://a.example/' || p_partkey END AS url, CAST(p_partkey AS VARCHAR) AS product_id FROM part")
def prj19(spark, d):
    link = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://a.example/"), F.col("p_partkey").cast("string")))
    rows = table(spark, d, "part").select("p_partkey", P.title_evidence(F.concat(F.lit("  "), "p_name", F.lit(" \n")), F.lit("product_id"), F.col("p_partkey").cast("string"), link).alias("e"))
    signal = lambda kind: F.get(F.filter("e.signals", lambda s: s["source"] == kind), F.lit(0))["text"]
    return rows.select("p_partkey", "e.scope", signal("title").alias("title"), signal("url").alias("url"), F.get("e.identifiers", F.lit(0))["value"].alias("product_id"))
