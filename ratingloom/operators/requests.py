"""Requests and answers that come as JSON, and the first thing that is wrong with each; null where nothing is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import domain
from .wording import PLATFORMS

#: Bounds of a batch request and of a sheet, and the addresses that a batch may name.
SITEMAPS, BRANDS, TOKENS, MOST_CELLS = 8, 200, 20, 50_000
SITEMAP = r"(?i)^https://reviews\.yandex\.ru/ugcpub/sitemap_model_\d+-\d+-\d+\.xml$"
TOKEN = r"(?iu)^[a-zа-я0-9]+( [a-zа-я0-9]+)*$"


def first_problem(*problems: tuple[str, Column]) -> Column:
    """The name of the first test that fails; what cannot be told fails."""
    return F.coalesce(*[F.when(~F.coalesce(fine, F.lit(False)), name) for name, fine in problems])


def size_within(array: Column, low: int, high: int) -> Column:
    return F.size(array).between(low, high)


def unique(array: Column) -> Column:
    return F.size(F.array_distinct(array)) == F.size(array)


def batch_problem(body: Column) -> Column:
    """What is wrong with a batch request {sitemaps, brands: [{brand, tokens}]}."""
    v = F.try_parse_json(body)
    keys = F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>"))
    sitemaps = F.try_variant_get(v, "$.sitemaps", "array<string>")
    brands = F.try_variant_get(v, "$.brands", "array<struct<brand:string,tokens:array<string>>>")
    length = lambda t: F.length(t).between(2, 160)
    return first_problem(
        ("no object", F.size(keys) > 0), ("unknown field", F.size(F.array_except(keys, F.array(F.lit("sitemaps"), F.lit("brands")))) == 0),
        ("sitemaps", size_within(sitemaps, 1, SITEMAPS)), ("sitemap address", F.forall(sitemaps, lambda s: s.rlike(SITEMAP))), ("repeated sitemap", unique(sitemaps)),
        ("brands", size_within(brands, 1, BRANDS)), ("brand", F.forall(brands, lambda b: length(b["brand"]) & (F.trim(b["brand"]) == b["brand"]))), ("repeated brand", unique(F.transform(brands, lambda b: b["brand"]))),
        ("tokens", F.forall(brands, lambda b: size_within(b["tokens"], 1, TOKENS) & unique(b["tokens"]))), ("token", F.forall(brands, lambda b: F.forall(b["tokens"], lambda t: length(t) & t.rlike(TOKEN)))),
    )


def read_back_problem(body: Column) -> Column:
    """What is wrong with a sheet that was read back: {rows, columns, values, formulas, merges, revision, spreadsheetId, tabName}."""
    v = F.try_parse_json(body)
    get = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    rows, columns = get("rows", "int"), get("columns", "int")
    values, formulas = get("values", "array<array<variant>>"), get("formulas", "array<array<string>>")
    merges = get("merges", "array<struct<startRow:int,endRow:int,startColumn:int,endColumn:int>>")
    wide = lambda table: F.forall(table, lambda r: F.size(r) == columns)
    inside = lambda m: (m["startRow"] >= 0) & (m["startColumn"] >= 0) & (m["endRow"] > m["startRow"]) & (m["endColumn"] > m["startColumn"]) & (m["endRow"] <= rows) & (m["endColumn"] <= columns)
    meet = lambda a, b: (a["startRow"] < b["endRow"]) & (b["startRow"] < a["endRow"]) & (a["startColumn"] < b["endColumn"]) & (b["startColumn"] < a["endColumn"])
    apart = F.forall(F.transform(merges, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda a: F.forall(F.transform(merges, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda b: (a["i"] >= b["i"]) | ~meet(a["m"], b["m"])))
    scalar = lambda c: ~F.coalesce(F.schema_of_variant(c).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    return first_problem(
        ("size", (rows >= 0) & (columns >= 0)), ("sheet_too_large", rows.cast("long") * columns <= MOST_CELLS), ("height", (F.size(values) == rows) & (F.size(formulas) == rows)), ("width", wide(values) & wide(formulas)),
        ("value", F.forall(values, lambda r: F.forall(r, scalar))), ("formula", F.forall(formulas, lambda r: F.forall(r, lambda f: f.isNull() | f.startswith("=")))), ("merge", F.forall(merges, inside)), ("overlapping merges", apart),
        ("revision", get("revision", "string").rlike("(?i)^[a-f0-9]{64}$")), ("spreadsheet", get("spreadsheetId", "string").rlike("^[a-zA-Z0-9_-]+$")), ("tab", get("tabName", "string").rlike(r"^\S.{0,98}\S$")),
    )


def custom_sites(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key and how many sites a text of sites names, apart by white space, commas or semicolons, that are no known platform; each once."""
    named = texts.select(key, F.explode_outer(F.split(F.col(text), r"[\s,;]+")).alias("_t")).select(key, domain(F.col("_t")).alias("_site"))
    known = texts.sparkSession.createDataFrame([(s, True) for s in PLATFORMS], "_site string, _known boolean")
    seen = named.filter("_site <> ''").distinct().join(F.broadcast(known), "_site", "left_anti").groupBy(key).agg(F.count("*").alias("custom"))
    return texts.select(key).distinct().join(seen, key, "left").select(key, F.coalesce("custom", F.lit(0)).alias("custom"))
