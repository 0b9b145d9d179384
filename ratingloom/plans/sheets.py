"""Queries of old report sheets, written of parts: a brand has a sheet for each thousand of them, and its number decides on the layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sheets as S
from ..registry import query
from .bindings import table

BRAND_NUMBER = "CAST(substring(p_brand, 7) AS INT)"
SHEET = "concat(p_brand, '/', CAST(floor(p_partkey / 1000) AS BIGINT))"
LAYOUT = f"({BRAND_NUMBER} % 5)"
#: Sheets of even numbers have a title above the header.
HEADER = f"CASE WHEN {BRAND_NUMBER} % 2 = 0 THEN 1 ELSE 0 END"
LABEL = "CASE {0} WHEN 0 THEN 'platform first' WHEN 1 THEN 'link first' WHEN 2 THEN 'one brand, link first' WHEN 3 THEN 'one brand, platform first' ELSE 'plain' END"
URL = "concat('https://www.n', p_partkey % 7, '.example/p/', p_partkey)"
NAME = "concat(p_brand, ' ', p_name)"
#: Cells of a product's row, by layout: (column, text).
ROWS = f"""CASE {LAYOUT} WHEN 0 THEN array(named_struct('col', 0, 'text', p_brand), named_struct('col', 1, 'text', 'x'), named_struct('col', 2, 'text', {URL}), named_struct('col', 3, 'text', {NAME}))
  WHEN 1 THEN array(named_struct('col', 0, 'text', p_brand), named_struct('col', 1, 'text', {URL}), named_struct('col', 2, 'text', {NAME})) WHEN 2 THEN array(named_struct('col', 0, 'text', {URL}), named_struct('col', 1, 'text', 'x'), named_struct('col', 2, 'text', {NAME}))
  WHEN 3 THEN array(named_struct('col', 0, 'text', 'x'), named_struct('col', 1, 'text', {URL}), named_struct('col', 2, 'text', {NAME})) ELSE array(named_struct('col', 0, 'text', {URL}), named_struct('col', 1, 'text', {NAME})) END"""
HEADS = {0: "Бренд|Площадка|Ссылка|Продукт", 1: "Бренд|Ссылка|Продукт|", 2: "Ссылка|Площадка|Продукт|", 3: "Площадка|Ссылка|Продукт|", 4: "Адрес|Продукт|"}


def cells(spark, d):
    """The sheets' cells: title, header with two months, a row under it, a section, products."""
    parts = table(spark, d, "part").withColumns({"layout": F.expr(LAYOUT), "header": F.expr(HEADER), "first": F.expr(f"CASE WHEN {LAYOUT} = 4 THEN 3 ELSE 4 END")})
    sheets = parts.select(F.expr(SHEET).alias("sheet"), "layout", "header", "first").distinct()
    cell = lambda row, col, text: F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"), text.cast("string").alias("text"))
    heads = F.split(F.element_at(F.create_map(*[F.lit(v) for item in HEADS.items() for v in item]), F.col("layout")), r"\|")
    months = F.array(cell(F.col("header"), F.col("first"), F.lit("Июнь 2026")), cell(F.col("header"), F.col("first") + 1, F.lit("")), cell(F.col("header"), F.col("first") + 2, F.lit(" июль")), cell(F.col("header"), F.col("first") + 4, F.lit("Итого")))
    top = F.concat(F.transform(heads, lambda h, i: cell(F.col("header"), i, h)), months, F.array(cell(F.col("header") + 1, F.col("first"), F.lit("Отзывы")), cell(F.col("header") + 2, F.lit(0), F.lit("Раздел"))), F.when(F.col("header") == 1, F.array(cell(F.lit(0), F.lit(0), F.lit("Рейтинги 2026")))).otherwise(F.array().cast("array<struct<row:int,col:int,text:string>>")))
    # Rows follow each other with gaps, as sheets with deleted rows do.
    row = F.col("p_partkey").cast("int") + 10
    values = F.array(cell(row, F.col("first"), F.col("p_size")), cell(row, F.col("first") + 1, F.expr("concat(p_size % 5, ',', p_size % 10)")), cell(row, F.col("first") + 2, F.expr("CASE WHEN p_partkey % 3 = 0 THEN '—' ELSE concat('1 ', lpad(p_size, 3, '0')) END")))
    body = F.concat(F.transform(F.expr(ROWS), lambda c: cell(row, c["col"], c["text"])), values)
    flat = sheets.select("sheet", F.inline(top)).unionByName(parts.select(F.expr(SHEET).alias("sheet"), F.inline(body)))
    return flat.filter("text <> ''")


def brands(spark, d):
    return table(spark, d, "part").select(F.expr(SHEET).alias("sheet"), F.col("p_brand").alias("brand")).distinct()


@query("fmt17_sheet_layouts", f"SELECT DISTINCT {SHEET} AS sheet, {LABEL.format(f'(CAST(substring(p_brand, 7) AS INT) % 5)')} AS layout, {HEADER} AS header FROM part")
def fmt17_layouts(spark, d):
    return S.layouts(cells(spark, d)).select("sheet", "layout", "header")


@query("fmt17_old_sheets", f"""SELECT {SHEET} AS sheet, CAST(p_partkey + 10 AS INT) AS row, 'Раздел' AS section, concat('n', p_partkey % 7, '.example') AS domain, p_brand AS brand, {NAME} AS product, m.month, CASE m.month WHEN '2026-06' THEN p_size WHEN '2026-07' THEN CASE WHEN p_partkey % 3 <> 0 THEN 1000 + p_size END END AS reviews,
  CASE m.month WHEN '2026-06' THEN p_size % 5 + (p_size % 10) / 10.0 END AS rating FROM part, (SELECT unnest(['2026-06', '2026-07']) AS month) m""")
def fmt17(spark, d):
    """Every product and month of sheets in five layouts."""
    found = S.read_sheets(cells(spark, d), 2026, brands(spark, d))
    return found.select("sheet", "row", "section", "domain", "brand", "product", "month", "reviews", "rating")


@query("fmt17_sheet_products", f"SELECT {SHEET} AS sheet, count(*) AS products, '2026-06' AS first_month, '2026-07' AS last_month, CAST(sum(p_size) AS BIGINT) AS reviews FROM part GROUP BY 1")
def fmt17_products(spark, d):
    found = S.products_of(S.read_sheets(cells(spark, d), 2026, brands(spark, d)))
    return found.groupBy("sheet").agg(F.count("*").alias("products"), F.min("first_month").alias("first_month"), F.max("last_month").alias("last_month"), F.sum(F.element_at("months", F.lit("2026-06"))["reviews"]).alias("reviews"))
