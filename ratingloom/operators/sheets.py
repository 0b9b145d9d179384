"""Report sheets of earlier years, cell by cell, back into products and months.

Cells are rows (sheet, row, col, text). Five layouts are told apart by what stands in the header row; above it there may
be a row with the report's title. Months stand over pairs of columns, reviews and rating.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_of_label
from ..functions.numbers import plain_number
from ..functions.text import folded
from ..functions.urls import domain, listing_id
from .checks import assert_none
from .joins import by_words

#: The first header cells of each layout, and its columns of address, product and brand, and of the first month.
LAYOUTS = {
    "platform first": (("бренд", "площадка", "ссылка"), 2, 3, 0, 4),
    "link first": (("бренд", "ссылка"), 1, 2, 0, 4),
    "one brand, link first": (("ссылка", "площадка", "продукт"), 0, 2, None, 4),
    "one brand, platform first": (("площадка", "ссылка", "продукт"), 1, 2, None, 4),
    "plain": ((), 0, 1, None, 3),
}
#: What a row above the header says: ratings of something, or Рейтинги.
TITLES = r"^рейтинги( |$)|(^| )ratings$"
#: Cells of a sheet: one that has more is no report.
MOST_CELLS = 50_000


def layouts(cells: DataFrame, sheet: str = "sheet") -> DataFrame:
    """sheet, layout, its header's row, and its columns. Only the first two rows are looked at, and counted before any shuffle."""
    at = lambda r, c: F.max(F.when((F.col("row") == r) & (F.col("col") == c), folded(F.col("text"))))
    top = cells.filter("row < 2").groupBy(sheet).agg(at(0, 0).alias("title"), *[at(r, c).alias(f"h{r}{c}") for r in (0, 1) for c in range(3)])
    known = cells.select(sheet).distinct().join(top, sheet, "left")
    titled = F.coalesce(F.col("title").rlike(TITLES), F.lit(False))
    header = [F.when(titled, F.col(f"h1{c}")).otherwise(F.col(f"h0{c}")) for c in range(3)]
    choice = None
    for name, (words, *places) in LAYOUTS.items():
        made = F.struct(F.lit(name).alias("layout"), *[F.lit(p).cast("int").alias(n) for n, p in zip(("url", "product", "brand", "first"), places)])
        fits = F.lit(True)
        for cell, word in zip(header, words):
            fits = fits & F.coalesce(cell == word, F.lit(False))
        choice = F.when(fits, made) if choice is None else choice.when(fits, made)
    return known.select(sheet, titled.cast("int").alias("header"), choice.alias("l")).select(sheet, "header", "l.*")


def read_sheets(cells: DataFrame, year: int, brands: DataFrame | None = None, sheet: str = "sheet") -> DataFrame:
    """A row for each product and month: sheet, row, layout, section, domain, listing_id, url, brand, product, month, reviews, rating.

    Rows without an https address are no products; one whose only text is its first is a section, and is carried down.
    `brands` (sheet, brand) are those that a sheet is of: a sheet of one brand without a column of brands is that one's; else
    a brand is looked for in the product's name and in its address. Cells that hold no number are null, and so is a month's
    pair where both are. A sheet of over MOST_CELLS cells, or with one cell twice, fails the query.
    """
    n = assert_none(cells.groupBy(sheet).agg(F.count("*").alias("n")), F.col("n") > MOST_CELLS, f"a sheet of over {MOST_CELLS} cells")
    shaped = layouts(cells, sheet).join(n, sheet)
    # One row for each row of a sheet: what is joined with the layouts is as many rows as products, not as cells.
    rows = cells.groupBy(sheet, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("cells"))
    placed = rows.join(shaped, sheet)
    columns = F.array_sort(F.filter(F.map_keys("cells"), lambda c: (c >= F.col("first")) & ((c - F.col("first")) % 2 == 0)))
    months = F.filter(F.transform(columns, lambda c: F.struct(month_of_label(F.element_at("cells", c), year).alias("month"), c.alias("col"))), lambda m: m["month"].isNotNull())
    heads = placed.filter("row = header").select(sheet, months.alias("months"))
    in_sheet = Window.partitionBy(sheet).orderBy("row")  # MOST_CELLS bounds it
    text = lambda column: F.trim(F.element_at("cells", F.col(column)))
    alone = (F.size("cells") == 1) & (F.element_at("cells", F.lit(0)).isNotNull())
    body = placed.filter("row > header + 1").withColumns({"address": text("url"), "named": text("product"), "stored": F.when(F.col("brand").isNotNull(), text("brand"))})
    is_product = F.coalesce(F.col("address").rlike("(?i)^https://"), F.lit(False))
    body = body.withColumn("section", F.last(F.when(alone & ~is_product, F.trim(F.element_at("cells", F.lit(0)))), ignorenulls=True).over(in_sheet)).filter(is_product)
    body = body.withColumn("stored", F.nullif("stored", F.lit("")))
    if brands is not None:
        body = with_brands(body, brands, sheet)
    else:
        body = body.withColumn("found", F.col("stored"))
    flat = body.join(heads, sheet).select(sheet, "row", "layout", "section", F.col("address").alias("url"), F.col("found").alias("brand"), F.coalesce("named", F.lit("")).alias("product"), "cells", F.explode("months").alias("m"))
    metric = lambda shift: plain_number(F.element_at("cells", F.col("m.col") + shift))
    return flat.select(sheet, "row", "layout", "section", domain(F.col("url")).alias("domain"), listing_id(F.col("url")).alias("listing_id"), "url", "brand", "product", F.col("m.month").alias("month"), metric(0).cast("long").alias("reviews"), metric(1).alias("rating"))


def with_brands(rows: DataFrame, brands: DataFrame, sheet: str) -> DataFrame:
    """Adds `found`: the stored brand, else the sheet's only one, else the longest of its brands in name or address."""
    asked = brands.groupBy(sheet).agg(F.count("*").alias("_n"), F.min("brand").alias("_only"))
    sole = F.when(F.col("layout").startswith("one brand") & (F.col("_n") == 1), F.col("_only"))
    rows = rows.join(asked, sheet, "left").withColumn("_sole", F.coalesce("stored", sole))
    words = rows.filter("_sole is null").select(F.struct(sheet, "row").alias("_key"), folded(F.concat_ws(" ", "named", F.regexp_replace("address", r"[-_+/.?&=%]", " "))).alias("_words"))
    names = brands.select(F.col(sheet).alias("_sheet"), F.col("brand").alias("_brand"), folded(F.col("brand")).alias("_known"))
    met = by_words(words, "_key", "_words", names.select("_known").distinct(), "_known").join(names, "_known").filter(F.col(f"_key.{sheet}") == F.col("_sheet"))
    best = met.groupBy("_key").agg(F.max_by("_brand", F.struct(F.length("_known"), "_known")).alias("_met"))
    best = best.select(F.col(f"_key.{sheet}").alias(sheet), F.col("_key.row").alias("row"), "_met")
    return rows.join(best, [sheet, "row"], "left").withColumn("found", F.coalesce("_sole", "_met")).drop("_n", "_only", "_sole", "_met")


def products_of(months: DataFrame, sheet: str = "sheet") -> DataFrame:
    """One row for each listing of a sheet, with its first and last month and its months as a map."""
    pair: Column = F.struct("reviews", "rating")
    return months.groupBy(sheet, "domain", "listing_id").agg(F.first("brand").alias("brand"), F.first("product").alias("product"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.map_from_entries(F.collect_list(F.struct("month", pair))).alias("months"))
