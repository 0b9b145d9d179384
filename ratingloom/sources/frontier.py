"""Searches followed page by page through what was captured, with proof that nothing is left.

All searches go forward together, one round for each step from their first page. Each round meets the captured links by
the page's address and leaves out pages met before, so a cycle ends by itself. A search over its limit of pages or
products fails the query: it is never cut short. One with links to pages that were not captured is not exhausted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checks import assert_none
from .sinks import written_once

PAGES, PRODUCTS = 50, 500


def follow(starts: DataFrame, links: DataFrame, captured: DataFrame, pages: int = PAGES) -> DataFrame:
    """search, url, round and captured for every page that a search reaches.

    starts: (search, url); links: (url, next); captured: (url). Pages that are not captured have no links.
    """
    known = captured.select("url").distinct()
    new = written_once(starts.select("search", "url").distinct().withColumn("round", F.lit(0)), "frontier")
    met = new
    while not new.isEmpty():
        step = new.select("search", "url", "round").join(links, "url").select("search", F.col("next").alias("url"), (F.col("round") + 1).alias("round")).distinct()
        new = written_once(step.join(met, ["search", "url"], "left_anti"), "frontier")
        met = met.unionByName(new)
        over = met.groupBy("search").agg(F.count("*").alias("n")).filter(F.col("n") > pages)
        if not over.isEmpty():
            raise ValueError(f"a search of over {pages} pages without proof that it ends: {over.first()['search']}")
    return met.join(known.withColumn("captured", F.lit(True)), "url", "left").select("search", "url", "round", F.coalesce("captured", F.lit(False)).alias("captured"))


def discovered(reached: DataFrame, products: DataFrame, limit: int = PRODUCTS) -> DataFrame:
    """search with its pages, distinct products, and whether it is exhausted; products: (url, product)."""
    found = reached.join(products, "url").groupBy("search", "product").agg(F.lit(1).alias("one")).groupBy("search").agg(F.count("*").alias("products"))
    found = assert_none(found, F.col("products") > limit, f"a search of over {limit} products")
    pages = reached.groupBy("search").agg(F.count("*").alias("pages"), F.max("round").alias("depth"), F.every("captured").alias("exhausted"))
    return pages.join(found, "search", "left").select("search", "pages", "depth", "exhausted", F.coalesce("products", F.lit(0)).alias("products"))
