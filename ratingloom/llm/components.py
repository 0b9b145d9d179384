"""Connected components by alternating large and small stars; everything stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def canonical(edges: DataFrame) -> DataFrame:
    """Distinct edges (u, v) with u > v."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return canonical(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return canonical(edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id and component (the smallest id reachable) of every node of `edges` (u, v). Each round is written and the last one's table dropped.

    A hot node costs no single task its edges: minima are pre-aggregated, and joins on a hot key can be split.
    """
    now = scratch.keep(canonical(edges), "edges")
    seen = mark(now)
    while seen[0]:
        after = scratch.keep(small_star(large_star(now)), "edges")
        scratch.drop(now)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def mark(edges: DataFrame) -> tuple:
    """Tells one set of edges from another."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
