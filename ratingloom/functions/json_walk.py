"""Every value of JSON texts, however deep, by a recursive query: one round for each level, all in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

#: Levels at which a text is taken for an attack: an error, never a shorter result.
DEEPEST = 64


def levels(first: Column, below: Callable[[Column], Column], deepest: int, kept: Callable[[Column], Column] = lambda nodes: nodes) -> Column:
    """What is kept of the nodes of an array and of those `below` each, level by level as far as `deepest`, within a row."""
    grown = lambda s, nodes: F.struct(nodes.alias("front"), F.concat(s["all"], kept(nodes)).alias("all"))
    step = lambda s, _: F.when(F.size(s["front"]) == 0, s).otherwise(let(F.flatten(F.transform(s["front"], below)), lambda nodes: grown(s, nodes)))
    start = let(first, lambda nodes: F.struct(nodes.alias("front"), kept(nodes).alias("all")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(deepest)), start, step, lambda s: s["all"])


def recursive(rows: DataFrame, first: str, next_: str, columns: str, deepest: int) -> DataFrame:
    """The rows of `first`, and of `next_` over the rows of the level before, until there are none.

    Spark stops a recursion at a number of rows by default. Here the depth is what is bounded, so that is switched off.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(f"WITH RECURSIVE walk({columns}) MAX RECURSION LEVEL {deepest} AS (SELECT {first} FROM {{rows}} UNION ALL SELECT {next_}) SELECT * FROM walk", rows=rows)


def walk(rows: DataFrame, key: str, body: str, deepest: int = DEEPEST) -> DataFrame:
    """key with path, depth, name (null in arrays), kind (object, array or the scalar's type), and value as text, for each value of a text.

    A text that does not parse has no values; one that nests deeper than `deepest` levels fails the query.
    """
    texts = rows.select(F.col(key).alias("_key"), F.try_parse_json(F.col(body)).alias("_v")).filter("_v is not null")
    child = "concat(w.path, coalesce(concat('.', e.key), concat('[', e.pos, ']')))"
    found = recursive(texts, "_key, '$', 0, CAST(NULL AS STRING), _v", f"w.k, {child}, w.depth + 1, e.key, e.value FROM walk w, LATERAL variant_explode(w.v) e", "k, path, depth, name, v", deepest)
    kind = F.schema_of_variant("v")
    kind = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise(F.lower(F.regexp_extract(kind, r"^\w+", 0)))
    return found.select(F.col("k").alias(key), "path", "depth", "name", kind.alias("kind"), F.try_variant_get("v", "$", "string").alias("value"))


def first_of_names(rows: DataFrame, key: str, body: str, names: list[str]) -> DataFrame:
    """key and the value that stands first, by level and then by path, under any of the names; keys without one have none."""
    found = walk(rows, key, body).filter(F.col("name").isin(names) & ~F.col("kind").isin("object", "array", "void"))
    return found.groupBy(key).agg(F.min_by("value", F.struct("depth", "path")).alias("value"))
