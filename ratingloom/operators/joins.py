"""Joins that the pipeline needs beyond plain ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], prefer_old: tuple[str, ...] = ()) -> DataFrame:
    """Full outer merge by key: new values win, but for columns in `prefer_old`; a null never hides a value."""
    rest = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in key]
    a = old.select(*key, *[(F.col(c) if c in old.columns else F.lit(None)).alias(f"_old_{c}") for c in rest])
    b = new.select(*key, *[(F.col(c) if c in new.columns else F.lit(None)).alias(f"_new_{c}") for c in rest])
    pick = lambda c: F.coalesce(F.col(f"_old_{c}"), F.col(f"_new_{c}")) if c in prefer_old else F.coalesce(F.col(f"_new_{c}"), F.col(f"_old_{c}"))
    return a.join(b, key, "full").select(*key, *[pick(c).alias(c) for c in rest])


def upsert_within(rows: DataFrame, new: Column, key: list[str], values: dict[str, Column], prefer_old: tuple[str, ...] = ()) -> DataFrame:
    """upsert() of two parts of one table, those that are `new` and the others, each first aggregated by key into `values`.

    The parts are told apart in one pass: a key's rows meet once, in partial aggregates of both parts.
    """
    parts = rows.withColumn("_new", new).groupBy(*key, "_new").agg(*[v.alias(c) for c, v in values.items()])
    sides = [F.max(F.when(F.col("_new") == side, F.col(c))).alias(f"_{name}_{c}") for c in values for side, name in ((True, "new"), (False, "old"))]
    pick = lambda c: F.coalesce(F.col(f"_old_{c}"), F.col(f"_new_{c}")) if c in prefer_old else F.coalesce(F.col(f"_new_{c}"), F.col(f"_old_{c}"))
    return parts.groupBy(*key).agg(*sides).select(*key, *[pick(c).alias(c) for c in values])


def append_missing(rows: DataFrame, history: DataFrame, key: list[str]) -> DataFrame:
    """rows, and those of history whose key they lack."""
    return rows.unionByName(history.join(rows.select(*key), key, "left_anti"))


def with_fallback(primary: DataFrame, fallback: DataFrame, key: list[str], good: Column) -> DataFrame:
    """Good primary rows; for the other keys, the fallback's."""
    fine = primary.filter(good)
    return fine.unionByName(fallback.join(fine.select(*key).distinct(), key, "left_anti"))


def by_words(texts: DataFrame, text_key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """Texts with the names that stand in them as whole words: an equi-join on the name's first word, then a check.

    Both sides are normalised text; a name of several words is met at its first one, so no pair is tried that shares none.
    """
    tokens = texts.select(text_key, text, F.explode(F.array_distinct(F.split(text, " "))).alias("_first"))
    firsts = names.select(name, F.element_at(F.split(name, " "), 1).alias("_first")).filter("_first <> ''")
    met = tokens.join(firsts, "_first").filter(F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), name, F.lit(" "))))
    return met.select(text_key, name).distinct()


def in_range(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """points joined with the ranges that hold them: both meet in buckets of `width`, so it is an equi-join."""
    spread = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("_bucket", F.floor(F.col(point) / width)).join(spread, "_bucket").filter(F.col(point).between(F.col(low), F.col(high))).drop("_bucket")


def cell_diff(expected: DataFrame, found: DataFrame, key: list[str], text: str, number: str, tolerance: float = 1e-9) -> DataFrame:
    """Cells that differ: on one side only, other text, or numbers further apart than the tolerance."""
    a = expected.select(*key, F.col(text).alias("_a_text"), F.col(number).alias("_a_number"), F.lit(True).alias("_a"))
    b = found.select(*key, F.col(text).alias("_b_text"), F.col(number).alias("_b_number"), F.lit(True).alias("_b"))
    both = a.join(b, key, "full")
    apart = ~F.coalesce(F.abs(F.col("_a_number") - F.col("_b_number")) <= tolerance, F.col("_a_number").isNull() & F.col("_b_number").isNull())
    kind = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(~F.col("_a_text").eqNullSafe(F.col("_b_text")), "text").when(apart, "number")
    return both.select(*key, kind.alias("kind")).filter("kind is not null")


def overlapping(rects: DataFrame, key: str, group: list[str], bounds: tuple[str, str, str, str]) -> DataFrame:
    """Pairs of half-open rectangles of a group that share a cell; groups are tabs of one report, whose merges are few."""
    r0, r1, c0, c1 = bounds
    left = rects.select(*group, *[F.col(c).alias(f"_l_{c}") for c in (key, *bounds)])
    met = left.join(rects, group).filter((F.col(f"_l_{key}") < F.col(key)) & (F.col(f"_l_{r0}") < F.col(r1)) & (F.col(r0) < F.col(f"_l_{r1}")) & (F.col(f"_l_{c0}") < F.col(c1)) & (F.col(c0) < F.col(f"_l_{c1}")))
    return met.select(*group, F.col(f"_l_{key}").alias("first"), F.col(key).alias("second"))


def undominated(rows: DataFrame, group: list[str], traits: str, key: str) -> DataFrame:
    """Rows whose set of traits is no proper subset of another's in the group.

    Equal sets are one before they meet. A set looks only for those that have its rarest trait in the group, which every
    set above it must have.
    """
    spelled = rows.withColumn("_t", F.array_sort(F.array_distinct(traits)))
    sets = spelled.select(*group, "_t").distinct()
    held = sets.select(*group, "_t", F.explode("_t").alias("_trait"))
    common = held.groupBy(*group, "_trait").agg(F.count("*").alias("_n"))
    rarest = held.join(common, [*group, "_trait"]).groupBy(*group, "_t").agg(F.min_by("_trait", F.struct("_n", "_trait")).alias("_trait"))
    others = held.select(*group, F.col("_t").alias("_o"), "_trait")
    beaten = rarest.join(others, [*group, "_trait"]).filter((F.size("_o") > F.size("_t")) & (F.size(F.array_except("_t", "_o")) == 0)).select(*group, "_t").distinct()
    empty = sets.filter(F.size("_t") == 0).join(sets.filter(F.size("_t") > 0).select(*group).distinct(), group, "left_semi").select(*group, "_t")
    return spelled.join(beaten.union(empty), [*group, "_t"], "left_anti").select(*rows.columns)


def collisions(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows whose key several owners claim; counted once for each key and owner before the join."""
    claimed = rows.select(key, owner).distinct().groupBy(key).agg(F.count("*").alias("owners")).filter("owners > 1")
    return rows.join(claimed, key)


def one_sided(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one side has, and which."""
    both = a.select(*key).distinct().withColumn("_a", F.lit(1)).join(b.select(*key).distinct().withColumn("_b", F.lit(1)), key, "full")
    return both.filter("_a is null or _b is null").select(*key, F.when(F.col("_a").isNull(), "second").otherwise("first").alias("side"))


def inherit_sole(rows: DataFrame, group: str, label: str, exact: Column) -> DataFrame:
    """Rows without exact label take their group's, if it has exactly one."""
    sole = rows.filter(exact).groupBy(group).agg(F.count_distinct(label).alias("_n"), F.min(label).alias("_sole")).filter("_n = 1")
    return rows.join(sole.select(group, "_sole"), group, "left").withColumn("inherited", F.when(exact, F.col(label)).otherwise(F.col("_sole"))).drop("_sole")


def latest_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the order given."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
