"""Mixing against the arithmetic of its targets, and on the cases that its docstring defines."""

import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ratingloom.llm import mixing
from ratingloom.llm.common import Scratch

CLASHES = ("row_id", "size", "copies", "target", "chance", "node", "leaf", "share", "whole", "range", "hot")


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Shares by weight with the excess over the cap shared again, step by step."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = Fraction(sum(sizes.values())), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in free}
        out |= {s: Fraction(cap * sizes[s]) for s in above}
        left -= sum(out[s] for s in above)
        free -= above
    return out


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def check(rows, got, cap=3, weights=(1, 2, 3)):
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        n = len((text or "").split())
        sizes[source] += n
        longest[source] = max(longest[source], n)
    want, taken = targets(sizes, weights, cap), defaultdict(int)
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in got) == sorted(-1 if i is None else i for i, _, _ in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
        assert r.taken == r.copies * r.size and 0 <= r.taken <= cap * r.size
        share = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert not r.size or int(share) <= r.copies <= -(-share // 1)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]
    return taken, want


def rows_of(n, sources=7):
    names = [None, "a", "B", "é", "z", "😀", "￮"][:sources]
    return [(i, " ".join("w" * (1 + (i * 7919) % 40 if i % 50 else 900)), names[min(i % 11, len(names) - 1)]) for i in range(n)]


def test_targets_are_met(spark):
    rows = rows_of(3000) + [(5, "repeated row", "a"), (5, "repeated row", "a"), (None, "no id " * 9, "a"), (9001, None, "B"), (9002, "", None), (9003, " \n\t", "none at all")]
    docs = frame(spark, rows)
    old, mixing.LEAF = mixing.LEAF, 64
    try:
        got = mixing.mix_sources(docs).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(docs.repartition(5)).collect()))
        assert sorted(map(repr, got)) != sorted(map(repr, mixing.mix_sources(docs, seed=2).collect()))
    finally:
        mixing.LEAF = old
    check(rows, got)
    taken, want = check(rows, mixing.mix_sources(docs).collect())
    # What is left at the root is a short document, unless a long one's chance is more than all the others' together can trade.
    assert sorted(abs(taken[s] - want[s]) for s in want)[len(want) // 2] <= 40


def test_many_rounds(spark):
    """Leaves of one document and nodes of two make a deep tree of the same sums."""
    old, mixing.LEAF, mixing.FAN = (mixing.LEAF, mixing.FAN), 1, 4
    try:
        rows = rows_of(400, 2)
        check(rows, mixing.mix_sources(frame(spark, rows)).collect())
    finally:
        mixing.LEAF, mixing.FAN = old


def test_hot_sources_without_broadcast(spark):
    rows = rows_of(600)
    old, mixing.BROADCAST_SOURCES, mixing.HOT_SHARE = (mixing.BROADCAST_SOURCES, mixing.HOT_SHARE), 0, 4
    try:
        check(rows, mixing.mix_sources(frame(spark, rows)).collect())
    finally:
        mixing.BROADCAST_SOURCES, mixing.HOT_SHARE = old


def test_nodes_in_parts(spark):
    rows = rows_of(500, 2) + [(None, "same words here", "a")] * 300
    old, mixing.MOST = mixing.MOST, 20
    try:
        check(rows, mixing.mix_sources(frame(spark, rows)).collect())
    finally:
        mixing.MOST = old


def test_bundles():
    """One long document among many short ones is decided, each keeps its expectation, and the sum stays."""
    rng, size = random.Random(2), [4000, 300] + [40] * 400 + [1] * 3
    times = [0] * len(size)
    for _ in range(400):
        got = mixing.round_node(size, [0.3] * len(size), [rng.random() for _ in size])
        assert sum(0 < p < 1 for p in got) <= 1 and 0 < sum(got) and abs(sum(p * s for p, s in zip(got, size)) - 0.3 * sum(size)) < 1e-6
        assert sum(s for p, s in zip(got, size) if 0 < p < 1) <= 40
        times = [t + p for t, p in zip(times, got)]
    assert abs(times[0] - 120) < 30 and abs(times[1] - 120) < 30 and abs(sum(times[2:402]) / 400 - 120) < 8


def test_chances_are_kept(spark):
    """Over many seeds each document is taken as often as its chance says, and each source's sum stays."""
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(40)]
    docs = frame(spark, rows).select("doc_id", "text", "source")
    many = docs.crossJoin(spark.range(300).select(F.col("id").cast("string").alias("world"))).select(F.expr("doc_id + 1000 * cast(world as long)").alias("doc_id"), "text", "source", "world")
    scratch = Scratch(spark, "worlds")
    leaves = many.select((F.col("world").cast("long") * 2 + (F.col("source") == "b").cast("long")).alias("source_rank"), F.col("doc_id").alias("row_id"), F.lit(0).cast("long").alias("leaf"), F.size(F.split(F.trim("text"), " ")).cast("long").alias("size"), F.xxhash64("doc_id").alias("row_hash"), F.lit(0.3).alias("chance"))
    got = mixing.round_chances(leaves, 1, scratch, 1).collect()
    times, sums = defaultdict(int), defaultdict(float)
    for r in got:
        assert r.chance in (0.0, 1.0)
        times[r.row_id % 1000] += r.chance
        sums[r.source_rank] += r.chance * r.size
    assert all(50 < n < 135 for n in times.values())  # 90 expected, at a deviation of 8
    assert all(abs(s - 0.3 * 60) <= 5 for s in sums.values())


def test_general_weights_and_the_mix_itself(spark):
    rows = [(i, "one two three", "ab"[i % 2]) for i in range(30)]
    mix = mixing.mix_sources(frame(spark, rows), weights=(5, 1), cap=1)
    check(rows, mix.collect(), 1, (5, 1))
    mix = mixing.mix_sources(frame(spark, rows), weights=(5, 1))
    made = mixing.repeated(frame(spark, rows).select("doc_id", "text", "source"), mix)
    assert made.count() == mix.agg(F.sum("copies")).first()[0] and set(made.columns) == {"doc_id", "text", "source", "copy"}
    with pytest.raises(ValueError):
        mixing.mix_sources(frame(spark, rows), weights=(0, 1))


def test_empty(spark):
    assert mixing.mix_sources(frame(spark, []).limit(0)).collect() == []
    got = mixing.mix_sources(frame(spark, [(1, None, "a"), (2, "", "b")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
