"""Mixing sources to target weights: how often each document is taken, by pivotal dependent rounding.

Sources share the words of all documents by weight; none gets more than `cap` times its own, and what it cannot take is
shared again by weight. The targets are cap * size or level * weight, whichever is less, for the one level at which they
add up; a few rounds over the table of sources find it (whole numbers decide, so nothing hangs on the order of adding).

A source's target over its size is the copies that each of its documents has coming. Whole copies are certain; what is
left is a probability, and these are rounded in dependence: two documents trade words (what one gains in probability
times its words the other loses), by chance in one direction or the other, so that both keep their expectation and one
of them becomes 0 or 1. The other goes on to the next pair. So a source's words stay as they are throughout, and the
last one left, which chance alone rounds, is all that a source misses its target by. Pairs go from long to short
documents, so it is a short one.

The pairs form a tree. Documents of a source are dealt by the hash of their values to leaves of about LEAF documents,
and each leaf, largest first, leaves one document open at most; FAN leaves are one node of the next round, until a
source has one. A hot source is more leaves, not a longer one. Draws are hashes of the row's values and the round, so reruns agree, whatever the partitions.

Defined cases: a null or empty text has no words, is taken with none, and has the whole copies of its source; null is a
source of its own, the last; sources without words have the target 0; rows with a null id, and repeated rows, are
documents of their own (equal rows are alike, so it does not matter which of them is taken); an empty table gives an
empty table; further columns can have any names.
"""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3
#: Documents of a leaf, about, and leaves or nodes that one node of the next round has.
LEAF, FAN = 4096, 64
#: A document this many times as long as the next one trades with a bundle.
LONGER = 2
#: Rows of a node in memory.
MOST = 16 * LEAF
#: Sources up to which their table is broadcast to the documents; beyond, hot ones are, and the rest meet by hash.
BROADCAST_SOURCES = 200_000
#: A source is hot with one of so many documents: there are fewer of these than this.
HOT_SHARE = 2_000


def source_sizes(sized: DataFrame) -> DataFrame:
    """source with its documents and words."""
    return sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))


def in_order(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds `source_rank`: the sources by code point from 0, null last.

    Ranges of sources are numbered each by itself, behind the rows of all earlier ranges; how many these are is one
    number for each partition.
    """
    ranged = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("range", F.spark_partition_id())
    ranged = scratch.keep(ranged, "sources")
    before, shift = 0, []
    for n_range, n in sorted(tuple(r) for r in ranged.groupBy("range").count().collect()):
        shift.append((n_range, before))
        before += n
    shifts = sources.sparkSession.createDataFrame(shift, "range int, shift long")
    nth = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("nth", nth).join(F.broadcast(shifts), "range").select("source", "n_docs", "source_size", (F.col("shift") + F.col("nth")).alias("source_rank"))


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds `target`. Give a written table: each round reads it once, and there are as many rounds as there are ever new sources at their cap."""
    if min(weights) <= 0 or cap < 1:
        raise ValueError("weights are positive, and a source may give itself whole at least")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int")).cast("decimal(38,0)")
    most = (F.col("source_size") * cap).cast("decimal(38,0)")
    total, level, known = None, None, -1
    while True:
        # Above its cap at this level: cap * size < level * weight, in whole numbers.
        above = F.lit(False) if level is None else most * F.lit(level.denominator).cast("decimal(38,0)") < weight * F.lit(str(level.numerator)).cast("decimal(38,0)")
        n, at_cap, free, size = sources.agg(F.count_if(above), F.sum(F.when(above, most)), F.sum(F.when(~above, weight)), F.sum("source_size")).first()
        total = int(size or 0)
        if n == known or free is None:
            break
        known, level = n, Fraction(total - int(at_cap or 0), int(free))
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    share = F.lit(float(level.numerator)) * weight.cast("double") / F.lit(float(level.denominator))
    return sources.withColumn("target", F.when(above, most.cast("double")).otherwise(share))


def joined_sources(sized: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Every document with its source's row."""
    sources = sources.withColumnRenamed("source", "of_source")
    same = F.col("source").eqNullSafe(F.col("of_source"))
    if n_sources <= BROADCAST_SOURCES:
        return sized.join(F.broadcast(sources), same).drop("of_source")
    rows = sources.agg(F.sum("n_docs")).first()[0]
    hot = sources.filter(F.col("n_docs") * HOT_SHARE > rows).withColumn("hot", F.lit(True))
    marked = sized.join(F.broadcast(hot), same, "left").drop("of_source")
    cool = marked.filter("hot is null").select(*sized.columns).join(sources.filter(F.col("n_docs") * HOT_SHARE <= rows), same).drop("of_source")
    return marked.filter("hot").drop("hot").unionByName(cool)


def draw(round_: int, seed: int) -> Column:
    """A number in [0, 1) from a row's key and the round."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(round_), "row_hash"), 11).cast("double") / F.lit(float(1 << 53))


def round_node(size: list[int], chance: list[float], drawn: list[float]) -> list[float]:
    """Pivotal rounding of one node's documents, by falling size: all chances become 0 or 1 but one at most.

    The open document trades words with the next one until one of the two is decided. One that is longer by far than the
    next could only be decided by luck, and would stay open to the end: it trades with a bundle of the next ones, as many
    as can take its words or give them, and is decided at once; theirs move a little, in proportion to what each can.
    """
    chance, open_ = list(chance), -1
    for i in range(len(chance)):
        if not 0.0 < chance[i] < 1.0:
            continue
        if open_ >= 0 and size[open_] > LONGER * size[i]:
            p, s = chance[open_], size[open_]
            give, stop, able, needed = 0.0, i, [], max(p, 1.0 - p) * s
            while stop < len(chance) and give < needed:
                v = chance[stop] * (1.0 - chance[stop])
                able.append(v)
                give += v * size[stop]
                stop += 1
            if give >= needed:
                taken = drawn[open_] < p
                step = (p - taken) * s / give
                for j, v in enumerate(able, i):
                    chance[j] = min(1.0, max(0.0, chance[j] + step * v)) if v > 0.0 else chance[j]
                chance[open_], open_ = float(taken), -1
        if open_ < 0:
            open_ = i if 0.0 < chance[i] < 1.0 else -1
            continue
        p, s, q, t = chance[open_], size[open_], chance[i], size[i]
        up, down = min((1.0 - p) * s, q * t), min(p * s, (1.0 - q) * t)  # words that the open one can take of this one, or give it
        if drawn[i] * (up + down) < down:
            chance[open_], chance[i] = 1.0 if up == (1.0 - p) * s else p + up / s, 0.0 if up == q * t else q - up / t
        else:
            chance[open_], chance[i] = 0.0 if down == p * s else p - down / s, 1.0 if down == (1.0 - q) * t else q + down / t
        if not 0.0 < chance[open_] < 1.0:
            open_ = i if 0.0 < chance[i] < 1.0 else -1
    return chance


def pivotal(rows: DataFrame) -> DataFrame:
    """Rounds `chance` within each (source_rank, node); the sum of size * chance stays.

    A node is one stretch of sorted rows. If equal rows make it longer than MOST, it is rounded in parts, and each part's
    open row is the first of the next.
    """
    placed = rows.repartition("source_rank", "node").sortWithinPartitions("source_rank", "node", F.col("size").desc(), "row_hash")

    def run(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            waiting = [b for b in (rest, batch) if b is not None and b.num_rows]
            if not waiting:
                continue
            table = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            rank, node, chance = (table.column(c).to_numpy(zero_copy_only=False) for c in ("source_rank", "node", "chance"))
            first = np.flatnonzero(np.concatenate(([True], (rank[1:] != rank[:-1]) | (node[1:] != node[:-1]))))
            if batch is not None and table.num_rows - first[-1] <= MOST:
                first, stop = first[:-1], int(first[-1])  # the last node may go on
            else:
                stop = table.num_rows
            size, drawn, rounded = table.column("size").to_pylist(), table.column("drawn").to_pylist(), chance.tolist()
            for a, b in itertools.pairwise([*first.tolist(), stop]):
                rounded[a:b] = round_node(size[a:b], rounded[a:b], drawn[a:b])
            at = table.schema.get_field_index("chance")
            table = table.set_column(at, table.schema.field(at), pa.array(rounded, pa.float64()))
            rest = table.slice(stop)
            if batch is not None and stop == table.num_rows:
                open_ = [i for i in range(int(first[-1]), stop) if 0.0 < rounded[i] < 1.0]
                rest = table.take(pa.array(open_, pa.int64()))
                table = table.filter(pa.array(np.isin(np.arange(stop), open_, invert=True)))
            yield table.slice(0, stop)

    return placed.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in placed.dtypes))


def round_chances(rows: DataFrame, n_leaves: int, scratch: Scratch, seed: int) -> DataFrame:
    """`chance` of all rows as 0 or 1. Rows have source_rank, leaf (below n_leaves), size, row_hash and chance.

    A round reads what the round before has left open, one row for each node: FAN times fewer each time.
    """
    idle = ~((F.col("chance") > 0) & (F.col("chance") < 1))
    done = [rows.filter(idle)]
    open_ = rows.filter(~idle)
    round_, nodes = 0, n_leaves
    while True:
        node = F.shiftright("leaf", round_ * (FAN.bit_length() - 1)).alias("node")
        rounded = scratch.keep(pivotal(open_.select("*", node, draw(round_, seed).alias("drawn"))), f"round{round_}").drop("node", "drawn")
        done.append(rounded.filter(idle))
        open_ = rounded.filter(~idle)
        if nodes <= 1:
            break
        round_, nodes = round_ + 1, -(-nodes // FAN)
    done.append(open_.withColumn("chance", (draw(round_ + 1, seed) < F.col("chance")).cast("double")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 1) -> DataFrame:
    """For each document its id, source, size in words, source_size, target (its source's words in the mix), copies, and taken (words)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.col(text_column).cast("string")
    key = F.xxhash64(F.col(id_column).cast("string"), F.col(source_column), text)
    sized = scratch.keep(docs.select(F.col(id_column).cast("long").alias("row_id"), F.col(source_column).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("row_hash")), "sized")
    ranked = scratch.keep(in_order(source_sizes(sized), scratch), "ranked")
    sources = with_targets(ranked, weights, cap)
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    # A power of two, so that a leaf's place in every later round is a shift of it.
    leaves = F.pow(F.lit(2), F.greatest(F.ceil(F.log2(F.col("n_docs") / LEAF)), F.lit(0))).cast("long")
    sources = scratch.keep(sources.select("*", share.alias("share"), leaves.alias("leaves")), "targets")
    n_sources, n_leaves = sources.agg(F.count("*"), F.coalesce(F.max("leaves"), F.lit(1))).first()
    rows = joined_sources(sized, sources, n_sources)
    rows = rows.withColumn("whole", F.floor("share")).withColumn("chance", F.when(F.col("size") > 0, F.col("share") - F.col("whole")).otherwise(0.0))
    rows = rows.select("row_id", "source", "size", "source_size", "target", "whole", "source_rank", F.pmod(F.xxhash64(F.lit(-seed), "row_hash"), "leaves").alias("leaf"), "row_hash", "chance")
    rounded = round_chances(rows, n_leaves, scratch, seed)
    copies = F.col("whole") + F.col("chance").cast("long")
    return rounded.select(F.col("row_id").alias(id_column), F.col("source").alias(source_column), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, mix: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The mix itself: every document as often as it is taken, with `copy` from 0. Ids must be unique; rows without an id are left out."""
    copies = mix.filter("copies > 0").select(F.col(id_column), F.col("copies"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column)).join(copies, id_column)
    return rows.select("row.*", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy"))
