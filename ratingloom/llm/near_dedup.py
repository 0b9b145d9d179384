"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

A document is its set of 5-word shingles. Documents with one set are one class, so copies never meet again. Each class
has a signature of 128 minima; 32 bands of four find candidates: two sets with likeness 0.75 share no band with
probability 5e-6. A candidate's signatures are compared 16 at a time, and it is given up as soon as the posterior
probability of a likeness of 0.75 falls below the chosen miss probability. What survives is verified on full sets.

No bucket's pairs are ever rows. First every member meets the least member of its bucket. Buckets that still hold
several components are dealt into blocks; two blocks meet in a task, by signatures first and with full sets where these
leave pairs open, and the task returns one link at most for any two components. Texts are read again, once, for classes that have a candidate at all.

Defined cases: a null, empty or white-space-only text has no shingles and is linked with nothing; with one to four
words the whole sequence is the one shingle; texts are read whole; repeated rows of one id are one document; rows with a
null id are linked with nothing and stay; an empty table gives no rows; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts
from .components import connected_components
from .hashing import U64, mix, shingle_sets

SHINGLE = 5
THRESHOLD = 75  # in hundredths
HASHES, BAND = 128, 4
BATCH = 16
MISS = 1e-6
#: Members of a bucket in one block; two blocks meet in a task.
BLOCK = 256
#: Ids up to which a set of documents to read again is broadcast; beyond, it is joined by a shuffle.
BROADCAST_IDS = 500_000

with np.errstate(over="ignore"):
    SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=U64))
MULTIPLIERS = (SEEDS[:HASHES] >> U64(32)).astype(np.uint32) | np.uint32(1)
OFFSETS = (SEEDS[HASHES:] >> U64(32)).astype(np.uint32)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima of the hash functions over each set, a row for each; rows of empty sets are zero."""
    out = np.zeros((len(bounds) - 1, HASHES), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        x = (values >> U64(32)).astype(np.uint32)
        starts = bounds[full]
        for i in range(HASHES):
            out[full, i] = np.minimum.reduceat(x * MULTIPLIERS[i] + OFFSETS[i], starts)
    return out


def describe(docs: DataFrame) -> DataFrame:
    """row_id, n (set size), set_key and sig."""

    def kernel(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        values, bounds = shingle_sets(texts, SHINGLE)
        sig = signatures(values, bounds)
        # Sums of two mixes over the set tell sets apart whatever their order.
        sums = [np.concatenate(([U64(0)], np.cumsum(mix(values + U64(s)))))[bounds] for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        keys = np.stack([s[1:] - s[:-1] for s in sums], axis=1)
        return {"row_id": batch.column(0), "n": np.diff(bounds), "set_key": [k.tobytes() for k in keys], "sig": [s.tobytes() for s in sig]}

    return map_texts(docs, "body", "row_id long,n long,set_key binary,sig binary", kernel)


def least_matches() -> dict[int, int]:
    """For each number of signatures compared, the least matches for which the posterior of likeness at the threshold stays above MISS (uniform prior)."""
    s = np.linspace(0, 1, 20_001)[1:-1]
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(log - log.max())
            if p[s >= THRESHOLD / 100].sum() / p.sum() >= MISS:
                out[n] = m
                break
    return out


def verify_by_signature(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, matches of the pairs that no batch of signatures rules out; their sizes must allow the threshold as well."""
    side = lambda c: classes.select(F.col("row_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter(sizes_allow(F.col("n_a"), F.col("n_b")))
    least = least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(f"sig_{c}").to_pylist()), np.uint32).reshape(-1, HASHES) for c in "ab")
            alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
            for n in range(BATCH, HASHES + 1, BATCH):
                matches[alive] += (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(axis=1)
                alive = alive[matches[alive] >= least[n]]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive)), pa.array(matches[alive])], names=["a", "b", "matches"])

    return both.mapInArrow(run, "a long, b long, matches long")


def sizes_allow(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * THRESHOLD


def shingle_tables(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """row_id and full set, as sorted 64-bit hashes, of the documents named."""
    few = ids.count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(ids) if few else ids, "row_id", "left_semi")

    def kernel(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        values, bounds = shingle_sets(texts, SHINGLE)
        return {"row_id": batch.column(0), "shingles": [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]}

    made = map_texts(chosen, "body", "row_id long,shingles binary", kernel)
    return scratch.keep(made if few else made.dropDuplicates(["row_id"]), "sets", "lz4")


def linked(x: bytes, y: bytes) -> bool:
    x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
    if not len(x) or not len(y):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    shared = int((x[at] == y).sum())
    return 100 * shared >= THRESHOLD * (len(x) + len(y) - shared)


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v of the pairs (a, b) whose full sets reach the threshold."""
    side = lambda c: sets.select(F.col("row_id").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([linked(x, y) for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def by_key(rows: DataFrame, keys: list[str], names: list[str], kernel, schema: str) -> DataFrame:
    """Runs `kernel` on the columns `names` of each group of neighbouring rows with the same keys; a group is all that a task holds."""
    out_names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(key: tuple, group: list[tuple]) -> pa.RecordBatch:
            found = kernel(key, *map(list, zip(*group)))
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (zip(*found) if found else [[]] * len(out_names))], names=out_names)

        key, group = None, []
        for batch in batches:
            for k, row in zip(zip(*(batch.column(c).to_pylist() for c in keys)), zip(*(batch.column(c).to_pylist() for c in names))):
                if k != key and group:
                    yield made(key, group)
                    group = []
                key = k
                group.append(row)
        if group:
            yield made(key, group)

    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, *names).mapInArrow(run, schema)


def open_pairs(parts: list, owns: list, sizes: list, sigs: list, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs, across the two blocks or within the one, that sizes and signatures leave open; and their matches."""
    sig = np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, HASHES)
    part, own, size = np.array(parts), np.array(owns), np.array(sizes)
    split = own.min() != own.max()
    left, right = np.nonzero(own[:, None] < own[None, :]) if split else np.triu_indices(len(part), 1)
    fits = (part[left] != part[right]) & (100 * np.minimum(size[left], size[right]) >= THRESHOLD * np.maximum(size[left], size[right]))
    left, right = left[fits], right[fits]
    matches = np.zeros(len(left), np.int64)
    for n in range(BATCH, HASHES + 1, BATCH):
        matches += (sig[left, n - BATCH : n] == sig[right, n - BATCH : n]).sum(axis=1)
        go = matches >= least[n]
        left, right, matches = left[go], right[go], matches[go]
    return left, right, matches


def meet_in_blocks(members: DataFrame, classes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links u, v between components inside buckets; `members` has bucket, x, part_x, and `top` and `all`, the bucket's largest component and its size.

    A bucket's members are dealt into blocks, those of the largest component apart from the others, and two blocks meet
    in one task unless both are of that component. They meet first by signatures alone; what these leave open meets once
    more with its full sets. A task returns one link at most for any two components, so a group of any size adds no more
    rows than it has components.
    """
    in_main = F.col("part_x") == F.col("top.part_x")
    main_blocks = F.ceil(F.col("top.size") / BLOCK).cast("int")
    side_blocks = F.ceil((F.col("all") - F.col("top.size")) / BLOCK).cast("int")
    own = F.when(in_main, F.pmod(F.xxhash64("x"), main_blocks)).otherwise(main_blocks + F.pmod(F.xxhash64("x"), side_blocks)).cast("long")
    others = F.when(in_main, F.sequence(main_blocks, main_blocks + side_blocks - 1)).otherwise(F.sequence(F.lit(0), main_blocks + side_blocks - 1))
    described = members.select("bucket", "x", "part_x", own.alias("own"), others.alias("others")).join(classes.select(F.col("row_id").alias("x"), "n", "sig"), "x")
    dealt = described.select("bucket", "x", "part_x", "own", "n", "sig", F.explode("others").alias("other"))
    dealt = dealt.select("bucket", "x", "part_x", F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"), "own", "n", "sig")
    least, key, names = least_matches(), ["bucket", "i", "j"], ["x", "part_x", "own", "n", "sig"]

    def still_open(key: tuple, ids: list, parts: list, owns: list, sizes: list, sigs: list) -> list[tuple]:
        left, right, _ = open_pairs(parts, owns, sizes, sigs, least)
        return [(*key, ids[k], parts[k], owns[k], sizes[k]) for k in np.unique(np.concatenate((left, right))).tolist()]

    def links_of(key: tuple, ids: list, parts: list, owns: list, sizes: list, sigs: list, shingles: list) -> list[tuple]:
        left, right, matches = open_pairs(parts, owns, sizes, sigs, least)
        order = np.argsort(-matches, kind="stable")
        root = {p: p for p in parts}

        def top(p: int) -> int:
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        out = []
        for a, b in zip(left[order].tolist(), right[order].tolist()):
            x, y = top(parts[a]), top(parts[b])
            if x != y and linked(shingles[a], shingles[b]):
                root[x] = y
                out.append((ids[a], ids[b]))
        return out

    asked = scratch.keep(by_key(dealt, key, names, still_open, "bucket long, i long, j long, x long, part_x long, own long, n long"), "open", "lz4")
    traits = classes.select(F.col("row_id").alias("x"), "sig").join(sets.select(F.col("row_id").alias("x"), "shingles"), "x")
    return by_key(asked.join(traits, "x"), key, [*names, "shingles"], links_of, "u long, v long").distinct()


def find_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For every row: id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "minhash")
    narrow = docs.select(F.col(id_column).cast("long").alias("row_id"), F.col(text_column).cast("string").alias("body"))
    described = scratch.keep(describe(narrow), "described")

    # Classes of one set each, named by their smallest id.
    real = described.filter("n > 0 and row_id is not null")
    best = real.groupBy("set_key").agg(F.min(F.struct("row_id", "n", "sig")).alias("r"))
    classes = scratch.keep(best.select("set_key", "r.*"), "classes")

    # Buckets with two members or more.
    bands = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(sig, {4 * BAND * i + 1}, {4 * BAND})")) for i in range(HASHES // BAND)])
    flat = classes.select("row_id", F.explode(bands).alias("bucket"))
    shared = flat.groupBy("bucket").agg(F.count("*").alias("members"), F.min("row_id").alias("leader")).filter("members > 1")
    buckets = scratch.keep(flat.join(shared.select("bucket", "leader"), "bucket"), "buckets")

    # Every member meets the least of its bucket.
    stars = buckets.filter("row_id <> leader").select(F.col("leader").alias("a"), F.col("row_id").alias("b")).distinct()
    likely = scratch.keep(verify_by_signature(stars, classes), "likely")
    sets = shingle_tables(narrow, buckets.select("row_id").distinct(), scratch)
    first = likely.groupBy("b").agg(F.max(F.struct("matches", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    links = scratch.keep(confirm(first, sets), "links")
    parts = scratch.keep(connected_components(links, scratch), "parts")

    # Star pairs that did not come first, where their ends are still apart.
    apart = with_part(with_part(likely, parts, "a"), parts, "b").filter("part_a <> part_b").select("a", "b").join(first, ["a", "b"], "left_anti")
    links = scratch.keep(links.union(confirm(apart, sets)), "links")
    parts = scratch.keep(connected_components(links, scratch), "parts")

    # Buckets whose members, leader aside, are still in several components: what these have in common was never compared.
    placed = with_part(buckets.select("bucket", "leader", F.col("row_id").alias("x")), parts, "x")
    followers = placed.filter("x <> leader").groupBy("bucket", "part_x").agg(F.count("*").alias("size"))
    mixed = followers.groupBy("bucket").agg(F.max(F.struct("size", "part_x")).alias("top"), F.sum("size").alias("all")).filter("all > top.size")
    late = scratch.keep(meet_in_blocks(placed.filter("x <> leader").join(mixed, "bucket"), classes, sets, scratch), "late")
    if late.isEmpty():
        final = parts
    else:
        final = scratch.keep(connected_components(links.union(late), scratch), "parts")

    named = classes.select("set_key", F.col("row_id").alias("x"))
    named = with_part(named, final, "x").select("set_key", "part_x")
    out = described.select("row_id", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key")).join(named, "set_key", "left")
    component = F.when(F.col("row_id").isNotNull(), F.coalesce("part_x", "row_id"))
    groups = out.select(F.col("row_id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("row_id").isNull() | (F.col("row_id") == component)).alias("kept"))
    groups = scratch.keep(groups, "groups")
    scratch.drop_others(groups)
    return groups


def with_part(rows: DataFrame, parts: DataFrame, column: str) -> DataFrame:
    """Adds part_<column>: the component of that id, the id itself where it has no link."""
    named = parts.select(F.col("id").alias(column), F.col("component").alias(f"part_{column}"))
    return rows.join(named, column, "left").withColumn(f"part_{column}", F.coalesce(f"part_{column}", column))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group, the document with the smallest id, and rows without an id; each text of a document once.

    Rows that share id and text are one, and so are rows without an id that share their text; one without an id goes where
    a document that stays has its text. Of rows that differ in other columns only, the one with the least JSON stays.
    Columns may have any names and types.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    gone = find_groups(docs, id_column, text_column).filter(~F.col("kept")).select(id_column).distinct()
    stays = lambda rows: rows.join(gone, id_column, "left_anti").select(*[F.col(f"`{c}`") for c in rows.columns])
    scratch = Scratch(docs.sparkSession, "copies")
    digest = F.xxhash64(F.col(text_column))
    digests = stays(docs.select(id_column, digest.alias("_digest"))).groupBy("_digest").agg(F.count("*").alias("_rows"))
    repeated = scratch.keep(digests.filter("_rows > 1").select("_digest"), "repeated")

    # Only rows whose digest repeats are shuffled; texts themselves are compared.
    alike = stays(docs.join(repeated, digest == repeated["_digest"], "left_semi"))
    alike = alike.groupBy(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).agg(F.min_by(whole, F.to_json(whole)).alias("_row"))
    alike = scratch.keep(alike, "alike")
    named = alike.filter("_id is not null")
    nameless = alike.filter("_id is null").join(named.select(F.col("_text").alias("_known")), F.col("_text").eqNullSafe(F.col("_known")), "left_anti")
    others = stays(docs.join(repeated, digest == repeated["_digest"], "left_anti"))
    return others.union(named.select("_row.*")).union(nameless.select("_row.*"))
