"""Removal of long repeated passages by prefix-free parsing.

A rolling hash picks triggers: every window of `length` bytes names the trigger with the least hash among its first
`REACH` positions (the later one on ties). Consecutive windows with one trigger form a phrase, so every window start
lies in exactly one phrase, phrases overlap by `length` - 1 bytes, and equal windows always hang on equal triggers,
wherever they stand. Distinct phrases are the dictionary; a text is its sequence of phrases.

The order of corpus suffixes is needed only as far as `length` bytes, and only to tell neighbours that agree that far.
So phrases are ordered by fingerprint: first by the core that all windows of a trigger share (what two phrases must have
in common to share any window), then by their whole content. Of this order only runs matter:
  * a core that stands once in the corpus has no repeated window (nearly all of them, gone after one count);
  * a phrase that stands twice is repeated whole, at each of its places;
  * phrases that share a core but differ are the edges of repeated passages. One copy of each is cut into windows, and
    these are counted exactly.
The answer is exact, but for collisions of 64-bit fingerprints.

Defined cases: a null or empty text has no bytes; matches never cross texts, and texts shorter than `length` keep all;
texts are read whole, in overlapping segments if very long; repeated rows are two places, so both lose what they share;
an empty table gives no rows; a null id is kept; cut characters are dropped from the text that stays, not from its bytes;
further columns are carried along by without_repeats() whatever their names, and not read by remove_repeats().

What one text's spans take is bounded by its length: they are gathered for a text that is held whole anyway.

Two lengths are answered in turn: all strings of the greater length that stand twice lie where strings of the smaller
one do, so only such stretches are parsed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts
from .hashing import U64, joined, mix, prefix_hash, span_hash

LENGTH = 400
#: Bytes of a passage that counts as repeated: what over 50 words take at three letters each, in any of the languages.
PASSAGE = 200
REACH = 128
TRIGGER = 12
#: Longer texts are parsed in segments of so many bytes; a segment's edge ends a phrase, which costs no match.
SEGMENT = 4 << 20
#: Ids up to which a set of documents to read again is broadcast; beyond, texts and ids meet by a shuffle.
BROADCAST_IDS = 500_000
#: At most so many keys are ever looked up by broadcast; a key of fewer rows than HOT_ROWS never is.
HOT_KEYS, HOT_ROWS = 10_000, 1_000

LOW = U64(0xFFFFFFFF)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def phrases(texts: list[bytes], length: int, runs: list[list[dict]] | None = None) -> tuple[np.ndarray, ...]:
    """Of every phrase: its text, first and last window start (in the text), core and content fingerprints; of each text's `runs` alone, if given (apart and in order)."""
    bases, pieces, owners = [], [], []
    for i, t in enumerate(texts):
        for a, b in [(0, len(t))] if runs is None else [(r["a"], r["b"]) for r in runs[i]]:
            for at in range(a, max(b - length + 1, a), SEGMENT):
                bases.append(at)
                owners.append(i)
                pieces.append(t[at : min(at + SEGMENT + length - 1, b)])
    if not pieces:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    buf, bounds = joined(pieces)
    prefix = prefix_hash(buf)
    at = np.arange(len(buf) - TRIGGER + 1)
    ranked = (span_hash(prefix, at, at + TRIGGER) & ~LOW) | (LOW - at.astype(U64))
    trigger = (LOW - (sliding_min(ranked, REACH) & LOW)).astype(np.int64)
    counts = np.diff(bounds) - length  # windows of each piece
    owner = np.repeat(np.arange(len(pieces)), counts)
    x = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[:-1][owner]
    of = trigger[x]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(x)) - 1
    lo, hi, mark, own = x[first], x[last], of[first], owner[first]
    core = span_hash(prefix, mark, mark + length + 1 - REACH)
    content = mix(span_hash(prefix, lo, hi + length) + (mark - lo).astype(U64))
    shift = np.array(bases, np.int64)[own] - bounds[:-1][own]
    return np.array(owners, np.int64)[own], lo + shift, hi + shift, core, content


def lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32 if kind == pa.int32() else np.int64)))


def parse(docs: DataFrame, length: int) -> DataFrame:
    """The phrases of every row, or of its `runs` if docs has them."""
    within = "runs" in docs.columns

    def kernel(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        owner, lo, hi, core, content = phrases(texts, length, batch.column("runs").to_pylist() if within else None)
        n = len(texts)
        long_ = pa.int64()
        return {
            "row_id": batch.column("row_id"), "row_key": batch.column("row_key"), "n_bytes": [len(t) for t in texts], "sha": [hashlib.sha256(t).digest() for t in texts],
            "lo": lists(lo, owner, n, pa.int32()), "width": lists(hi - lo, owner, n, pa.int32()), "core": lists(core.view(np.int64), owner, n, long_), "content": lists(content.view(np.int64), owner, n, long_),
        }

    return map_texts(docs, "body", "row_id long,row_key long,n_bytes long,sha binary,lo array<int>,width array<int>,core array<long>,content array<long>", kernel)


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs joined with `wanted` (a row for each row_key); the ids alone are broadcast first if they are few, so that other texts stay where they are."""
    ids = wanted.select("row_key")
    if ids.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), "row_key", "left_semi")
    return docs.join(wanted, "row_key")


def edge_windows(docs: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """Every window of the phrases in `edges` (row_key, lo, hi, alone): its fingerprint and, for phrases that stand alone, its place."""
    wanted = edges.groupBy("row_key").agg(F.collect_list(F.struct("lo", "hi", "alone")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                keys, los, counts, alone, pieces = [], [], [], [], []
                for key, text, spans in zip(part.column("row_key").to_pylist(), part.column("body").cast(pa.large_binary()).to_pylist(), part.column("spans").to_pylist()):
                    for s in spans:
                        keys.append(key)
                        los.append(s["lo"])
                        counts.append(s["hi"] - s["lo"] + 1)
                        alone.append(s["alone"])
                        pieces.append(text[s["lo"] : s["hi"] + length])
                buf, bounds = joined(pieces)
                counts = np.array(counts, np.int64)
                of = np.repeat(np.arange(len(pieces)), counts)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = bounds[:-1][of] + nth
                mark = span_hash(prefix_hash(buf), start, start + length)
                place = pa.array(np.array(keys, np.int64)[of], mask=~np.array(alone, bool)[of])
                yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), place, pa.array((np.array(los, np.int64)[of] + nth).astype(np.int32))], names=["mark", "row_key", "at"])

    return texts_of(docs, wanted).select("row_key", "body", "spans").mapInArrow(run, "mark long, row_key long, at int")


def rows_with(rows: DataFrame, keys: DataFrame, on: list[str], count: str) -> DataFrame:
    """The rows whose key is among `keys` (a written table of distinct keys and how many rows each may meet).

    A key that would meet over 1 / HOT_KEYS of all rows is looked up in a broadcast table, of which there are fewer than
    HOT_KEYS whatever the input; the rest meet by a shuffle, in which no key is hot.
    """
    total = keys.agg(F.sum(count)).first()[0] or 0
    least = max(HOT_ROWS, total // HOT_KEYS)
    keys = keys.select(*on, F.col(count).alias("_meets"))
    hot = F.broadcast(keys.filter(F.col("_meets") > least).select(*on))
    rest = rows.join(hot, on, "left_anti").join(keys.filter(F.col("_meets") <= least).select(*on), on, "left_semi")
    return rows.join(hot, on, "left_semi").union(rest)


def repeated_spans(docs: DataFrame, length: int, scratch: Scratch, within: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts of every row (row_id, row_key, n_bytes, sha), and per row_key the byte spans that repeated windows cover.

    `within` (row_key, runs), if given, must hold all of those spans; only rows and runs in it are parsed then.
    """
    parsed = scratch.keep(parse(docs if within is None else texts_of(docs, within), length), "parsed", "lz4")
    facts = scratch.keep(parsed.select("row_id", "row_key", "n_bytes", "sha"), "facts")
    cores = parsed.select(F.explode("core").alias("core")).groupBy("core").agg(F.count("*").alias("n"))
    again = scratch.keep(cores.filter("n > 1"), "again", "lz4")
    rows = parsed.select("row_key", F.explode(F.arrays_zip("lo", "width", "core", "content")).alias("p")).select("row_key", "p.*")
    places = scratch.keep(rows_with(rows, again, ["core"], "n"), "places", "lz4")
    scratch.drop(parsed, again)

    entries = places.groupBy("core", "content").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "lo", "width")).alias("copy"))
    dictionary = scratch.keep(entries, "dictionary", "lz4")
    whole = rows_with(places, dictionary.filter("n > 1"), ["core", "content"], "n")
    whole = whole.select("row_key", F.col("lo").alias("a"), (F.col("lo") + F.col("width") + length).alias("b"))

    shared = scratch.keep(dictionary.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "shared", "lz4")
    edges = rows_with(dictionary, shared, ["core"], "kinds").select("copy.row_key", "copy.lo", (F.col("copy.lo") + F.col("copy.width")).alias("hi"), (F.col("n") == 1).alias("alone"))
    windows = scratch.keep(edge_windows(docs, edges, length), "windows", "lz4")
    twice = scratch.keep(windows.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1"), "twice", "lz4")
    single = rows_with(windows.filter("row_key is not null"), twice, ["mark"], "n")
    # Windows of one row in a row are one span already.
    single = single.groupBy("row_key").agg(F.array_sort(F.collect_list("at")).alias("at")).select("row_key", F.explode(runs_of("at")).alias("r"))
    single = single.select("row_key", F.col("r.a").alias("a"), (F.col("r.b") + length).alias("b"))
    spans = whole.union(single).groupBy("row_key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    spans = scratch.keep(spans, "spans", "lz4")
    scratch.drop_others(facts, spans)
    return facts, spans


def runs_of(column: str):
    """Runs of consecutive numbers of a sorted array, as (first, last)."""
    at = F.col(column)
    heads = F.filter(at, lambda v, i: (i == 0) | (F.get(at, i - 1) < v - 1))
    tails = F.filter(at, lambda v, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > v + 1))
    return F.transform(F.arrays_zip(heads.alias("a"), tails.alias("b")), lambda z: F.struct(z["a"].alias("a"), z["b"].alias("b")))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def merged_runs(spans: DataFrame, least: int) -> DataFrame:
    """row_key, the number and bytes of the maximal runs that its spans make up, and those runs that have `least` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, flat = batch.num_rows, batch.column("spans").flatten()
            row = np.repeat(np.arange(n), batch.column("spans").value_lengths().to_numpy()) << 32  # rows one after the other on one line
            a, b = (np.asarray(flat.field(c)).astype(np.int64) + row for c in ("a", "b"))
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            first = np.flatnonzero(np.append(True, a[1:] > b[:-1])[: len(a)])
            a, b = a[first], b[np.append(first[1:], len(b)) - 1] if len(first) else b
            owner, size = a >> 32, b - a
            at = np.searchsorted(owner, np.arange(n + 1))
            total = np.append(0, np.cumsum(size))
            held = size >= least
            ends = pa.array(np.append(0, np.cumsum(held))[at].astype(np.int32))
            runs = pa.StructArray.from_arrays([pa.array((v[held] - (owner[held] << 32)).astype(np.int32)) for v in (a, b)], ["a", "b"])
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(np.diff(at)), pa.array(np.diff(total[at])), pa.ListArray.from_arrays(ends, runs)], names=["row_key", "n_passages", "n_passage_bytes", "runs"])

    return spans.select("row_key", "spans").mapInArrow(run, "row_key long, n_passages long, n_passage_bytes long, runs array<struct<a: int, b: int>>")


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """row_key, n_removed, n_spans, sha and text of what stays, for rows that lose bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(4)]
            for text, found in zip(batch.column("body").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist()):
                gone, at, kept = merged(found), 0, []
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                for values, v in zip(out, (sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).digest(), kept.decode("utf-8", "ignore"))):
                    values.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.string())], names=["row_key", "n_removed", "n_spans", "kept_sha", "kept_text"])

    return texts_of(docs, spans).select("row_key", "body", "spans").mapInArrow(run, "row_key long, n_removed long, n_spans long, kept_sha binary, kept_text string")


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    body = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).cast("long").alias("row_id"), F.xxhash64(F.col(id_column), body).alias("row_key"), body.alias("body"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", passage: int | None = None) -> DataFrame:
    """For every row: id, n_bytes, n_removed, n_spans, kept_sha256.

    With `passage` (bytes, at most `length`) also n_passages and n_passage_bytes: the maximal runs of bytes that repeated
    strings of that length cover, and their bytes. They are counted, not removed.
    """
    if min(length, passage or length) < REACH + TRIGGER:
        raise ValueError(f"length must be {REACH + TRIGGER} bytes at least")
    if passage and passage > length:
        raise ValueError("a passage that counts may not be longer than one that is removed")
    scratch = Scratch(docs.sparkSession, "repeats")
    narrow = keyed(docs, id_column, text_column)
    facts, spans = repeated_spans(narrow, passage or length, scratch)
    counts = []
    if passage:
        passages = scratch.keep(merged_runs(spans, length), "passages", "lz4")
        scratch.drop(spans)
        within = passages.filter(F.size("runs") > 0).select("row_key", "runs")
        _, spans = repeated_spans(narrow, length, Scratch(docs.sparkSession, "repeats"), within)
        facts = facts.join(passages.drop("runs"), "row_key", "left")
        counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_passages", "n_passage_bytes")]
    lost = cut(narrow, spans).drop("kept_text").dropDuplicates(["row_key"])
    return facts.join(lost, "row_key", "left").select(
        F.col("row_id").alias(id_column), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.lower(F.hex(F.coalesce("kept_sha", "sha"))).alias("kept_sha256"), *counts,
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with the text that stays; rows that lose nothing are unchanged."""
    scratch = Scratch(docs.sparkSession, "repeats")
    narrow = keyed(docs, id_column, text_column)
    _, spans = repeated_spans(narrow, length, scratch)
    key = F.xxhash64(F.col(id_column), F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    lost = cut(narrow, spans).select("row_key", "kept_text").dropDuplicates(["row_key"])
    whole = docs.select(F.struct("*").alias("row"), key.alias("row_key")).join(lost, "row_key", "left")
    field = lambda c: F.coalesce("kept_text", F.col("row")[c]).alias(c) if c == text_column else F.col("row")[c].alias(c)
    return whole.select(*map(field, docs.columns))
