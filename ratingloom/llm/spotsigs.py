"""SpotSigs fingerprints: chains of content words that follow common words.

Every common word (an anchor) spots the next content words after it; anchor and chain hash to one signature, and the
sorted set of a text's signatures is its fingerprint. In a stretch without common words every word is an anchor, and at a
text's end chains are as long as words are left. What has no words to chain is described by character grams: runs of
letters, or of other characters, that are longer than a word (so nothing of a long text is without signatures), and
texts shorter than SHORT as a whole, in a second part of their fingerprint.

Two fingerprints are compared by the Jaccard likeness of their signatures and of their grams, weighed by the longer text's
length: a few chains tell short texts badly apart, so grams decide on the shortest and count for nothing from SHORT on,
where there are none. The weight falls evenly, so no length is a step. Pairs are pruned where their set sizes alone rule
them out; near_pairs() partitions by set size, so that only neighbouring partitions can hold a match, and looks up
each set's rarest signatures in an inverted index.

Defined cases: a null or empty text has an empty fingerprint, and two empty ones are alike (1.0); texts are read whole;
repeated rows keep a row each, neighbours of one another; ties in id are ordered by a hash of the text, then the text; a
single document is its own next one; an empty table gives no rows; a null id comes first; only the two named columns are
read, so further columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KERNEL_BYTES, Scratch, arrow_schema, bound_batches, map_texts
from .hashing import U64, WORD, joined, mix, prefix_hash, span_hash, word_spans

#: Everyday words of English, French, German and Spanish that anchor chains.
ANCHORS = (
    "a an and are as at be by for from has have he in is it its of on or that the this to was were will with "
    "au aux avec ce dans de des du elle en est et il la le les ou par pas pour qui que se sur un une "
    "als auf das dem den der des die ein eine einen er es im in ist mit nicht sich sie und von zu "
    "al como con del el ella en es las lo los mas no para por que se su sus un una y"
).split()
CHAIN = 3
GRAM = 5
#: Texts of fewer code points carry their character grams as well.
SHORT = 400
#: After so many words without an anchor, every word is one until the next.
STRETCH = 8
#: Runs of more bytes, of letters or of anything else, are described by their grams.
LONG_RUN = 16
#: Rows that a range of ids holds on average.
ROWS_PER_RANGE = 20_000
#: Keys sampled for each range to set the bounds, and the most ranges: what the driver holds, whatever the rows.
SAMPLED = 20
MOST_RANGES = 50_000

#: Signatures and grams of one text are told apart by the highest bit of their 32.
IS_GRAM = U64(1 << 31)


def anchor_hashes() -> np.ndarray:
    buf, bounds = joined([w.encode() for w in ANCHORS])
    return np.unique(span_hash(prefix_hash(buf), bounds[:-1], bounds[1:] - 1))


def signature_keys(texts: list[str]) -> np.ndarray:
    """Sorted distinct (text's place << 32 | signature) of all texts; a short text's grams have IS_GRAM set."""
    buf, bounds = joined([t.lower().encode("utf-8") for t in texts])
    prefix = prefix_hash(buf)
    start, end = word_spans(buf, WORD)
    words = span_hash(prefix, start, end)
    is_anchor = np.isin(words, anchor_hashes())
    owner = np.searchsorted(bounds, start, "right") - 1
    place = np.arange(len(words))
    last = np.maximum.accumulate(np.where(is_anchor, place, 0)) if len(words) else place
    last = np.maximum(last, np.searchsorted(start, bounds)[owner])
    content, anchors = np.flatnonzero(~is_anchor), np.flatnonzero(is_anchor | (place - last >= STRETCH))
    follow = np.searchsorted(content, anchors, "right")
    value = mix(words[anchors] + U64(1))
    padded, padded_owner = np.append(words[content], U64(0)), np.append(owner[content], -1)
    for k in range(CHAIN):
        at = np.minimum(follow + k, len(content))
        there = padded_owner[at] == owner[anchors]
        value = mix(value * U64(3) + np.where(there, padded[at] + U64(k), U64(0)))
    chains = (owner[anchors].astype(U64) << U64(32)) | (value >> U64(33))

    # Code points begin at bytes that continue none; a gram is the span of GRAM of them, or all of a shorter run.
    heads = np.flatnonzero((buf & 0xC0) != 0x80)
    gaps = (np.sort(np.concatenate(sides), kind="stable") for sides in ((bounds[:-1], end), (start, bounds[1:] - 1)))
    parts = [chains]
    for a, b in ((start, end), tuple(gaps)):
        long_ = b - a > LONG_RUN
        parts.append(gram_values(prefix, heads, a[long_], b[long_], np.searchsorted(bounds, a[long_], "right") - 1) & ~IS_GRAM)
    # Of texts too short for two grams apart, single characters count as well.
    for below, size in ((SHORT, GRAM), (2 * GRAM, 1)):
        short = np.flatnonzero(np.array([0 < len(t) < below for t in texts], bool))
        if len(short):
            parts.append(gram_values(prefix, heads, bounds[short], bounds[short + 1] - 1, short, size) | IS_GRAM)
    return np.unique(np.concatenate(parts))


def gram_values(prefix: np.ndarray, heads: np.ndarray, a: np.ndarray, b: np.ndarray, of: np.ndarray, most: int = GRAM) -> np.ndarray:
    """(text's place << 32 | gram) of every gram, of `most` code points or all that there are, within the spans [a, b) of texts `of`; `heads` are where code points begin."""
    first, past = np.searchsorted(heads, a), np.searchsorted(heads, b)
    size = np.minimum(most, past - first)
    count = np.maximum(past - first - size + 1, 0) * (size > 0)
    span = np.repeat(np.arange(len(a)), count)
    at = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count) + first[span]
    after = np.append(heads, len(prefix) - 1)
    end = np.minimum(after[np.minimum(at + size[span], len(heads))], b[span])
    return (of[span].astype(U64) << U64(32)) | (span_hash(prefix, heads[at], end) >> U64(32))


def parts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and grams of the keys."""
    gram = (keys & IS_GRAM) != 0
    return keys[~gram], keys[gram]


def fingerprints(keys: np.ndarray, n: int) -> list[str]:
    """Signatures, then grams (which have the highest bit), as sorted 32-bit numbers."""
    at = np.searchsorted(keys, np.arange(n + 1, dtype=U64) << U64(32))
    low = (keys & U64(0xFFFFFFFF)).astype("<u4")
    return [base64.b64encode(low[a:b].tobytes()).decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def set_sizes(keys: np.ndarray, n: int) -> np.ndarray:
    return np.bincount((keys >> U64(32)).astype(np.int64), minlength=n)[:n]


def jaccard(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Likeness of the n sets of `a` to those of `b`; of two empty ones 0."""
    both = np.zeros(n, np.int64)
    if len(a) and len(b):
        at = np.minimum(np.searchsorted(a, b), len(a) - 1)
        both = set_sizes(b[a[at] == b], n)
    union = set_sizes(a, n) + set_sizes(b, n) - both
    return both / np.maximum(union, 1)


def likeness(a: np.ndarray, b: np.ndarray, n: int, longer: np.ndarray) -> np.ndarray:
    """Likeness of the n fingerprints of `a` to those of `b`, whose longer texts have `longer` code points.

    Grams weigh 1 - longer / SHORT, signatures the rest; where neither has signatures grams weigh all.
    """
    (sigs_a, grams_a), (sigs_b, grams_b) = parts_of(a), parts_of(b)
    both_empty = (set_sizes(a, n) == 0) & (set_sizes(b, n) == 0)
    weight = np.maximum(0.0, 1.0 - longer / SHORT)
    weight = np.where((set_sizes(sigs_a, n) == 0) & (set_sizes(sigs_b, n) == 0) & (longer < SHORT), 1.0, weight)
    return np.where(both_empty, 1.0, weight * jaccard(grams_a, grams_b, n) + (1.0 - weight) * jaccard(sigs_a, sigs_b, n))


SCHEMA = "row_id long,n_chars long,edited_sha256 string,fingerprint string,edited_fingerprint string,near_edited double,near_next double"


def compare_run(ids: list, texts: list[str]) -> dict:
    """Results of all texts but the last, which is only their successor."""
    n = len(texts) - 1
    edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, texts[1:])]
    keys, changed = signature_keys(texts), signature_keys(edited)
    own = keys[keys < U64(n) << U64(32)]
    following = keys[keys >= U64(1) << U64(32)] - (U64(1) << U64(32))
    size = np.array([len(t) for t in texts], np.int64)
    return {
        "row_id": ids[:n],
        "n_chars": size[:n],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited],
        "fingerprint": fingerprints(own, n),
        "edited_fingerprint": fingerprints(changed, n),
        "near_edited": likeness(own, changed, n, np.maximum(size[:n], [len(t) for t in edited])),
        "near_next": likeness(own, following, n, np.maximum(size[:n], size[1:])),
    }


def compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs over rows in order; those of a partition end with the first row of the next one."""
    schema, ids, texts, size = arrow_schema(SCHEMA), [], [], 0

    def made() -> pa.RecordBatch:
        columns = compare_run(ids, texts)
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)

    for batch in batches:
        for row_id, text in zip(batch.column("row_id").to_pylist(), batch.column("body").to_pylist()):
            ids.append(row_id)
            texts.append(text)
            size += len(text)
            if size > KERNEL_BYTES and len(texts) > 1:
                yield made()
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if len(texts) > 1:
        yield made()


def fingerprint_with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, with likeness to that form and to the next document.

    Texts are dealt once, by ranges of (id, hash of the text), so that neither rows without an id nor rows that share one
    meet in a task unless their texts agree as well. The first row of each range goes to the range before it as well (of
    the first range, to the last). The driver holds SAMPLED keys and one first key for each range, and there are MOST_RANGES at most.
    """
    body = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    narrow = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(body).alias("tie"), F.col(id_column).cast("long").alias("row_id"), body.alias("body"))
    spark = docs.sparkSession
    bound_batches(spark)
    rows = narrow.count()
    n = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_PER_RANGE + 1))
    sample = narrow.select("key", "tie")
    sample = sample.sample(min(1.0, SAMPLED * n / max(rows, 1)), 7) if rows > SAMPLED * n else sample
    drawn = np.stack([c.to_numpy() for c in sample.toArrow().columns], axis=1).astype(np.int64)
    drawn = drawn[np.lexsort((drawn[:, 1], drawn[:, 0]))]
    bounds = np.unique(drawn[(np.arange(1, n) * len(drawn)) // n], axis=0) if len(drawn) else drawn

    @F.pandas_udf("int")
    def range_of(keys: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(places(bounds, keys.to_numpy(np.int64), ties.to_numpy(np.int64))).astype("int32")

    ranged = narrow.select("*", range_of("key", "tie").alias("range"))
    firsts = ranged.groupBy("range").agg(F.min(F.struct("key", "tie")).alias("first"))
    firsts = sorted((r["range"], r["first"]["key"], r["first"]["tie"]) for r in firsts.collect())
    before = spark.createDataFrame([(r, key, tie, firsts[k - 1][0]) for k, (r, key, tie) in enumerate(firsts)], "range int, first_key long, first_tie long, goes_to int")
    is_first = (F.col("key") == F.col("first_key")) & (F.col("tie") == F.col("first_tie"))
    stays = F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost"))
    targets = F.when(is_first, F.array(stays, F.struct(F.col("goes_to").alias("range"), F.lit(True).alias("ghost")))).otherwise(F.array(stays))
    dealt = ranged.join(F.broadcast(before), "range").select("key", "tie", "row_id", "body", F.explode(targets).alias("t")).select("key", "tie", "row_id", "body", "t.*")
    # Of several first rows that agree, only one may follow the range before.
    in_order = dealt.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "ghost", "key", "tie", "body")
    compared = in_order.select("row_id", "body", "ghost").mapInArrow(lambda batches: compare_neighbours(one_ghost(batches)), SCHEMA)
    return compared.withColumnRenamed("row_id", id_column)


#: Stands before all ids.
NO_ID = -(1 << 63)


def places(bounds: np.ndarray, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """How many of the sorted (key, tie) bounds are at or below each (key, tie)."""
    low, high = (np.searchsorted(bounds[:, 0], keys, side) for side in ("left", "right"))
    at = low.copy()
    for first in np.unique(low[low < high]).tolist():  # bounds that share a key: its rows are told apart by their ties
        mine = (low == first) & (low < high)
        at[mine] = first + np.searchsorted(bounds[first : high[mine][0], 1], ties[mine], "right")
    return at


def one_ghost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows up to the first ghost, which ends them."""
    for batch in batches:
        ghosts = np.flatnonzero(batch.column("ghost").to_numpy(zero_copy_only=False))
        if len(ghosts):
            yield batch.slice(0, int(ghosts[0]) + 1)
            return
        yield batch


def signature_sets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """row_id and its sorted signatures."""

    def kernel(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        keys = signature_keys([t.decode("utf-8") for t in texts])
        at = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=U64) << U64(32)).astype(np.int32)
        return {"row_id": batch.column(0), "sigs": pa.ListArray.from_arrays(pa.array(at), pa.array((keys & U64(0xFFFFFFFF)).astype(np.int64)))}

    narrow = docs.select(F.col(id_column).cast("long").alias("row_id"), F.col(text_column).cast("string").alias("body"))
    return map_texts(narrow, "body", "row_id long,sigs array<long>", kernel)


def near_pairs(docs: DataFrame, threshold: float = 0.75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pairs of different fingerprints with likeness at or over the threshold: id_a < id_b, the smallest ids that have them, and the likeness.

    Copies are one class, named by its smallest id. A set of size s can only match sizes in [threshold s, s / threshold],
    so sizes fall into partitions whose bounds grow by 1 / threshold, and a set looks into its own and the one below.
    Within these it suffices to look up its rarest signatures: with s - ceil(threshold s) + 1 of them, every match shares one.
    """
    scratch = Scratch(docs.sparkSession, "spotsigs")
    classes = scratch.keep(signature_sets(docs, id_column, text_column).filter(F.size("sigs") > 0).groupBy("sigs").agg(F.min("row_id").alias("row_id")), "classes")
    flat = classes.select("row_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    df = flat.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = flat.join(df, "sig").groupBy("row_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("rare"))
    part = F.floor(F.log("n") / math.log(1 / threshold) + F.lit(1e-9)).cast("int")
    index = ranked.select("row_id", "n", part.alias("part"), F.explode(F.slice("rare", 1, F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1)).alias("r")).select("row_id", "n", "part", "r.sig")
    looked = index.select(F.col("row_id").alias("id_b"), F.col("n").alias("n_b"), "sig", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    pairs = index.join(looked, ["sig", "part"]).filter((F.col("row_id") != F.col("id_b")) & ((F.col("n") < F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("row_id") < F.col("id_b")))) & (F.col("n") >= threshold * F.col("n_b")))
    pairs = pairs.select(F.col("row_id").alias("a"), F.col("id_b").alias("b")).distinct()
    sets = classes.select("row_id", "sigs")
    both = pairs.join(sets.select(F.col("row_id").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("row_id").alias("b"), F.col("sigs").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    scored = both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), (shared / (F.size("sa") + F.size("sb") - shared)).alias("likeness"))
    return scored.filter(F.col("likeness") >= threshold)
