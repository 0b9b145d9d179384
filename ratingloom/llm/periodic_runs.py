"""Periodic runs of words: stretches that repeat a block of q words at least EXPONENT times.

A run is a maximal stretch of consecutive words with smallest period q and max(LEAST, EXPONENT * q) words or more.

Masking comes first. A run of L words and period q agrees with itself q words on over L - q words, so each of its words
lies in a k-gram that the document has again, for every k up to the least of L - q over all runs: k = 5 with the numbers
here. Words outside repeated 5-grams cannot join runs; what survives are short segments in few documents.

Main-Lorentz is applied to these alone: a segment is halved again and again, and at each middle the periods q are those
at which q words beside the middle equal the q words beyond them. (One of the two sides of a run that spans the middle
has two periods.) The longest extensions to both sides then give the run. All middles of one depth, and all their
periods, are compared at once, by two polynomial hashes modulo primes of 31 bits; each found run is compared word by
word in the end.

Every document is worked on alone, so nothing is shuffled. Memory is some hundred bytes for each word of the longest text.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; texts of any length are worked on
whole; rows that repeat give equal rows, one each; ties of the longest run go to the smallest start, then period; null
ids stay null; an empty table gives an empty table; only the two named columns are read, so further columns can have
any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .hashing import NOT_WHITE, joined, mix, prefix_hash, span_hash, word_spans

LEAST, EXPONENT = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "row_id long,starts array<long>,lengths array<long>,periods array<long>,collapsed string"
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 69069069)
#: Pairs of a middle and a period that are compared at once.
BLOCK = 1 << 20


def least_overlap(least: int, exponent: int) -> int:
    """The fewest words over which a run agrees with itself one period on: the k of the masking grams."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


class Spans:
    """Equality of stretches of a sequence of word ids."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.tables = []
        for prime, base in zip(PRIMES, BASES):
            powers = np.ones(self.n + 1, np.int64)
            have = 1
            while have <= self.n:
                more = min(have, self.n + 1 - have)
                powers[have : have + more] = powers[:more] * pow(base, have, prime) % prime
                have += more
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum((ids.astype(np.int64) + 1) % prime * powers[: self.n] % prime, out=sums[1:])
            self.tables.append((prime, powers, sums % prime))

    def equal(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the `length` words from x and from y are the same; x < y."""
        same = np.ones(len(x), bool)
        for prime, powers, sums in self.tables:
            same &= (sums[x + length] - sums[x]) % prime * powers[y - x] % prime == (sums[y + length] - sums[y]) % prime
        return same

    def forward(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words that agree from x and from y on, up to the limit."""
        return self.longest(limit, lambda k, length: self.equal(x[k], y[k], length))

    def backward(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words that agree before x and before y, up to the limit."""
        return self.longest(limit, lambda k, length: self.equal(x[k] - length, y[k] - length, length))

    @staticmethod
    def longest(limit: np.ndarray, agree) -> np.ndarray:
        """Steps double until one fails, then halve: as many as the logarithm of what is found, not of the limit."""
        good, bad, step, every = np.zeros_like(limit), limit + 1, 1, np.arange(len(limit))
        growing = every
        while len(growing):
            growing = growing[good[growing] + step < bad[growing]]
            ok = agree(growing, good[growing] + step)
            bad[growing[~ok]] = good[growing[~ok]] + step
            growing = growing[ok]
            good[growing] += step
            step *= 2
        open_ = every[bad - good > 1]
        while len(open_):
            middle = (good[open_] + bad[open_]) // 2
            ok = agree(open_, middle)
            good[open_[ok]], bad[open_[~ok]] = middle[ok], middle[~ok]
            open_ = open_[bad[open_] - good[open_] > 1]
        return good


def surviving(ids: np.ndarray, first: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the segments of words in repeated k-grams, of `least` words or more. Text i has the words first[i] to first[i + 1]."""
    k = least_overlap(least, exponent)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(ids)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        gram = mix(gram + ids[j : n - k + 1 + j] + np.uint64(j))
    inside = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :])
    key = mix(gram[inside] + owner[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(inside), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = inside[again]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    covered = np.cumsum(edge[:n]) > 0
    step = np.flatnonzero(covered[1:] != covered[:-1]) + 1
    # A segment also ends where its text does.
    borders = np.union1d(np.concatenate(([0], step, [n])), first)
    start, end = borders[:-1], borders[1:]
    keep = (end - start >= least) & covered[np.minimum(start, n - 1)]
    return start[keep], end[keep]


def squares(spans: Spans, low: np.ndarray, high: np.ndarray, exponent: int) -> tuple[np.ndarray, ...]:
    """Part, side, start and period of every square that ends (side 0) or begins (side 1) at the middle of a part [low, high)."""
    middle, most = (low + high) // 2, (high - low) // exponent
    out = []
    ends = np.cumsum(most)
    start = 0
    while start < len(middle):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
        part = np.repeat(np.arange(start, stop), most[start:stop])
        q = np.arange(len(part)) - np.repeat(ends[start:stop] - most[start:stop] - before, most[start:stop]) + 1
        c = middle[part]
        left, right = c - 2 * q >= low[part], c + 2 * q <= high[part]
        for side, (fits, at) in enumerate(((left, c - 2 * q), (right, c))):
            here = np.flatnonzero(fits)
            hit = here[spans.equal(at[here], at[here] + q[here], q[here])]
            out.append((part[hit], np.full(len(hit), side), at[hit], q[hit]))
        start = stop
    return tuple(np.concatenate(columns) for columns in zip(*out))


def main_lorentz(ids: np.ndarray, start: np.ndarray, end: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every run inside the segments [start, end) of a sequence of ids, by start and period."""
    spans, found = Spans(ids), []
    low, high, bound_low, bound_high = start, end, start, end
    while len(low):
        part, side, at, q = squares(spans, low, high, exponent)
        # Of the squares on one side of a middle the one of the smallest period comes first; those of its multiples inside its run are the same run.
        order = np.lexsort((q, side, part))
        part, side, at, q = part[order], side[order], at[order], q[order]
        while len(part):
            lead = np.ones(len(part), bool)
            lead[1:] = (part[1:] != part[:-1]) | (side[1:] != side[:-1])
            p, a, period = part[lead], at[lead], q[lead]
            s = a - spans.backward(a, a + period, a - bound_low[p])
            e = a + period + spans.forward(a, a + period, bound_high[p] - a - period)
            found.append(np.stack((s, e, period))[:, e - s >= np.maximum(least, exponent * period)])
            group = np.cumsum(lead) - 1
            held = (at >= s[group]) & (at + 2 * q <= e[group]) & (q % period[group] == 0)
            part, side, at, q = part[~held], side[~held], at[~held], q[~held]
        middle = (low + high) // 2
        low, high = np.concatenate((low, middle)), np.concatenate((middle, high))
        bound_low, bound_high = np.tile(bound_low, 2), np.tile(bound_high, 2)
        keep = high - low >= least
        low, high, bound_low, bound_high = low[keep], high[keep], bound_low[keep], bound_high[keep]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    s, e, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])  # a run found with a multiple of its period is the same stretch
    s, e, q = s[fresh], e[fresh], q[fresh]
    true = np.array([bool((ids[a : b - p] == ids[a + p : b]).all()) for a, b, p in zip(s.tolist(), e.tolist(), q.tolist())], bool)
    order = np.lexsort((q[true], s[true]))
    return s[true][order], e[true][order], q[true][order]


def runs_of_texts(texts: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> tuple[list[tuple], list[np.ndarray | None]]:
    """For each text its runs (starts, ends, periods), and which of its words lie behind the first period of a run (None: none)."""
    least = max(least, exponent)  # a run has no period of less than a word
    buf, bounds = joined(texts)
    start, end = word_spans(buf, NOT_WHITE)
    first = np.searchsorted(start, bounds)
    ids = span_hash(prefix_hash(buf), start, end)
    low, high = surviving(ids, first, least, exponent)
    # Only the segments go on, one after the other, their words numbered anew.
    size = high - low
    offset = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    place = np.repeat(low - offset[:-1], size) + np.arange(offset[-1])
    small = np.unique(ids[place], return_inverse=True)[1] if len(place) else np.zeros(0, np.int64)
    s, e, q = main_lorentz(small, offset[:-1], offset[1:], least, exponent)
    shift = (low - offset[:-1])[np.searchsorted(offset, s, "right") - 1] if len(s) else s
    s, e = s + shift, e + shift
    cut = np.searchsorted(s, first)
    runs, drops = [], []
    for i in range(len(texts)):
        a, b, p = (x[cut[i] : cut[i + 1]] for x in (s, e, q))
        a, b = a - first[i], b - first[i]
        runs.append((a, b, p))
        if len(a):
            edge = np.zeros(first[i + 1] - first[i] + 1, np.int64)
            np.add.at(edge, a + p, 1)
            np.add.at(edge, b, -1)
            drops.append(np.cumsum(edge[:-1]) > 0)
        else:
            drops.append(None)
    return runs, drops


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """For each document its id, the starts, lengths and periods of its runs (by start, then period), and the collapsed
    text: its words joined by single spaces, without those that a run repeats."""
    if exponent < 4:
        raise ValueError("of runs with fewer than four periods neither side of a middle need have two")

    def kernel(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        runs, drops = runs_of_texts(texts, least, exponent)
        collapsed = []
        for text, drop in zip(texts, drops):
            words = text.split()  # of bytes: at ASCII white space alone
            collapsed.append(b" ".join(words if drop is None else [w for w, gone in zip(words, drop.tolist()) if not gone]))
        return {
            "row_id": batch.column(0), "starts": [a.tolist() for a, _, _ in runs], "lengths": [(b - a).tolist() for a, b, _ in runs], "periods": [p.tolist() for _, _, p in runs],
            "collapsed": pa.array(collapsed, pa.string()),
        }

    narrow = docs.select(F.col(id_column).cast("long").alias("row_id"), F.col(text_column).cast("string").alias("body"))
    return map_texts(narrow, "body", SCHEMA, kernel).withColumnRenamed("row_id", id_column)


def strongest(starts: str, lengths: str, periods: str) -> Column:
    """The run with the greatest length / period, compared in whole numbers; the first of them, by start and period, on ties. Null without runs."""
    runs = F.transform(F.arrays_zip(starts, lengths, periods), lambda r: F.struct(r[starts].alias("start"), r[lengths].alias("length"), r[periods].alias("period")))
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def with_repeated_tail(text: Column, repeated: Column, from_share: Column, divisor: Column) -> Column:
    """Where `repeated`, a text with words whose words from a = from_share % n on repeat the first 1 + (n - a) div divisor of them."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.greatest(F.size(words), F.lit(1))
    a = (from_share % n).cast("int")
    p = (1 + F.floor((n - a) / divisor)).cast("int")
    block = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), 1, n - a)
    made = F.array_join(F.concat(F.slice(words, 1, a), tail), " ")
    return F.when(repeated & (F.size(words) > 0), made).otherwise(text)
