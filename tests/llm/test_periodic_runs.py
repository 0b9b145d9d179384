"""Periodic runs against brute force over every period, and on the cases that the docstring defines."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratingloom.llm import periodic_runs
from ratingloom.llm.queries import op13_periodic_runs

RNG = random.Random(13)


def brute(words, least=6, exponent=4):
    """(start, length, period) of all runs: for each period every maximal stretch, kept under its smallest period."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q) and j > i:
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def made(letters, n, inserts):
    words = [RNG.choice("abcdefghij"[:letters]) for _ in range(n)]
    for _ in range(inserts):
        at = RNG.randrange(len(words) + 1)
        words[at:at] = words[at : at + RNG.randrange(1, 12)] * RNG.randrange(2, 9)
    return " ".join(words)


TEXTS = [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "x a a a a a a y", "a b a b a b a", "a b a b a b a b", "日 本 " * 9, "A a " * 8, "w\x0bw\x0cw\rw\nw\tw w", "a\xa0b " * 7, ("one two three " * 40 + "end ") * 6, "z " * 5000]
TEXTS += [made(RNG.randrange(1, 8), RNG.randrange(80), RNG.randrange(4)) for _ in range(150)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(13, TEXTS[13]), (None, "n n n n n n n")]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    return frame.select("*", *[F.lit("clash").alias(c) for c in ("row_id", "body", "starts", "collapsed")]).cache()


def test_against_brute_force(docs):
    got = periodic_runs.find_runs(docs).collect()
    want = sorted(repr((i, runs, collapse(words_of(t), runs))) for i, t in ROWS for runs in [brute(words_of(t))])
    assert sorted(repr((r.doc_id, list(zip(r.starts, r.lengths, r.periods)), r.collapsed)) for r in got) == want
    assert sum(len(r.starts) for r in got) > 100


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=4), st.integers(4, 6), st.integers(2, 12))
def test_runs_of_any_texts(texts, exponent, least):
    runs, drops = periodic_runs.runs_of_texts([" ".join(t).encode() for t in texts], least, exponent)
    for words, (start, end, period), drop in zip(texts, runs, drops):
        want = brute(words, least, exponent)
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == want
        assert (drop is None) == (not want)


def test_masking_loses_no_run():
    """Each word of a run lies in a k-gram that its text has again."""
    assert periodic_runs.least_overlap(6, 4) == 5
    for _ in range(300):
        words = made(3, 40, 2).split()
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        for s, n, _ in brute(words):
            assert set(range(s, s + n)) <= covered


def test_repetitive_letters():
    """Thue-Morse words have no run, Fibonacci words none of four periods; neither fools the comparison of stretches."""
    morse = " ".join("ab"[bin(i).count("1") % 2] for i in range(1 << 14))
    a, b = "a", "ab"
    while len(b) < 20000:
        a, b = b, b + a
    runs, _ = periodic_runs.runs_of_texts([morse.encode(), " ".join(b).encode(), b"a b " * 30000])
    assert [len(r[0]) for r in runs] == [0, 0, 1]


def test_query(spark, tmp_path):
    """The whole query, with the repeated tails that it makes, against brute force."""
    rows = [(i, t) for i, t in ROWS] + [(i, made(9, 50, 1)) for i in range(1000, 1150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for i, text in rows:
        words = words_of(text)
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(collapse(words, runs))))
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got))) == sorted(map(repr, want))
    assert sum(r.n_runs for r in got if r.doc_id and r.doc_id >= 1000) > 10


def test_empty_and_wrong(docs):
    assert periodic_runs.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, exponent=3)
