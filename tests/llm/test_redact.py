"""Redaction against a walk over the spans, and its time for many secrets in one text."""

import random
import time

from pyspark.sql import functions as F

from ratingloom.llm import secret_scan

RNG = random.Random(6)


def walked(text, spans, mark="[secret]"):
    at, out = 0, ""
    for start, _, end in spans:
        if start >= at:
            out += text[at:start] + mark
        at = max(at, end)
    return out + text[at:]


def test_spans_of_all_kinds(spark):
    rows = []
    for i in range(120):
        text = "".join(RNG.choice("abé日😀 ") for _ in range(RNG.randrange(400)))
        spans = sorted({(a, RNG.randrange(3), min(len(text), a + RNG.randrange(1, 9))) for a in (RNG.randrange(len(text)) for _ in range(RNG.choice((0, 1, 5, 200))) if text)})
        rows.append((i, text, [s for s in spans if s[2] > s[0]]))
    frame = spark.createDataFrame(rows, "id long, text string, spans array<struct<start:int,rule:int,end:int>>")
    got = {r.id: r.out for r in frame.select("id", secret_scan.redact(F.col("text"), F.col("spans")).alias("out")).collect()}
    assert all(got[i] == walked(text, spans) for i, text, spans in rows)


def test_many_spans(spark):
    """Four times the secrets take well below sixteen times the time."""
    def took(n):
        text = "é token=abcdefgh " * n
        frame = spark.createDataFrame([(text, [(17 * k + 2, 0, 17 * k + 16) for k in range(n)])], "text string, spans array<struct<start:int,rule:int,end:int>>")
        began = time.perf_counter()
        out = frame.select(secret_scan.redact(F.col("text"), F.col("spans")).alias("out")).first().out
        assert out == "é [secret] " * n
        return time.perf_counter() - began

    took(500)
    assert took(16_000) < 6
