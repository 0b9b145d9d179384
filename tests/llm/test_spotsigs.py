"""The likeness of fingerprints against a second computation, and its steps from one length to the next."""

import base64
import random

import numpy as np
import pytest

from ratingloom.llm import spotsigs as S

RNG = random.Random(5)
WORDS = "the of and und der la el alpha beta gamma delta river stone night cloud paper".split()
PROSE = " ".join(RNG.choice(WORDS) + ("" if RNG.random() < 0.5 else str(RNG.randrange(50))) for _ in range(400))


def sets(fingerprint):
    values = np.frombuffer(base64.b64decode(fingerprint), "<u4")
    return {int(v) for v in values if v < 1 << 31}, {int(v) for v in values if v >= 1 << 31}


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def rows_of(spark, texts):
    got = S.fingerprint_with_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r for _, r in sorted((r.doc_id, r) for r in got)]


@pytest.mark.parametrize("kind", ["prose", "one letter", "wide"])
def test_likeness_from_fingerprints(spark, kind):
    text = {"prose": PROSE, "one letter": "z" * 900, "wide": "日本語テキスト言葉" * 100}[kind]
    texts = [text[:n] for n in (0, 1, 3, 9, 10, 11, 60, 200, 399, 400, 401, 800)] + [None, PROSE[100:300]]
    rows = rows_of(spark, texts)
    for t, u, r, s in zip(texts, texts[1:], rows, rows[1:]):
        (sigs, grams), (next_sigs, next_grams) = sets(r.fingerprint), sets(s.fingerprint)
        longer = max(len(t or ""), len(u or ""))
        w = max(0.0, 1 - longer / S.SHORT) if sigs | next_sigs or longer >= S.SHORT else 1.0
        want = 1.0 if not (sigs | grams | next_sigs | next_grams) else w * share(grams, next_grams) + (1 - w) * share(sigs, next_sigs)
        assert r.near_next == pytest.approx(want)


def test_no_length_is_a_step(spark):
    """A text and its copy without the last quarter: likeness moves by what one word's chains are worth, and no length is a boundary."""
    lengths = range(120, 620)
    texts = [x for n in lengths for x in (PROSE[:n], PROSE[: n - n // 4])]
    near = [r.near_next for r in rows_of(spark, texts)[::2]]
    assert max(abs(a - b) for a, b in zip(near, near[1:])) < 0.2
    at = dict(zip(lengths, near))
    assert abs(at[399] - at[400]) < 0.02
    assert abs(np.mean([at[n] for n in range(370, 400)]) - np.mean([at[n] for n in range(400, 430)])) < 0.06


def test_driver_holds_no_more_ranges(spark, monkeypatch):
    texts = [f"{PROSE[:50]} {i}" for i in range(300)]
    want = [(r.doc_id, r.near_edited, r.near_next) for r in rows_of(spark, texts)]
    monkeypatch.setattr(S, "ROWS_PER_RANGE", 10)
    monkeypatch.setattr(S, "MOST_RANGES", 3)
    assert [(r.doc_id, r.near_edited, r.near_next) for r in rows_of(spark, texts)] == want
