"""Fill-in-the-middle against plain slicing of code points, and on the cases that its docstring defines."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ratingloom.llm import infill

RNG = random.Random(11)
PARTS = ["a", "Z", "<", ">", "P", "<P", "S>", "\n", "é", "ß", "日", "€", "😀", "́", "\0", "0", " ", "<p>"]
TEXTS = [None, "", "x", "é", "日", "😀", "a<P>b", "é<S>", "<M>", "<<P", "plain text alone", "日本語テキスト" * 40, "é" * 5000, "aé" * 3000, "x" * 40000, "ü" + "x" * 30 + "😀日é"]
TEXTS += ["".join(RNG.choice(PARTS) for _ in range(RNG.randrange(60))) for _ in range(300)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7]), (None, "without an id"), (-5, "negative")]


def expected(i, text, seed=1, sentinels=("<P>", "<S>", "<M>")):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in sentinels) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, s, m = sentinels
    if h4 % 100 < 20:
        return n, "spm", a, b - a, s + text[b:] + p + text[:a] + m + text[a:b]
    return n, "psm", a, b - a, p + text[:a] + s + text[b:] + m + text[a:b]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    return frame.select("*", *[F.lit("clash").alias(c) for c in ("row_id", "body", "n", "form", "output", "restored", "h1")]).cache()


def by_row(rows):
    return sorted(map(repr, rows))


def test_against_slicing(docs):
    got = infill.restore(infill.fill_in_middle(docs)).collect()
    assert by_row((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == by_row((i, *expected(i, t), t or "") for i, t in ROWS)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_sentinels_and_rates(docs):
    marks = ("<|pre|>", "[suf]", "{mid}")
    got = infill.restore(infill.fill_in_middle(docs, seed=9, sentinels=marks), marks).collect()
    assert by_row((r.doc_id, r.form, r.output, r.restored) for r in got) == by_row((i, e[1], e[4], t or "") for i, t in ROWS for e in [expected(i, t, 9, marks)])
    assert {r.form for r in infill.fill_in_middle(docs, cut_rate=0).collect()} == {"plain"}
    assert {r.form for r in infill.fill_in_middle(docs, cut_rate=100, suffix_first_rate=100).collect()} == {"plain", "spm"}
    for bad in (("<P>", "<S>", "é"), ("<P>", "<S>", "<P>x"), ("aba", "<S>", "<M>"), ("\n", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(docs, sentinels=bad)


def test_wrong_output_is_an_error(spark):
    rows = spark.createDataFrame([(1, 3, "psm", 1, 1, "<S>a<P>b<M>c")], "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
    with pytest.raises(Exception, match="without its sentinels"):
        infill.restore(rows).collect()


def test_events_are_sparse():
    scan = infill.EventScan()
    at, kind = scan.events("abcéédef日日x<P>".encode())
    assert list(zip(at.tolist(), kind.tolist())) == [(3, 2), (7, 1), (10, 3), (16, 1), (19, infill.SENTINEL)]
    assert len(scan.events(b"x" * 1000)[0]) == 0


def test_empty(docs):
    assert infill.restore(infill.fill_in_middle(docs.limit(0))).collect() == []
