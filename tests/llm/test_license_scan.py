"""Labels and scores of the licence scan against every alignment of every template tried one by one."""

import math
import random
import re

from ratingloom.llm import license_scan as L

RNG = random.Random(8)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(texts):
    """labels and score of each text."""
    files = [words_of(t) for t in texts]
    weight = {w: math.log(1 + len(files) / (sum(w in set(f) for f in files) + 0.5)) for w in L.vocabulary()}
    out = []
    for f in files:
        base = {label for phrase, label in L.BASE_PHRASES.items() for k in range(len(f)) if f[k : k + len(phrase.split())] == phrase.split()}
        best, labels = 0.0, set()
        for label, text, key in L.TEMPLATES:
            t, key = text.split(), key.split()
            at = next(p for p in range(len(t)) if t[p : p + len(key)] == key)
            for start in range(-len(t), len(f)):
                if start + at < 0 or f[start + at : start + at + len(key)] != key:
                    continue
                cover = sum(weight[w] for p, w in enumerate(t) if 0 <= start + p < len(f) and f[start + p] == w) / sum(weight[w] for w in t)
                if cover >= L.LEAST_COVER:
                    labels.add(label)
                    best = max(best, cover)
        out.append((",".join(sorted(base | labels)), 1.0 if base else best))
    return out


def mangled(text):
    """A template with words changed, left out or put in, cut at either end, amid other words."""
    words = text.split()
    for _ in range(RNG.randrange(4)):
        k = RNG.randrange(len(words) + 1)
        words[k : k + RNG.randrange(3)] = RNG.choice([[], ["other"], ["the", "license"]])
    a = RNG.randrange(len(words) + 1) // 2
    filler = [RNG.choice("the of and code terms license this software x y z".split()) for _ in range(RNG.randrange(40))]
    return " ".join(filler[: RNG.randrange(len(filler) + 1)] + words[a:] + filler)


def test_against_all_alignments(spark):
    texts = [mangled(RNG.choice(L.TEMPLATES)[1]) for _ in range(300)] + [None, "", "GNU General Public License, GNU Lesser general public-license", "mit license", "é" * 50]
    texts += [" ".join(text for _, text, _ in L.TEMPLATES) * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan_licenses(rows).collect()}
    want = brute(texts)
    for i, (labels, score) in enumerate(want):
        assert got[i].labels == labels and math.isclose(got[i].score, score, rel_tol=1e-9, abs_tol=1e-12), texts[i]
    assert len({labels for labels, _ in want}) > 10


def test_looked_up_by_the_rarest_word():
    """A key word that all files have is never the one that a template is looked up by."""
    weight = dict.fromkeys(L.vocabulary(), 5.0) | {"mozilla": 0.1}
    assert next(r[1] for r in L.template_rows(weight) if r[0] == "mpl") == "license"
    weight |= {"license": 0.2}
    assert next(r[1] for r in L.template_rows(weight) if r[0] == "mpl") == "public"
