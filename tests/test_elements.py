"""Elements of many pages at once, against the trees of the pages, and the tiles found in them."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_markup import CASES, PAGE

from ratingloom.catalog import QUERIES
from ratingloom.sources import elements as E
from ratingloom.sources import markup as M
from ratingloom.sources import tiles as T

PLAIN = [
    '<!doctype html><div id="g" class="a  b"><!-- c --><p>One &amp; <b>two</b></p><br>x<img src="i"/> y</div><span/>', "<title>T &amp; t</title><script>1</script><p a='\"' b=\"'\">3 \n4</p>", '<DIV A="1" a="2" q><a href="x?a&amp;b">é\U0001f600</a></DIV>',
    '<ul><li class="k">1</li><li>2</li></ul><h1>h</h1><div id="g"><i></i></div>', "no tag > at all", "", None,
]
ODD = [PAGE, "<p>a<p>b", "<ul><li><ul><li>1</li></ul></li></ul>", "<b><i></b></i>", "</p><p></p>", "<div>", 'a < b<p t="x>y">c</p>', "<script>a</b></script>", "<p x=1>u</p>", "<title><b>t</b></title>", "<!-- \"a-b\" --><i>1</i>", '<i t="a>']
NAMES = "id class a b q href src x t".split()


def read(pages):
    """By page: (last, parent, tag, attributes, text) of each element, numbered from the page's first."""
    out = {}
    for elements in E.read(pa.array(pages, pa.string())):
        values, parents, texts, first = {n: elements.values(n) for n in NAMES}, elements.parents(), elements.texts(np.arange(len(elements.page))), np.searchsorted(elements.page, elements.page)
        for e, (page, kind) in enumerate(zip(elements.page.tolist(), elements.kind.tolist(), strict=True)):
            attrs = {n: v[kind] for n, v in values.items() if v[kind] is not None}
            out.setdefault(page, []).append((int(elements.last[e] - first[e]), int(parents[e] - first[e]) if parents[e] >= 0 else -1, elements.tags[kind], attrs, texts[e]))
    return out


def wanted(page):
    tree = M.parsed(page)
    text = "".join(tree.text)
    return [(n[1], n[2], n[3], {k: v for k, v in n[4].items() if k in NAMES}, " ".join(re.split(r"[\s ]+", text[n[5] : n[6]])).strip()) for n in tree.nodes]


def test_elements_are_those_of_the_trees():
    pages = [*PLAIN, *ODD, *PLAIN]
    found = read(pages)
    assert [found.get(i, []) for i in range(len(pages))] == [wanted(p) for p in pages]


def test_plain_pages_are_not_parsed_one_by_one():
    odd = E.read_plain(pa.array([*PLAIN, *ODD], pa.string()))[1]
    assert odd.tolist() == [False] * len(PLAIN) + [True] * len(ODD)


@pytest.mark.parametrize("selector", [*CASES, "#g", "*", ".a.b > p b", "div, [q]", "h1 + div i"])
def test_selectors_find_the_same(spark, selector):
    pages = [*PLAIN, *ODD]
    rows = M.with_tree(spark.createDataFrame(list(enumerate(pages)), "id int, html string")).select("id", F.transform(M.select(F.col("tree"), selector), lambda n: n["id"]).alias("found"))
    found = {i: [] for i in range(len(pages))}
    for elements in E.read(pa.array(pages, pa.string())):
        for e in np.flatnonzero(elements.select(selector)).tolist():
            page = int(elements.page[e])
            found[page].append(e - int(np.searchsorted(elements.page, page)))
    assert found == {r.id: r.found for r in rows.collect()}


def test_tiles_of_markup_are_those_of_trees(spark):
    tile = lambda p, more: f'<div><a href="/product/p-{p}/?x"><img></a><a href="/product/p-{p}/">Товар  {p}</a>{more}</div>'
    grids = [tile(1, "<b>4,5</b><i>1 200 отзывов</i>"), tile(2, "<b>4</b><b>5</b>") + tile(6, "<i>(3 reviews)</i><i>7 оценок</i>"), f"<ul><li>{tile(3, '<i>2 тыс. &#1086;ценок</i>')}<ul><li>{tile(4, '')}</ul></ul>", '<a href="/product/p-5/"></a>', "<p>9"]
    pages = spark.createDataFrame([(i, f'<a href="/product/p-9/">9</a><div id="g">{g}</div>') for i, g in enumerate(grids)] + [(9, None)], "page_id int, html string")
    found, of_trees = (sorted(map(tuple, T.tiles(p, r"/product/p-(\d+)/", within="#g").collect())) for p in (pages, M.with_tree(pages)))
    assert found == of_trees and [(r[0], *r[2:3], *r[4:]) for r in found] == [
        (0, "1", "Товар 1", 1200, 4.5, None), (1, "2", "Товар 2", None, None, "several ratings"), (1, "6", "Товар 6", None, None, "several counters"), (2, "3", "Товар 3", 2000, None, None), (2, "4", "Товар 4", None, None, None), (3, "5", None, None, None, "no title"),
    ]


def test_a_page_of_many_tiles_is_read_whole():
    page = '<div id="g">' + "".join(f'<div><a href="/product/p-{i}/">{i}</a><b>{i % 50 / 10}</b></div>' for i in range(40_000)) + "</div>"
    (elements,) = E.read(pa.array([page]))
    assert len(T.tiles_of(elements, re.compile(r"/product/p-(\d+)/"), "#g")[0]) == 40_000


def test_tiles_are_read_without_trees(spark, sf_dir):
    found = QUERIES["ex12_tiles"](spark, sf_dir)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "tree" not in found._jdf.queryExecution().executedPlan().toString()
