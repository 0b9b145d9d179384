"""Trees, selectors and page evidence on small pages, against what the markup says."""

import pytest
from pyspark.sql import functions as F

from ratingloom.functions.json_walk import walk
from ratingloom.sources import evidence as E
from ratingloom.sources import markup as M

PAGE = """<!doctype html><html lang=ru><head><title>T &amp; t</title><script>var t = "</p>";</script><style>p{}</style></head>
<body class="x  y"><div id=main class='card big'><p>One<p>Two <b>bold</b> <i>end</i></div><ul><li class=k>1<li data-x="Foo bar">2<ul><li>inner</ul></ul>
<table><tr><td>a<td>b<tr><td>c</table><div class="also related-items"><span class=r>4.5</span></div><span class=q content="7">8</span><br><select><option>o1<option selected>o2</select></b></div>"""
CASES = {
    "p": ["One", "Two bold end"], "#main p": ["One", "Two bold end"], "div.card.big > p + p": ["Two bold end"], "ul > li": ["1", "2 inner", "inner"], "li + li": ["2 inner"], "ul ul li": ["inner"],
    "[data-x~='Foo']": ["2 inner"], "[data-x~=Fo]": [], "[data-x^='foo' i], .k": ["1", "2 inner"], "[data-x$=bar]": ["2 inner"], "[class*='elated']": ["4.5"], "tr": ["a b", "c"], "td": ["a", "b", "c"],
    "option[selected]": ["o2"], "option": ["o1", "o2"], "body.y b": ["bold"], "body.z b": [], "title": ["T & t"], "div > span, title, p b": ["T & t", "bold", "4.5"], "html > body > *": ["One Two bold end", "1 2 inner", "a b c", "4.5", "8", None, "o1 o2"], "[class='']": [],
}


@pytest.fixture(scope="module")
def page(spark):
    return M.with_tree(spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<<p></q>&bogus; <p")], "page_id long, html string")).cache()


def test_selectors(page):
    tree = F.col("tree")
    found = page.select("page_id", *[F.transform(M.select(tree, s), lambda n: M.text_of(tree, n)).alias(f"c{i}") for i, s in enumerate(CASES)]).collect()
    assert {s: found[0][f"c{i}"] for i, s in enumerate(CASES)} == CASES
    assert all(found[k][f"c{i}"] == [] for k in (1, 2) for i in range(len(CASES)))


def test_trees_nest(page):
    for r in page.collect():
        for n in r.tree.nodes:
            assert n.id <= n.last < len(r.tree.nodes) and 0 <= n.begin <= n.stop <= len(r.tree.text)
            if n.parent >= 0:
                above = r.tree.nodes[n.parent]
                assert above.id < n.id and n.last <= above.last and above.begin <= n.begin and n.stop <= above.stop


def test_bad_selectors():
    for bad in ("", "a,", "> a", "a >", "a:hover", "[x", "a[=b]", ".k p*"):
        with pytest.raises(ValueError):
            M.parsed_selector(bad)


def test_read_one(page):
    tree = F.col("tree")
    row = page.select(M.read_one(tree, ".q", "content").alias("q"), M.read_one(tree, ".r").alias("r"), M.read_one(tree, "li").alias("li"), M.read_one(tree, "h1").alias("h1"), M.read_one(tree, None).alias("no")).first()
    assert tuple(row.q) == ("7", False) and tuple(row.r) == (None, True) and tuple(row.li) == (None, True) and tuple(row.h1) == (None, False) and tuple(row.no) == (None, False)


def test_evidence_of_odd_pages(spark):
    rows = [(1, "Зорлан", "https://x.example/1", None), (2, None, "https://x.example/2", "<h1>Зорлан</h1>"), (3, "Зорлан", None, '<script type="application/ld+json">[[[]]]</script><meta property="og:title" content=" Зорлан гель ">')]
    rows += [(4, "Зорлан", "https://x.example/4", '<h1>Зорлан отзывы</h1><meta name="description" content="x"><div id="product-description">Зорлан гель 5 мл</div>')]
    pages = M.with_tree(spark.createDataFrame(rows, "page_id long, brand string, url string, html string"))
    got = {r.page_id: r for r in E.page_evidence(pages).collect()}
    assert [got[i].title for i in (1, 2, 3, 4)] == ["", "Зорлан", "Зорлан гель", "Зорлан отзывы"] and got[4].weak == ["x", "Зорлан гель 5 мл"]
    shared = {r.page_id: r for r in E.page_evidence(pages, shared=True).collect()}
    assert shared[4].weak == [] and shared[4].family and not got[4].family


def test_depth_of_json(spark):
    deep = "[" * 30 + "]" * 30
    assert walk(spark.createDataFrame([(1, deep)], "id long, j string"), "id", "j").count() == 30
    with pytest.raises(Exception, match="(?i)recursion"):
        walk(spark.createDataFrame([(1, deep)], "id long, j string"), "id", "j", deepest=10).collect()
