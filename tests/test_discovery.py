"""Frontiers, tiles, profiles, robots files, requests, wordings and activity pairs on small cases of their own."""

import pytest
from pyspark.sql import functions as F

from ratingloom.functions import declension as D
from ratingloom.operators import requests as Q
from ratingloom.operators import signals as G
from ratingloom.operators import wording as W
from ratingloom.sources import frontier as R
from ratingloom.sources import markup as M
from ratingloom.sources import profiling as P
from ratingloom.sources import robots, tiles
from ratingloom.streaming import activity as A


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_frontier(spark):
    links = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "gone"), ("x", "x"), ("a", "b")], "url string, next string")
    starts = frame(spark, [("q1", "a"), ("q2", "x"), ("q3", "nowhere"), ("q1", "a")], "search string, url string")
    captured = frame(spark, [("a",), ("b",), ("c",), ("x",), ("a",)], "url string")
    reached = R.follow(starts, links, captured)
    assert sorted((r.search, r.url, r.round, r.captured) for r in reached.collect()) == [("q1", "a", 0, True), ("q1", "b", 1, True), ("q1", "c", 2, True), ("q1", "gone", 2, False), ("q2", "x", 0, True), ("q3", "nowhere", 0, False)]
    products = frame(spark, [("a", 1), ("b", 1), ("c", 2), ("elsewhere", 9)], "url string, product int")
    got = {r.search: (r.pages, r.depth, r.exhausted, r.products) for r in R.discovered(reached, products).collect()}
    assert got == {"q1": (4, 2, False, 2), "q2": (1, 0, True, 0), "q3": (1, 0, False, 0)}
    with pytest.raises(ValueError, match="over 3 pages"):
        R.follow(starts, links, captured, pages=3)
    with pytest.raises(Exception, match="over 1 products"):
        R.discovered(reached, products, limit=1).collect()


GRID = '<div id="g"><div class="t"><a href="/product/a-1/"><img></a><a href="/product/a-1/?r">Long title</a><a href="/product/a-1/">x</a><span>4,5</span><span>1 024 отзыва</span></div><div><a href="/product/b-2/"></a><i>3</i></div><div><p><a href="/product/c-3/">C</a></p><b>4</b><b>5</b></div><section><a href="/product/d-4/">D</a><em>(12 тыс. оценок)</em></section></div>'


def test_tiles(spark):
    pages = M.with_tree(frame(spark, [(1, GRID), (2, None), (3, '<div id="g"><a href="/product/z-9/">Only</a></div><a href="/product/z-8/">out</a>')], "page_id long, html string"))
    got = {(r.page_id, r.listing_id): (r.title, r.reviews, r.rating, r.problem) for r in tiles.tiles(pages, r"/product/[a-z]-(\d+)/", within="#g").collect()}
    assert got == {(1, "1"): ("Long title", 1024, 4.5, None), (1, "2"): (None, None, None, "no title"), (1, "3"): ("C", None, None, "several ratings"), (1, "4"): ("D", 12000, None, None), (3, "9"): ("Only", None, None, None)}


def test_profiles(spark):
    page = '<form action="/s"><input type="search" name="w"></form><form method="POST"><input name="q"></form><div data-product-id="1"><a href="/p/1">Зорлан</a></div><a rel="next" href="/2">2</a>'
    rows = [(1, "https://a.example/x", "Зорлан", page), (2, "https://a.example/y", "Зорлан", "<h1>Зорлан</h1>feedback"), (3, "https://b.example/", None, None)]
    got = {r.domain: r for r in P.profile_sites(M.with_tree(frame(spark, rows, "page_id long, url string, brand string, html string"))).collect()}
    a, b = got["a.example"], got["b.example"]
    assert (a.search_template, a.product_links, a.next_page, a.link_shape, a.meaning, a.n_pages) == ("https://a.example/s?w={query}", "[data-product-id] a[href]", "a[rel='next']", "/p/{n}", "feedback", 2)
    assert (b.search_template, b.product_links, b.meaning, b.examples) == (None, None, "unknown", None)
    assert [r.template for r in P.candidate_templates(frame(spark, [("b.example",)], "domain string")).orderBy("place").collect()][0] == "https://b.example/?s={query}"


@pytest.mark.parametrize("path, ok", [("/", True), ("/a", False), ("/a/b", True), ("/a/b.php", False), ("/x.php", False), ("/x.php?q", True), ("/q?s=1", False), ("/dot+", False), ("/dott", True)])
def test_robots(spark, path, ok):
    text = "Disallow: /lost\nUser-agent: *\r\nDisallow: /a # no\nAllow: /a/b\nDisallow: /*.php$\nDisallow: /*?s=\nDisallow: /dot+\nno line\nDisallow:\n"
    rules = robots.for_agent(robots.rules_of(F.lit(text)), "bot")
    assert spark.range(1).select(robots.allowed(rules, F.lit(path))).first()[0] is ok


def test_robots_of_nothing(spark):
    row = spark.range(1).select(robots.allowed(robots.for_agent(robots.rules_of(F.lit("")), "b"), F.lit("/")), robots.crawl_delay(robots.rules_of(F.lit("x"))), robots.rules_of(F.lit(None).cast("string"))).first()
    assert row[0] is True and row[1] is None and row[2] == []


def test_requests(spark):
    bodies = [None, "", "oops", "{}", '{"sitemaps":[],"brands":[]}', '{"sitemaps":"x","brands":{}}', '{"sitemaps":["https://reviews.yandex.ru/ugcpub/sitemap_model_1-2-3.xml"],"brands":[{"brand":"Бренд","tokens":["бренд","brand 2"]}]}']
    got = [r.p for r in frame(spark, list(enumerate(bodies)), "i int, b string").orderBy("i").select(Q.batch_problem(F.col("b")).alias("p")).collect()]
    assert got == ["no object", "no object", "no object", "no object", "sitemaps", "sitemaps", None]
    assert [r[0] for r in frame(spark, [(None,), ("{}",)], "b string").select(Q.read_back_problem(F.col("b"))).collect()] == ["size", "size"]
    sites = frame(spark, [(1, None), (2, " , ;"), (3, "a.example,www.A.example OZON.ru")], "i int, t string")
    assert {r.i: r.custom for r in Q.custom_sites(sites, "i", "t").collect()} == {1: 0, 2: 0, 3: 1}


def test_wordings_of_nothing(spark):
    row = spark.range(1).select(W.issue_text(F.lit(None).cast("string")), W.issue_text(F.lit("blocked")), W.error_text(F.lit(None).cast("string"), F.lit("load")), W.error_text(F.lit("x" * 500), F.lit("start")), W.written_out(F.lit(None).cast("string"))).first()
    assert tuple(row) == (W.UNFINISHED, W.ISSUES["blocked"], W.ACTIONS["load"], W.ACTIONS["start"], None)


def test_signals_never_guess(spark):
    rows = frame(spark, [(1, "ozon.ru"), (2, '{"a":{"b":{"c":"json-ld via gateway"}}}'), (3, None), (4, '["direct","browser"]')], "i int, b string")
    got = {r.i: (r.channels, r.parsers) for r in G.runtime_signals(rows, "i", "b").collect()}
    assert got == {1: ([], []), 2: (["gateway"], ["json_ld"]), 3: ([], []), 4: (["browser"], [])}


def test_declension():
    assert {"таблетка", "таблеток", "таблетками"} <= set(D.forms("таблет:f ка")) and {"гель", "гелей"} <= set(D.forms("гел:m ь")) and D.forms("саше") == ["саше"]
    assert "шипучего" in D.forms("шипуч:щий") and "рекомендуется" in D.forms("рекоменд:овать")
    with pytest.raises(ValueError):
        D.forms("x:y")


@pytest.mark.parametrize("pace", [1, 7, 100])
def test_activity_pairs_at_any_pace(spark, tmp_path, pace):
    """Rows in files of any size and order: a finish before its start, an end of a run, a silence."""
    base = 1_780_000_000
    rows = [(1, 10, "start", 0), (1, 10, "finish", 60), (1, 11, "start", 100), (1, None, "end", 200), (1, 11, "finish", 300), (1, 12, "start", 400), (2, 20, "start", 0), (2, 21, "finish", 50), (2, 21, "start", 40), (3, 30, "start", 90_000)]
    for k in range(0, len(rows), pace):
        part = [(r, a, kind, base + at) for r, a, kind, at in reversed(rows[k : k + pace])]
        frame(spark, part, "run long, activity long, kind string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = A.use_rocks(spark)
    try:
        source = spark.readStream.schema("run long, activity long, kind string, at timestamp").option("maxFilesPerTrigger", 50).parquet(f"{tmp_path}/in")
        out = []
        q = A.activity_pairs(source).writeStream.foreachBatch(lambda b, n: out.extend(b.collect())).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(A.PROVIDER)
        else:
            spark.conf.set(A.PROVIDER, before)
    got = sorted((r.run, r.activity, r.finished // 1_000_000 - base, r.status) for r in out)
    assert got == [(1, 10, 60, "complete"), (1, 11, 200, "interrupted"), (1, 12, 4300, "stalled"), (2, 20, 3900, "stalled"), (2, 21, 50, "complete")]
