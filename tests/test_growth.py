"""What the findings of the third round were about: results on larger tables, and work that grows with them."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratingloom.catalog import QUERIES
from ratingloom.operators import admission as N
from ratingloom.operators import aggregates as G
from ratingloom.operators import identity as I
from ratingloom.operators import wording as W
from ratingloom.sources import evidence as E
from ratingloom.sources import markup as M
from ratingloom.sources import tiles as T
from ratingloom.streaming import activity as A


def test_numbers_beside_a_state_are_no_status(spark):
    texts = ["x: parser_changed: 429", "not_found: карточка 498", "HTTP 429", "a: parser_changed, HTTP 498", "temporary 429", "shop 1429"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    said = [r[0] for r in rows.orderBy("i").select(W.issue_text(F.col("t"))).collect()]
    blocked, parser = W.ISSUES["blocked"], W.ISSUES["parser"]
    assert said == [f"x: {parser}", "карточка 498", blocked, f"a: {blocked}", blocked, "shop 1429"]


def test_cards_that_read_alike_are_decided_once(spark, monkeypatch):
    seen, real = [], I.decided
    monkeypatch.setattr(I, "decided", lambda kinds, *rest: (seen.append(kinds.count()), real(kinds, *rest))[1])
    rows = spark.range(600).select("id", F.lit("Зорлан").alias("brand"), F.concat(F.lit("Зорлан таблетки №"), F.col("id") % 3 + 10).alias("title"), F.col("id").cast("string").alias("product_id"))
    labels = {(r.label, r.n) for r in I.identify(rows, "brand", "title").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert labels == {(f"таблетки №{n}", 200) for n in (10, 11, 12)} and seen == [3]
    said = I.override(rows, "brand", "title").groupBy("granularity").agg(F.count("*").alias("n")).collect()
    assert [(r.granularity, r.n) for r in said] == [("variant", 600)] and seen == [3, 3]


@pytest.mark.parametrize("name", ["pi16_title_proves_variant", "ex13_card_titles"])
def test_small_tables_are_many_tasks(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_tiles_stay_with_their_page(spark):
    tile = lambda p, n: f'<div><a href="/product/p-{p}/?x"><img></a><a href="/product/p-{p}/">Товар {p}</a><p><span>4,5</span><b>{n} отзывов</b></p></div>'
    html = f'<nav><a href="/product/p-9/">9</a></nav><div id="grid">{tile(1, 3)}{tile(2, "1 200")}<section>{tile(3, 5)}<a href="/product/p-3/">Самый длинный текст</a></section></div>'
    found = T.tiles(M.with_tree(spark.createDataFrame([(1, html), (2, None), (3, "<p>")], "page_id int, html string")), r"/product/p-(\d+)/", within="#grid")
    assert [(r.listing_id, r.title, r.reviews, r.rating, r.problem) for r in found.orderBy("place").collect()] == [("1", "Товар 1", 3, 4.5, None), ("2", "Товар 2", 1200, 4.5, None), ("3", "Самый длинный текст", 5, 4.5, None)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fmt05_configured_selectors", "fmt07_attribute_pairs", "src10_market_pages"])
def test_pages_of_small_tables_are_many_tasks(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


class Handle:
    """Counts what a processor asks of its store."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def getMapState(self, name, key, value):  # noqa: N802
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)

    def listTimers(self):  # noqa: N802
        return iter(sorted(self.timers))

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return False

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1


def test_a_batch_asks_for_a_runs_state_once(spark):
    handle, pairing = Handle(), A.Pairing(65)
    pairing.init(handle)
    marks = [(i, kind, i * 1_000_000 + shift) for i in range(500) for kind, shift in ((A.START, 0), (A.FINISH, 5))]
    list(pairing.handleInputRows((1,), iter([pd.DataFrame(marks, columns=["activity", "kind", "micros"])]), None))
    assert handle.calls <= 10 and handle.timers == {1}
    assert [r[:4] for r in pairing.settled(1, 2_000)] == [(1, 0, 0, 5), (1, 1, 1_000_000, 1_000_005)] and len(handle.value[0]) == 498


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_duplicates_are_not_multiplied_to_be_compared(spark):
    rows = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, 5, "x"), ("b", 1, 4, "y"), ("b", 2, 5, "y"), ("c", 1, None, None)], "k string, o int, m int, t string")
    out = G.reconcile(rows, ["k"], ["m", "t"], "o")
    assert "Expand" not in plan(out)
    assert {(r.k, r.m, r.t, r.conflict) for r in out.collect()} == {("a", 5, "x", False), ("b", 4, "y", True), ("c", None, None, False)}


def test_budgets_call_python_for_frames_not_for_blocks(spark):
    calls = spark.range(400).select("id", (F.col("id") % 7).alias("user"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("reserve").alias("kind"))
    out = N.budgeted(calls, "user", ["ts", "id"], "kind", 5, seconds=60)
    assert "FlatMapGroupsInPandas" not in plan(out)
    assert out.filter("admitted").count() == 35


def test_levels_of_json_ld_stay_in_their_row(spark, sf_dir):
    assert "UnionLoop" not in plan(QUERIES["fmt03_json_ld_evidence"](spark, sf_dir))
    script = '{"@graph":[{"@type":"ProductGroup","name":"Зорлан","hasVariant":[{"name":"А","hasVariant":{"name":"Б"}},[{"name":"В"}],{"offers":{"name":"Г"}}]},{"@type":"Product","name":"Иное"},{"@type":["Thing","Product"],"brand":{"name":"Зорлан"}}]}'
    deep = '{"a":' * 12 + '{"@type":"Product","name":"Зорлан"}' + "}" * 12
    page = "".join(f'<script type="application/ld+json">{s}</script>' for s in (script, "{oops", "7", deep, f'{{"a":{deep}}}'))
    found = E.ld_nodes(M.with_tree(spark.createDataFrame([(1, "Зорлан", page)], "id int, brand string, html string")), "id", "brand")
    group = "$0.@graph[000000]"
    variants = [f"{group}.hasVariant{p}" for p in ("[000000]", "[000000].hasVariant", "[000001][000000]", "[000002]")]
    assert {(r.path, r.in_variant) for r in found.collect()} == {("$0.@graph[000002]", False), ("$3" + ".a" * 12, False), *((p, True) for p in variants)}


def test_telling_takes_few_patterns(spark):
    texts = ["капсулы", "капсул. №10", "5 мг/мл", "раствор для инъекций", "№ 7", "10 шт.", "доз 5", "5 доз", "капсулы 20", "капсулы 20 мг", "12", "", "отзывы", "1 г", "3,5 %", "Кол-во: 3", "порошок в саше", "таблеточный"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    t = F.col("t")
    out = rows.select(I.has_form(t).alias("form"), I.has_measure(t).alias("measure"), I.dosage_form(t).isNotNull().alias("a"), F.coalesce(I.pack_count(t).isNotNull() | (F.size(I.doses(t)) > 0), F.lit(False)).alias("b"))
    assert all((r.form, r.measure) == (r.a, r.b) for r in out.collect())
    assert plan(rows.filter(E.tells(t))).count("RLIKE") <= 12


@pytest.mark.parametrize("name", ["ag17_canonical_duplicates", "ag18_shared_aggregates"])
def test_listings_are_summed_without_sorts(spark, sf_dir, name):
    made = plan(QUERIES[name](spark, sf_dir))
    assert "SortAggregate" not in made and "l_orderkey" not in made


def test_shared_groups_show_one_set_of_metrics(spark):
    rows = [("a", 1, 1, 5, None), ("a", 2, 1, 5, None), ("b", 1, 1, 5, 2), ("b", 2, 1, 5, None), ("c", 1, 1, 5, 2), ("c", 2, 2, 6, 2), ("d", 1, 1, 5, 2), ("e", 1, 1, 5, 2), ("e", 2, 1, 6, 2), (None, 1, 1, 5, 2), (None, 2, 1, 5, 2)]
    out = G.collapse_shared(spark.createDataFrame(rows, "g string, l int, m int, x int, y int"), ["g"], "l", "m", ["x", "y"])
    assert "SortAggregate" not in plan(out) and {(r.g, r.listings) for r in out.collect()} == {("a", 2), ("c", 2)}
