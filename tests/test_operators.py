"""Operators on small tables: defined cases that the registered queries do not show."""

import pytest
from pyspark.sql import functions as F

from ratingloom.functions import dates, numbers, text, urls
from ratingloom.operators import aggregates, checks, identity, joins, projections, quality, report
from ratingloom.sources import datasets, payloads, sinks
from ratingloom.sources.connectors import STANDARD
from ratingloom.streaming import events as streams


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_normal_form_and_names(spark):
    assert one(spark, text.normalize_text(F.col("t")), t="Ёж—  «Ｆｏｒｔｅ» №5") == "еж forte no5"
    assert one(spark, text.normalize_text(F.col("t")), t=None) is None
    assert one(spark, projections.names_exactly(F.col("t"), "Хилак форте"), t="(хилак-форте) капли")
    assert not one(spark, projections.names_exactly(F.col("t"), "Хилак"), t="хилакс")


@pytest.mark.parametrize("value, scale, wanted", [(9.87, 10.0, "4.94"), (12.0, 10.0, "5.00"), (-1.0, 5.0, "0.00"), (4.0, 0.0, "None"), (3.0, 5.0, "3.00")])
def test_rating_scale(spark, value, scale, wanted):
    assert str(one(spark, numbers.rating_to_five(F.col("v"), F.col("s")), v=value, s=scale)) == wanted


def test_month_labels(spark):
    assert one(spark, dates.month_of_label(F.col("t"), 2025), t=" июль ") == "2025-07"
    assert one(spark, dates.month_of_label(F.col("t"), 2025), t="Июль 2026") == "2026-07"
    assert one(spark, dates.month_of_label(F.col("t"), 2025), t="итого") is None


def test_urls(spark):
    assert one(spark, urls.canonical_url(F.col("t")), t="https://a.example/p?utm_source=x&id=1&ref=2#top") == "https://a.example/p?id=1"
    assert one(spark, urls.column_letters(F.lit(703 - 1)), t="") == "ZZ"


def feedback(spark, reviews, ratings, rating, status):
    rows = spark.createDataFrame([(reviews, ratings, rating, status, None, False)], "reviews long, rating_count long, rating double, status string, written_review_count long, has_written_review_count boolean")
    return projections.unify_feedback(rows).first()


def test_feedback_is_the_larger_counter(spark):
    r = feedback(spark, 5, 91, 4.8, "ok")
    assert (r.reviews, r.written_review_count, r.status) == (91, 5, "ok")
    r = feedback(spark, 0, 3, None, "no_reviews")
    assert (r.reviews, r.status) == (3, "ok")
    r = feedback(spark, 0, None, 4.0, "ok")
    assert (r.reviews, r.rating, r.status, r.has_written_review_count) == (0, None, "no_reviews", False)
    r = feedback(spark, 7, 9, 1.0, "blocked")
    assert (r.reviews, r.rating, r.status) == (7, 1.0, "blocked")


def test_guards_fail_instead_of_cutting(spark):
    rows = spark.range(5)
    assert checks.assert_bounded(rows, 5, "many").count() == 5
    with pytest.raises(Exception, match="many"):
        checks.assert_bounded(rows, 4, "many").collect()
    with pytest.raises(Exception, match="twice"):
        checks.assert_unique(rows.union(rows), ["id"], "twice").collect()
    with pytest.raises(Exception, match="differ"):
        aggregates.identical_only(spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), ["k"], ["v"], "differ").collect()


def test_upsert_and_diff(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, v string, n int")
    assert sorted(map(tuple, joins.upsert(old, new, ["k"], prefer_old=("n",)).collect())) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    cells = spark.createDataFrame([(1, "x", 1.0), (2, None, None), (3, "y", 2.0)], "k int, t string, v double")
    found = spark.createDataFrame([(1, "x", 1.0 + 1e-12), (2, None, None), (3, "y", 3.0), (4, "z", 0.0)], "k int, t string, v double")
    assert sorted(map(tuple, joins.cell_diff(cells, found, ["k"], "t", "v").collect())) == [(3, "number"), (4, "unexpected")]


def test_unavailable_rating_needs_a_said_zero(spark):
    schema = "domain string, listing_id string, brand string, reviews int, rating int, status string, historical boolean, rating_unavailable boolean, has_raw_rating boolean, raw_rating double"
    obs = spark.createDataFrame([("d", i, "b", 3, None, "ok", False, True, has, raw) for i, has, raw in (("null", True, None), ("zero", True, 0.0), ("missing", False, None), ("positive", True, 4.0))], schema)
    run = quality.Run(None, None, None, obs, None)
    assert {r.listing_id for r in quality.incomplete_metrics(run).collect()} == {"missing", "positive"}


def test_payload_readers(spark):
    html = '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"N","sku":7,"aggregateRating":{"ratingValue":"4,5","bestRating":10,"reviewCount":"12","ratingCount":30}}]}</script><script type="application/ld+json">{bad</script>'
    pages = spark.createDataFrame([(1, "https://shop.example/p/7?utm_x=1", html), (2, "https://shop.example/none", ""), (3, "https://eapteka.ru/x", html), (4, "https://shop.example/n", None)], "page_id int, url string, html string")
    got = {r.page_id: r for r in STANDARD.collect(pages).collect()}
    assert (got[1].reviews, got[1].rating_count, str(got[1].rating), got[1].status, got[1].listing_id) == (12, 30, "2.25", "ok", "7")
    assert got[2].status == got[4].status == "not_found"
    assert (got[3].status, got[3].reviews) == ("blocked", None)
    assert payloads.microdata_product('<b itemprop="ratingValue">4</b><i itemprop="ratingValue">5</i>') is None
    assert payloads.embedded_object('x = {"s": {"t": "}"}};', "s") == '{"t": "}"}'
    grid = payloads.Grid()
    grid.feed("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>")
    assert grid.cells == {(0, 0): "a", (1, 0): "", (0, 1): "b", (1, 1): "c"} and grid.merges == [(0, 2, 0, 1)]
    uneven = spark.createDataFrame([(1, [1, 2], [3])], "k int, a array<int>, b array<int>")
    with pytest.raises(Exception, match="different lengths"):
        payloads.rows_of_columns(uneven, ["a", "b"]).collect()


def test_identity(spark):
    rows = spark.createDataFrame([("Арбидол", "Арбидол Максимум капсулы 200 мг №10"), ("Арбидол", "Арбидол максимум капс. 0,2 г 10 шт"), ("Арбидол", "Ингавирин 90 мг"), ("Арбидол", "")], "brand string, title string")
    got = {r.title: r for r in identity.identify(rows, "brand", "title").collect()}
    first, second, foreign, none = (got[r.title] for r in rows.collect())
    assert first.label == "Максимум капсулы 200 мг №10" and first.granularity == "variant"
    assert second.variant_key == first.variant_key
    assert foreign.granularity == "unresolved" and foreign.variant_key is None and none.granularity == "unresolved"


#: Brand, title, label.
LABELS = [
    ("Велотон", "Велотон р-р д/в/м введ. 3 мл №5", "раствор для инъекций 3 мл №5"),
    ("Велотон", "Велотон р-р для в/в и в/м введения 3 мл №5", "раствор для внутривенного и внутримышечного введения 3 мл №5"),
    ("Эксумин", "Эксумин р-р д/ин. 10000 МЕ/мл 0,4 мл №10", "раствор для инъекций 10000 МЕ/мл 0,4 мл №10"),
    ("Мелот", "Мелот раствор в/м 10 мг/мл 1,5 мл 5 ампул", "раствор для инъекций 10 мг/мл 1,5 мл №5"),
    ("Нейпил", "Нейпил р-р для приема внутрь 100 мг в 1 мл, фл. 30 мл", "раствор для приема внутрь 100 мг/мл 30 мл"),
    ("Дантин", "Дантин Бэби раствор для приема внутрь 1 мл №10", "Бэби раствор для приема внутрь 1 мл №10"),
    ("Бутин", "Бутин Ретард таблетки 300 мг №20", "Ретард таблетки 300 мг №20"),
    ("Молентум", "Молентум эмульсия для купания 200 мл", "эмульсия 200 мл"),
    ("Хондро р-р", "Хондро р-р для в/м введения 100 мг/мл 2 мл №10", "раствор для инъекций 100 мг/мл 2 мл №10"),
    ("Анвиф", "Анвиф капс. 0,25 г №20", "капсулы 250 мг №20"),
    ("Цитов-3", "Цитов-3 порошок 0,02 г 12 саше", "порошок в саше 20 мг №12"),
    ("Кагор", "Кагор таблетки жевательные без сахара 5 мг 10 шт принимать 2 табл 3 раза в день", "без сахара жевательные таблетки 5 мг №10"),
    ("Стодал", "Стодал сироп 200 мл 1 шт", "сироп 200 мл"),
    ("Кремлин", "Кремлин кремлевский стикер", "Общая карточка бренда"),
    ("Бактоблис", "Бактоблис порошок 22,5 г, саше №15", "порошок в саше 1500 мг №15"),
    ("Оциллококцинум", "Оциллококцинум гранулы гомеопатические 1 доза 30 шт", "гранулы 1 г №30"),
    ("Сорбен", "Сорбен 15 саше-пакетов по 1500 мг", "саше 1500 мг №15"),
    ("Сорбен", "Сорбен порошок, 2 упаковки, 3 г №10", "порошок 3 г №10 ×2 упаковки"),
]


def test_labels(spark):
    rows = spark.createDataFrame(LABELS, "brand string, title string, wanted string")
    assert {r.title: r.label for r in identity.identify(rows, "brand", "title").collect()} == {t: w for _, t, w in LABELS}


def test_a_strength_left_out_tells_nothing(spark):
    rows = spark.createDataFrame([("А", "А табл. №10"), ("А", "А таблетки 5 мг 10 шт"), ("Б", "Б гель 5 мл"), ("Б", "Б отзывы"), ("В", "В гель 5 мл"), ("В", "В гель 9 мл"), ("В", "В отзывы")], "brand string, title string")
    got = {r.title: (r.label, r.variant_key) for r in identity.reconcile(identity.identify(rows, "brand", "title"), "brand").collect()}
    assert got["А табл. №10"] == got["А таблетки 5 мг 10 шт"] and got["А табл. №10"][0] == "таблетки №10"
    assert got["Б отзывы"] == got["Б гель 5 мл"] and got["В отзывы"] == ("Общая карточка бренда", None)


def test_publication_is_idempotent(spark, tmp_path):
    report = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert sinks.publish(spark, report, str(tmp_path), "sheet", "2026-07")
    assert not sinks.publish(spark, report, str(tmp_path), "sheet", "2026-07")
    assert sinks.publish(spark, report.limit(1), str(tmp_path), "sheet", "2026-07")
    months = spark.createDataFrame([(1, "2026-06"), (2, "2026-07")], "k int, month string")
    sinks.replace_month(months, f"{tmp_path}/m")
    sinks.replace_month(spark.createDataFrame([(3, "2026-07")], "k int, month string"), f"{tmp_path}/m")
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/m").collect()) == [1, 3]


def test_streams_give_what_batches_give(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = streams.open_stream(spark, f"{sf_dir}/events.parquet*", schema)
    done = streams.run_to_end(streams.first_imports(stream.select("ts", "user_id", "event_type"), ["user_id", "event_type"]), "imports", "append", f"{tmp_path}/c1")
    assert done.select("user_id", "event_type").distinct().count() == spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type").distinct().count()
    states = streams.run_to_end(streams.run_states(stream.select("ts", "user_id", F.lit("running").alias("event_type"))), "states", "update", f"{tmp_path}/c2")
    assert {(r.state, r.changes) for r in states.collect()} == {("running", 1)}


def test_stream_is_read_to_its_end_or_fails(spark, tmp_path):
    """More files than one trigger takes: all of them count, and a limit that passes gives no shorter table."""
    rows = spark.range(4000).select((F.lit("2024-01-01").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, 0, id)")).alias("ts"), F.lit("view").alias("event_type"), F.lit(0.01).alias("value"))
    rows.repartition(20).write.parquet(f"{tmp_path}/events.parquet")
    buckets = lambda: streams.quota_buckets(streams.open_stream(spark, f"{tmp_path}/events.parquet*", rows.schema, 1), late=None)
    with pytest.raises(TimeoutError):
        streams.run_to_end(buckets(), "cut", "complete", f"{tmp_path}/c1", seconds=0.5)
    got = streams.run_to_end(buckets(), "whole", "complete", f"{tmp_path}/c2").collect()
    assert sorted((r.cents, r.n) for r in got) == [(400, 400), (1800, 1800), (1800, 1800)]


def test_datasets(spark):
    """Columns of one length become rows, duplicates merge or fail, and a count that is not given is no zero."""
    item = lambda text: spark.createDataFrame([(text,)] if isinstance(text, str) else [(t,) for t in text], "item string")
    rows = datasets.observations_of(item(['{"sku":["007","8"],"title":["a","b"],"reviewCount":["1,2 тыс",0],"rating":[4.5,null]}', '{"sku":8,"title":"b","reviewCount":0}', '{"sku":"x"}', "no json", '{"id":"9"}']), datasets.OZON)
    got = {r.listing_id: (r.product, r.reviews, r.rating and float(r.rating), r.status) for r in rows.collect()}
    assert got == {"7": ("a", 1200, 4.5, "ok"), "8": ("b", 0, None, "no_reviews"), "9": (None, None, None, "needs_review")}
    with pytest.raises(Exception, match="different lengths"):
        datasets.observations_of(item('{"sku":["1","2"],"title":["a"]}'), datasets.OZON).collect()
    twice = ['{"nmId":1,"name":"a","feedbacks":3}', '{"nmId":1,"name":"a","feedbacks":4}']
    with pytest.raises(Exception, match="differs"):
        datasets.observations_of(item(twice), datasets.WILDBERRIES).collect()
    assert datasets.observations_of(item([t.replace("nmId", "sku").replace("feedbacks", "reviews") for t in twice]), datasets.OZON).first().status == "needs_review"
    assert datasets.observations_of(item([]), datasets.OZON).collect() == []


def test_sitemaps_that_list_one_another(spark):
    rows = spark.createDataFrame([("m/a", "<loc>m/b</loc><loc>p/1</loc>"), ("m/b", "<loc>m/a</loc><loc> p/2 </loc>"), ("m/c", "<loc>p/3</loc>"), ("m/d", None)], "url string, xml string")
    assert {r.url for r in payloads.listed(rows, "m/a", "m/").collect()} == {"p/1", "p/2"}


def test_a_walk_beyond_its_limit_fails():
    many = '<script type="application/ld+json">[' + ",".join(["{}"] * payloads.NODE_LIMIT) + "]</script>"
    with pytest.raises(ValueError, match="nodes"):
        payloads.ld_products(many)


def test_overrides_and_goods(spark):
    rows = spark.createDataFrame([("Сорб", "порошок 3 г №10"), ("Сорб", "таблетки"), ("Сорб", ""), ("Сорб", None), ("Сорб", "таблетки №10, №20")], "brand string, said string")
    got = {r.said: (r.granularity, r.label) for r in identity.override(rows, "brand", "said").collect()}
    assert got == {"порошок 3 г №10": ("variant", "порошок 3 г №10"), "таблетки": (None, None), "": (None, None), None: (None, None), "таблетки №10, №20": ("family", "таблетки №10, №20")}


def test_report_rows_are_numbered_through(spark):
    """Rows of a section are numbered as one window would, with nulls first and names shorter than the beginning."""
    names = [None, "", "a", "ab", "abcd", "abcde", "abcda", "b", "ba", "я", "яб", "abcd"]
    products = spark.createDataFrame([(s, i, n) for s in ("x", "y") for i, n in enumerate(names[: 12 if s == "x" else 5])], "section string, id int, name string")
    got = report.report_rows(products, products.select("section", "id", F.lit(1).alias("v")), ["section", "id"], "section", ["name", "id"]).collect()
    for s, n in (("x", 12), ("y", 5)):
        rows = sorted((r for r in got if r.section == s), key=lambda r: r.row)
        assert [r.row for r in rows] == list(range(n + 1)) and rows[0].n_products == n
        assert [r.id for r in rows[1:]] == sorted(range(n), key=lambda i: (names[i] is not None, (names[i] or "").encode(), i))
