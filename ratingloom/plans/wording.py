"""Queries of wordings, requests, robots files and runtime signals, over texts written of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import requests as Q
from ..operators import signals as G
from ..operators import wording as W
from ..registry import query
from ..sources import robots as R
from .bindings import table

SITE = "CASE n_nationkey % 5 WHEN 0 THEN 'https://www.Ozon.ru/x' WHEN 1 THEN 'reviews.yandex.ru' WHEN 2 THEN 'RIGLA.ru' WHEN 3 THEN concat('shop', n_nationkey, '.example') ELSE 'www.apteka-april.ru' END"


@query("prj03_platform_names", "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Ozon' WHEN 1 THEN 'Яндекс Маркет' WHEN 2 THEN 'Ригла' WHEN 3 THEN concat('shop', n_nationkey, '.example') ELSE 'Апрель' END AS label FROM nation")
def prj03_names(spark, d):
    return W.platform_labels(table(spark, d, "nation").select("n_nationkey", F.expr(SITE).alias("site")), "site").select("n_nationkey", "label")


@query("sf07_written_out", "SELECT p_partkey, concat(p_name, CASE p_partkey % 3 WHEN 0 THEN concat(' раствор для приема внутрь ', p_size, ' мл') WHEN 1 THEN concat(' капсулы №', p_size) ELSE concat(' капсид р-рост ', p_size) END) AS title FROM part")
def sf07_out(spark, d):
    text = F.expr("concat(p_name, CASE p_partkey % 3 WHEN 0 THEN concat(' р-р  д/вн. приёма ', p_size, ' мл') WHEN 1 THEN concat(' Капс. №', p_size, ' ') ELSE concat(' капсид р-рост ', p_size) END)")
    return table(spark, d, "part").select("p_partkey", W.written_out(text).alias("title"))


ISSUE = "CASE event_id % 8 WHEN 0 THEN concat('ozon/', event_type, ': quota_exceeded') WHEN 1 THEN 'HTTP 429' WHEN 2 THEN concat(event_type, ': blocked_free_mode') WHEN 3 THEN concat('x: parser_changed: ', user_id) WHEN 4 THEN ' ' WHEN 5 THEN 'needs_review' WHEN 6 THEN concat('not_found: карточка ', user_id) ELSE 'blocked' END"


@query("sf11_issue_texts", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN concat('ozon/', event_type, ': исчерпан доступный лимит сбора.') WHEN 1 THEN 'площадка временно ограничила сбор. Повторите позже.' WHEN 2 THEN concat(event_type, ': площадка пока не поддерживается в бесплатном режиме.')
  WHEN 3 THEN 'x: площадка изменила страницу и требует повторной настройки.' WHEN 4 THEN 'Не удалось завершить проверку.' WHEN 5 THEN 'карточка требует проверки.' ELSE 'площадка временно ограничила сбор. Повторите позже.' END AS said FROM events WHERE event_id % 8 <> 6
  UNION ALL SELECT event_id, concat('карточка ', user_id) FROM events WHERE event_id % 8 = 6""")
def sf11_issues(spark, d):
    return table(spark, d, "events").select("event_id", W.issue_text(F.expr(ISSUE)).alias("said"))


@query("sf11_error_texts", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Нет связи с сервисом. Проверьте интернет и повторите.' WHEN 1 THEN 'Доступный лимит сбора исчерпан. Повторите позже или временно уберите эту площадку.' WHEN 2 THEN 'Площадка временно ограничила автоматический сбор. Повторите позже.'
  WHEN 3 THEN 'Площадка изменила страницу. Её нужно повторно проверить перед публикацией.' WHEN 4 THEN 'Не удалось запустить сбор. Проверьте настройки и повторите.' WHEN 5 THEN concat('Нет такого бренда: ', event_type) ELSE 'Не удалось обновить Google Таблицу. Проверьте доступ «Редактор» по ссылке и повторите.' END AS said FROM events""")
def sf11_errors(spark, d):
    text = F.expr("CASE event_id % 7 WHEN 0 THEN 'TypeError: Failed to fetch' WHEN 1 THEN 'Лимит запросов исчерпан' WHEN 2 THEN 'Captcha' WHEN 3 THEN 'структура изменилась' WHEN 4 THEN 'Unexpected token < in JSON' WHEN 5 THEN concat('Нет такого бренда: ', event_type) ELSE 'странная ошибка' END")
    action = F.when(F.col("event_id") % 7 == 6, "publish").otherwise("start")
    return table(spark, d, "events").select("event_id", W.error_text(text, action).alias("said"))


@query("sf11_readiness", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'Добавьте ссылку на Google Таблицу.' WHEN o_orderkey % 11 = 1 THEN 'Выберите месяц отчёта.' WHEN o_orderkey % 40 = 0 THEN 'Добавьте хотя бы одну площадку.' WHEN o_orderkey % 30 = 0 THEN 'Добавьте хотя бы один бренд.' WHEN (o_orderkey % 40) * (o_orderkey % 30) > 600 THEN 'Слишком много проверок — максимум 600.'
  ELSE concat('Готово: ', o_orderkey % 40, ' ', CASE WHEN o_orderkey % 40 IN (1, 21, 31) THEN 'площадка' WHEN (o_orderkey % 40) % 10 IN (2, 3, 4) AND o_orderkey % 40 NOT IN (12, 13, 14) THEN 'площадки' ELSE 'площадок' END, ' × ', o_orderkey % 30, ' ', CASE WHEN o_orderkey % 30 IN (1, 21) THEN 'бренд' WHEN (o_orderkey % 30) % 10 IN (2, 3, 4) AND o_orderkey % 30 NOT IN (12, 13, 14) THEN 'бренда' ELSE 'брендов' END, '.') END AS said FROM orders""")
def sf11_ready(spark, d):
    k = F.col("o_orderkey")
    yes = F.lit(True)
    asked = {"sheet": F.when(k % 11 != 0, "x"), "sheet_valid": yes, "month": F.when(k % 11 != 1, "2026-07"), "region_valid": yes, "domains": k % 40, "brands": k % 30}
    return table(spark, d, "orders").select("o_orderkey", W.readiness(asked).alias("said"))


@query("prj13_observation_issues", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Не является товаром' WHEN o_orderkey % 5 = 0 THEN 'Отзывы / оценки не получены' WHEN o_orderkey % 4 > 0 AND o_orderkey % 3 = 0 THEN 'Рейтинг не получен' WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 > 0 THEN 'Проверьте число отзывов / оценок'
  WHEN o_orderkey % 2 = 0 THEN 'Не хватает данных о варианте' ELSE 'Нужно сверить карточку' END AS issue FROM orders""")
def prj13_issues(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", W.observation_issue(F.when(k % 5 != 0, k % 4), F.when(k % 3 > 0, 4.5), F.when(k % 7 == 0, "not_product").otherwise("variant"), F.when(k % 2 == 1, "exact").otherwise("partial")).alias("issue"))


@query("ex19_custom_site_counts", "SELECT p_partkey, 1 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS custom FROM part")
def ex19_counts(spark, d):
    """Sites of a request that are no known platform, each once however it is written."""
    text = F.expr("concat('https://www.ozon.ru/a, shop', p_partkey, '.example; WWW.shop', p_partkey, '.example\n rigla.ru,', CASE WHEN p_partkey % 3 = 0 THEN concat(' other', p_partkey, '.example') ELSE '' END)")
    return Q.custom_sites(table(spark, d, "part").select("p_partkey", text.alias("sites")), "p_partkey", "sites")


BATCH = """CASE p_partkey % 9 WHEN 0 THEN '[]' WHEN 1 THEN concat('{"sitemaps":["', s, '"],"brands":[{"brand":"b', p_size, '","tokens":["b', p_size, ' x"]}],"more":1}') WHEN 2 THEN concat('{"sitemaps":["', s, '","', s, '"],"brands":[{"brand":"bb","tokens":["bb"]}]}')
  WHEN 3 THEN '{"sitemaps":["https://reviews.yandex.ru.evil.example/x.xml"],"brands":[{"brand":"bb","tokens":["bb"]}]}' WHEN 4 THEN concat('{"sitemaps":["', s, '"],"brands":[{"brand":" bb","tokens":["bb"]}]}') WHEN 5 THEN concat('{"sitemaps":["', s, '"],"brands":[{"brand":"bb","tokens":["b-b"]}]}')
  WHEN 6 THEN concat('{"sitemaps":["', s, '"],"brands":[]}') WHEN 7 THEN concat('{"sitemaps":["', s, '"],"brands":[{"brand":"bb","tokens":["bb"]},{"brand":"bb","tokens":["cc"]}]}') ELSE concat('{"sitemaps":["', s, '"],"brands":[{"brand":"b', p_size, '","tokens":["b', p_size, ' x"]}]}') END"""


@query("ex20_batch_requests", "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'no object' WHEN 1 THEN 'unknown field' WHEN 2 THEN 'repeated sitemap' WHEN 3 THEN 'sitemap address' WHEN 4 THEN 'brand' WHEN 5 THEN 'token' WHEN 6 THEN 'brands' WHEN 7 THEN 'repeated brand' END AS problem FROM part")
def ex20_batch(spark, d):
    rows = table(spark, d, "part").withColumn("s", F.concat(F.lit("https://reviews.yandex.ru/ugcpub/sitemap_model_"), "p_partkey", F.lit("-1-2.xml")))
    return rows.select("p_partkey", Q.batch_problem(F.expr(BATCH)).alias("problem"))


SHEET = """concat('{"rows":2,"columns":', CASE p_partkey % 7 WHEN 1 THEN 30000 ELSE 2 END, ',"values":[["', p_name, '",', p_size, '],[null,', CASE p_partkey % 7 WHEN 2 THEN '{}' ELSE 'true' END, ']],"formulas":[[null,', CASE p_partkey % 7 WHEN 3 THEN '"SUM(A1)"' ELSE '"=SUM(A1)"' END, '],[null', CASE p_partkey % 7 WHEN 4 THEN '' ELSE ',null' END, ']],"merges":[{"startRow":0,"endRow":2,"startColumn":0,"endColumn":1}', CASE p_partkey % 7 WHEN 5 THEN ',{"startRow":1,"endRow":2,"startColumn":0,"endColumn":2}' ELSE '' END, '],"revision":"', CASE p_partkey % 7 WHEN 6 THEN 'x' ELSE repeat('a', 64) END, '","spreadsheetId":"id-1","tabName":"Рейтинги"}')"""


@query("ex17_read_back", "SELECT p_partkey, CASE p_partkey % 7 WHEN 1 THEN 'sheet_too_large' WHEN 2 THEN 'value' WHEN 3 THEN 'formula' WHEN 4 THEN 'width' WHEN 5 THEN 'overlapping merges' WHEN 6 THEN 'revision' END AS problem FROM part")
def ex17(spark, d):
    """Sheets that were read back, and the first thing that is wrong with each."""
    return table(spark, d, "part").select("p_partkey", Q.read_back_problem(F.expr(SHEET)).alias("problem"))


ROBOTS = """concat('# robots\nUser-agent: other\nDisallow: /\n\nUser-Agent: *\nUser-agent: slowbot\nDisallow: /list/', s_suppkey % 3, '\nAllow: /list/0/', s_suppkey % 4, ' # but this\nDisallow: /*.pdf$\nCrawl-delay: ', s_suppkey % 5, '\nSitemap: https://n', s_nationkey, '.example/s.xml\n\nUser-agent: ratingbot\nDisallow:', CASE WHEN s_suppkey % 2 = 0 THEN ' /private' ELSE '' END)"""


@query("fmt19_robots_groups", """SELECT s_suppkey, NOT (s_suppkey % 3 = 0 AND s_suppkey % 4 <> s_suppkey % 6) AS open_path, NOT (s_suppkey % 3 = 0) AS pdf_query, false AS pdf, s_suppkey % 2 = 1 AS own_rules, CAST(s_suppkey % 5 AS DOUBLE) AS delay, concat('https://n', s_nationkey, '.example/s.xml') AS sitemap FROM supplier""")
def fmt19_groups(spark, d):
    """Groups of agents, longest rules, wild cards, ends, delays and sitemaps."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.expr(ROBOTS).alias("robots"))
    rules = R.rules_of(F.col("robots"))
    everyone, own = R.for_agent(rules, "anybot/1.0"), R.for_agent(rules, "RatingBot/2")
    return rows.select(
        "s_suppkey", R.allowed(everyone, F.concat(F.lit("/list/0/"), (F.col("s_suppkey") % 6).cast("string"))).alias("open_path"), R.allowed(everyone, F.lit("/list/0.pdf?x")).alias("pdf_query"), R.allowed(everyone, F.lit("/a/b.pdf")).alias("pdf"),
        R.allowed(own, F.lit("/private/list/0")).alias("own_rules"), R.crawl_delay(everyone).alias("delay"), F.get(R.sitemaps(F.col("robots")), F.lit(0)).alias("sitemap"),
    )


PROOF = """CASE event_id % 7 WHEN 0 THEN '{"source":"ozon:search-html:google-translate","more":["ozon:product-json-ld:google-translate"]}' WHEN 1 THEN '"ozon:composer-api:edgeone-browser"' WHEN 2 THEN '{"proof":{"kind":"eapteka-reader-product"}}' WHEN 3 THEN 'ozon.ru' WHEN 4 THEN '{"initial_state":{"x":1}}' WHEN 5 THEN '{"a":"site-search","b":"registry"}' ELSE '["turbopages translated microdata"]' END"""


@query("uf11_runtime_signals", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'google_translate' WHEN 1 THEN 'sandbox,browser,first_party_api' WHEN 2 THEN 'reader_proxy' WHEN 3 THEN '' WHEN 4 THEN 'direct' WHEN 5 THEN 'registry' ELSE 'yandex_translate' END AS channels,
  CASE event_id % 7 WHEN 0 THEN 'json_ld' WHEN 1 THEN 'api_json' WHEN 4 THEN 'embedded_state' WHEN 6 THEN 'dom' ELSE '' END AS parsers FROM events""")
def uf11_signals(spark, d):
    """What evidence proves of its way, in its names as well as in its texts."""
    found = G.runtime_signals(table(spark, d, "events").select("event_id", F.expr(PROOF).alias("proof")), "event_id", "proof")
    return found.select("event_id", F.array_join("channels", ",").alias("channels"), F.array_join("parsers", ",").alias("parsers"))
