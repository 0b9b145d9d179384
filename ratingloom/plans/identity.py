"""Queries of product identity, over catalogue cards written of the parts table in the spellings that sites use.

Cards are written by expressions that both engines read alike; the SQL knows what a card was written of and never reads
its title.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spread import spread
from ..operators import identity as I
from ..registry import query
from .bindings import table

FORM = "CASE p_partkey % 5 WHEN 0 THEN 'таблетки' WHEN 1 THEN 'капсулы' WHEN 2 THEN 'порошок' WHEN 3 THEN 'таблетки для рассасывания' ELSE 'порошок в саше' END"
FORM_TEXT = "CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'табл.' ELSE 'таблетки' END WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'капс.' ELSE 'Капсулы' END WHEN 2 THEN 'порошок' WHEN 3 THEN 'пастилки для рассасывания' ELSE 'порошок, саше' END"
LINE, LINE_TEXT = "CASE WHEN p_size % 4 = 0 THEN 'Форте' WHEN p_size % 9 = 0 THEN 'без сахара' ELSE '' END", "CASE WHEN p_size % 4 = 0 THEN ' форте' WHEN p_size % 9 = 0 THEN ' б/сах' ELSE '' END"
STRENGTH, COUNT = "p_size * 10", "(p_size % 30 + 2)"
#: p_size is at most 50, so half a gram is the most.
STRENGTH_TEXT = f"CASE p_partkey % 3 WHEN 0 THEN concat({STRENGTH}, ' мг') WHEN 1 THEN concat('0,', CASE WHEN {STRENGTH} < 100 THEN '0' ELSE '' END, {STRENGTH}, ' г') ELSE concat({STRENGTH}, 'мг') END"
COUNT_TEXT = f"CASE p_partkey % 4 WHEN 0 THEN concat(' №', {COUNT}) WHEN 1 THEN concat(' ', {COUNT}, ' шт.') WHEN 2 THEN concat(', ', {COUNT}, ' штук') ELSE concat(' N', {COUNT}) END"
HOW_TEXT = "CASE WHEN p_partkey % 6 = 0 THEN ', принимать по 2 таблетки 3 раза в день' ELSE '' END"
#: Every eleventh card states no pack, every thirteenth names no brand.
HAS_PACK, HAS_BRAND = "p_partkey % 11 <> 0", "p_partkey % 13 <> 0"
TITLE = f"concat(CASE WHEN {HAS_BRAND} THEN p_brand ELSE 'Другое' END, {LINE_TEXT}, ' ', {FORM_TEXT}, ' ', {STRENGTH_TEXT}, CASE WHEN {HAS_PACK} THEN {COUNT_TEXT} ELSE '' END, {HOW_TEXT})"
BRAND_KEY = "replace(lower(p_brand), '#', ' ')"
LABEL = f"concat(CASE WHEN {LINE} = '' THEN '' ELSE {LINE} || ' ' END, {FORM}, ' ', {STRENGTH}, ' мг', CASE WHEN {HAS_PACK} THEN concat(' №', {COUNT}) ELSE '' END)"
CARDS = f"""SELECT p_partkey, p_brand, CASE WHEN {HAS_PACK} OR NOT {HAS_BRAND} THEN {LABEL} WHEN {LINE} <> '' THEN concat('Общая карточка: ', {LABEL}) ELSE {LABEL} END AS label,
  CASE WHEN {HAS_PACK} AND {HAS_BRAND} THEN 'variant' ELSE 'unresolved' END AS granularity, CASE WHEN {HAS_PACK} AND {HAS_BRAND} THEN concat({BRAND_KEY}, '|', {LINE}, '|', {FORM}, '|', {STRENGTH}, ' мг|', {COUNT}, '|') END AS variant_key FROM part"""


def cards(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.expr(TITLE).alias("title"))


@query("pi11_product_identity", f"""SELECT p_partkey, CASE WHEN NOT {HAS_BRAND} AND NOT {HAS_PACK} AND {LINE} <> '' THEN concat('Общая карточка: ', label) ELSE label END AS label, granularity, variant_key FROM ({CARDS.replace("SELECT p_partkey, p_brand,", "SELECT p_partkey, p_brand, p_size,")}) c""")
def pi11(spark, d):
    """Labels and keys of cards in many spellings."""
    return I.identify(cards(spark, d), "brand", "title").select("p_partkey", "label", "granularity", "variant_key")


@query("pi13_reconciled_variants", f"SELECT p_brand AS brand, count(DISTINCT variant_key) AS variants, count(DISTINCT label) FILTER (granularity = 'variant') AS labels FROM ({CARDS}) c GROUP BY 1")
def pi13(spark, d):
    known = I.reconcile(I.identify(cards(spark, d), "brand", "title"), "brand")
    return known.groupBy("brand").agg(F.count_distinct("variant_key").alias("variants"), F.count_distinct(F.when(F.col("granularity") == "variant", F.col("label"))).alias("labels"))


@query("pi13_proven_routes", f"SELECT p_partkey, CASE WHEN r.route IS NULL THEN concat('раствор ', p_size, ' мл №', {COUNT}) ELSE concat(r.route, ' ', p_size, ' мл №', {COUNT}) END AS label FROM part LEFT JOIN (SELECT p_brand AS b, p_size AS s, CASE WHEN bool_or(p_partkey % 3 = 1) THEN 'раствор для инъекций' WHEN bool_or(p_partkey % 3 = 2) THEN 'раствор в ампулах' END AS route FROM part GROUP BY 1, 2) r ON r.b = p_brand AND r.s = p_size")
def pi13_routes(spark, d):
    """A solution's route, proven by another card of the same strength and pack."""
    title = F.expr(f"concat(p_brand, ' ', CASE p_partkey % 3 WHEN 0 THEN 'раствор ' WHEN 1 THEN 'р-р д/ин. ' ELSE 'раствор в ампулах ' END, p_size, ' мл №', {COUNT})")
    return I.descriptors(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), title.alias("title")), "brand", "title").select("p_partkey", "label")


@query("pi08_evidence_candidates", f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'unresolved' ELSE 'variant' END AS granularity, CASE p_partkey % 4 WHEN 1 THEN 'ambiguous' ELSE 'exact' END AS confidence,
  CASE p_partkey % 4 WHEN 1 THEN 'Общая карточка нескольких вариантов (2 варианта)' ELSE concat('капсулы ', p_size, ' мг №', {COUNT}) END AS label FROM part""")
def pi08(spark, d):
    """Strong texts decide and may contradict one another; weak ones neither add a product nor overturn one."""
    title = F.expr(f"concat(p_brand, CASE WHEN p_partkey % 4 = 3 THEN ' капсулы' ELSE concat(' капсулы ', p_size, ' мг №', {COUNT}) END)")
    strong = F.expr(f"array(CASE p_partkey % 4 WHEN 1 THEN concat(p_brand, ' капсулы ', p_size, ' мг №', {COUNT} + 1) WHEN 3 THEN concat(p_brand, ' капс. ', p_size, 'мг ', {COUNT}, ' шт') END)")
    weak = F.expr(f"array(concat('Капсулы 999 мг №', {COUNT}), concat('капсулы №', {COUNT}), 'принимать по 2 капсулы в сутки')")
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), title.alias("title"), strong.alias("strong"), weak.alias("weak"))
    return I.identify(rows, "brand", "title").select("p_partkey", "granularity", "confidence", "label")


@query("pi11_shared_ratings", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'family' WHEN p_partkey % 3 = 1 THEN 'variant' WHEN p_partkey % 2 = 0 THEN 'line' ELSE 'family' END AS granularity, CASE WHEN p_partkey % 3 = 0 THEN concat('Общий рейтинг: таблетки ', p_size, ' мг; таблетки ', p_size + 1, ' мг; таблетки ', p_size + 2, ' мг; ещё 1')
  WHEN p_partkey % 3 = 1 THEN concat('таблетки ', p_size, ' мг №20') WHEN p_partkey % 2 = 0 THEN 'Общий рейтинг линейки «Дуо»' ELSE 'Общий рейтинг бренда' END AS label, CAST(CASE WHEN p_partkey % 3 = 0 THEN 4 END AS BIGINT) AS variant_count FROM part""")
def pi11_shared(spark, d):
    """Pages with one rating for all variants: of several, of one, of a line, of nothing told."""
    title = F.expr("concat(p_brand, CASE p_partkey % 3 WHEN 0 THEN ' отзывы' WHEN 1 THEN concat(' таблетки ', p_size, ' мг 20 шт') ELSE CASE WHEN p_partkey % 2 = 0 THEN ' Дуо отзывы' ELSE ' отзывы' END END)")
    variants = F.expr("CASE p_partkey % 3 WHEN 0 THEN transform(sequence(0, 3), i -> concat('таблетки ', p_size + i, ' мг')) WHEN 1 THEN array(concat('табл. ', p_size, 'мг №20')) ELSE array('№30') END")
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), title.alias("title"), variants.alias("variants"), F.lit(True).alias("family"))
    return I.identify(rows, "brand", "title").select("p_partkey", "granularity", "label", F.col("variant_count").cast("long").alias("variant_count"))


@query("pi12_consumer_goods", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('бутылочка ', p_size, ' мл с соской') ELSE concat('бутылочка с соской ', p_size, ' мл') END AS label, concat(replace(lower(p_brand), '#', ' '), '|goods|', p_size, '|бутылочка|мл|соска') AS variant_key FROM part")
def pi12(spark, d):
    """Goods of a product page of their own, in two spellings: a label keeps its order of words, the key does not."""
    title = F.expr("concat(p_brand, CASE WHEN p_partkey % 2 = 0 THEN concat(', Бутылочка ', p_size, 'мл с соской, 1 шт') ELSE concat(' бутылочка с соской ', p_size, ' мл') END)")
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), title.alias("title"), F.lit(True).alias("family"), F.col("p_partkey").cast("string").alias("product_id"))
    return I.identify(rows, "brand", "title").select("p_partkey", "label", "variant_key")


@query("pi16_title_proves_variant", "SELECT p_partkey, p_partkey % 4 = 0 AS proves FROM part")
def pi16(spark, d):
    title = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(p_brand, ' гель ', p_size, ' мл') WHEN 1 THEN concat('гель ', p_size, ' мл') WHEN 2 THEN concat(p_brand, ' гелевый ', p_size, ' мл') ELSE concat(p_brand, ' гель, применять по 5 г утром') END")
    return spread(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").select("p_partkey", I.proves_variant(title, F.col("p_brand")).alias("proves"))


@query("pi17_overrides", f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('сироп ', p_size, ' мл') WHEN 1 THEN concat('таблетки №', {COUNT}, ' и №', {COUNT} + 10) END AS label, CASE p_partkey % 4 WHEN 0 THEN 'variant' WHEN 1 THEN 'family' END AS granularity, CAST(CASE p_partkey % 4 WHEN 1 THEN 2 END AS BIGINT) AS variant_count FROM part")
def pi17(spark, d):
    """What a person writes is taken if it proves a variant; several packs are a family; vague and endless texts are refused."""
    said = F.expr(f"CASE p_partkey % 4 WHEN 0 THEN concat(' сироп   ', p_size, 'мл ') WHEN 1 THEN concat('таблетки №', {COUNT}, ' и №', {COUNT} + 10) WHEN 2 THEN 'таблетки' ELSE repeat(concat('таблетки №', {COUNT}, ' '), 30) END")
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), said.alias("said"))
    return I.override(rows, "brand", "said").select("p_partkey", "label", "granularity", F.col("variant_count").cast("long").alias("variant_count"))


@query("pi18_stored_labels", f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Общая карточка бренда (3 варианта)' WHEN 1 THEN 'Общая карточка линейки «Форте»' WHEN 2 THEN concat('таблетки №', {COUNT}) ELSE 'Общая карточка бренда' END AS label, CASE p_partkey % 4 WHEN 0 THEN 'family' WHEN 1 THEN 'line' WHEN 2 THEN 'variant' ELSE 'family' END AS granularity FROM part")
def pi18(spark, d):
    """Labels of earlier months as titles: aggregates stay as they are, drafts are read again, and a plus is no line."""
    title = F.expr(f"CASE p_partkey % 4 WHEN 0 THEN 'Общая карточка бренда (3 варианта)' WHEN 1 THEN 'Общая карточка линейки «Форте»' WHEN 2 THEN concat('Вариант не определён · известно: ', p_brand, ' таблетки №', {COUNT}) ELSE 'Общая карточка линейки «Плюс»' END")
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), title.alias("title"))
    return I.identify(rows, "brand", "title").select("p_partkey", "label", "granularity")
