"""Queries of the scalar functions, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as T
from ..functions import urls as U
from ..operators import projections as P
from ..registry import query
from .bindings import OBS, RATING, observations, rating, table


def written(spark, d, name: str, key: str, **texts: str):
    """key and texts written of a whole table by expressions that both engines read alike."""
    return table(spark, d, name).select(F.col(key).alias("k"), *[F.expr(text).alias(c) for c, text in texts.items()])


#: Latin letters of product names as Cyrillic ones, in front of what only Cyrillic has.
CYRILLIC = "concat(translate(lower(p_name), 'abcdefghiklmnoprstuvz', 'абцдефгхиклмнопрстувз'), CASE p_partkey % 4 WHEN 0 THEN ' щёлочь' WHEN 1 THEN ' Ёжик — юла' WHEN 2 THEN ' подъём №30' ELSE ' жучья шея' END)"
LATIN_SQL = "regexp_replace(" + "".join("replace(" for _ in range(6)) + "translate(lower(t), 'абвгдеёзийклмнопрстуфхыэъь', 'abvgdeeziyklmnoprstufhye')" + "".join(f", '{a}', '{b}')" for a, b in (("ж", "zh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "sch"), ("ю", "yu"))) + ", 'я', 'ya', 'g')"
FOLD_SQL = "trim(regexp_replace(regexp_replace(replace(lower({0}), 'ё', 'е'), '[‐‑‒–—−-]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query("sf01_normalize_text", "SELECT doc_id, sha256(" + FOLD_SQL.format("nfc_normalize(text)") + ") AS folded FROM documents")
def sf01(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("folded"))


@query("sf03_transliterate", f"SELECT k, {LATIN_SQL} AS latin FROM (SELECT p_partkey AS k, {CYRILLIC} AS t FROM part)")
def sf03(spark, d):
    return written(spark, d, "part", "p_partkey", t=CYRILLIC).select("k", T.transliterate(F.lower("t")).alias("latin"))


@query("sf04_brand_slugs", "SELECT DISTINCT p_brand, replace(" + FOLD_SQL.format("p_brand") + ", ' ', '-') AS slug FROM part")
def sf04(spark, d):
    return table(spark, d, "part").select("p_brand").distinct().select("p_brand", T.slug(F.col("p_brand")).alias("slug"))


@query("sf05_title_of_slug", "SELECT p_partkey, upper(substr(a, 1, 1)) || substr(a, 2) || ' ' || upper(substr(b, 1, 1)) || substr(b, 2) AS title FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)")
def sf05(spark, d):
    return table(spark, d, "part").select("p_partkey", T.title_of_slug(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("?page=2"))).alias("title"))


@query("sf07_expand_abbreviations", "SELECT p_partkey, replace(replace(p_type, 'ECONOMY', 'economy class'), 'PROMO', 'promotion') AS expanded FROM part")
def sf07(spark, d):
    return table(spark, d, "part").select("p_partkey", P.expanded(F.col("p_type"), {"ECONOMY": "economy class", "PROMO": "promotion"}).alias("expanded"))


@query("sf08_plural_forms", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 AND o_orderkey % 100 <> 11 THEN 'отзыв' WHEN o_orderkey % 10 BETWEEN 2 AND 4 AND NOT o_orderkey % 100 BETWEEN 12 AND 14 THEN 'отзыва' ELSE 'отзывов' END AS word FROM orders")
def sf08(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.plural(F.col("o_orderkey"), "отзыв", "отзыва", "отзывов").alias("word"))


@query("sf09_strip_tags", """SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))) AS visible FROM pages""")
def sf09(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(T.without_tags(F.col("html")), 256).alias("visible"))


@query("sf10_redact_messages", r"SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \n\t]+', '[url]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', '[email]', 'g'), '(token|secret|password|key)( *[:=] *)[^ \n\t,;]+', '\1\2[hidden]', 'g'), 'Bearer +[A-Za-z0-9._-]+', 'Bearer [hidden]', 'g'), '[A-Fa-f0-9]{32,}', '[hidden]', 'g'), 1, 500) AS message FROM documents")
def sf10(spark, d):
    return table(spark, d, "documents").select("doc_id", T.redacted(F.col("text")).alias("message"))


@query("sf12_final_label", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_size > 40 THEN p_name ELSE '' END, ''), p_brand || ' ' || p_type) AS label FROM part")
def sf12(spark, d):
    return table(spark, d, "part").select("p_partkey", P.first_present(F.when(F.col("p_size") > 40, F.col("p_name")).otherwise(""), F.concat_ws(" ", "p_brand", "p_type")).alias("label"))


@query("sf13_tab_names", r"SELECT DISTINCT p_brand, trim(regexp_replace(regexp_replace('''' || p_brand || ': [x]/y*', '[\[\]*?/\\:]+', ' ', 'g'), '\s+', ' ', 'g')) AS raw, rtrim(substr(trim(regexp_replace(regexp_replace(trim(regexp_replace('''' || p_brand || ': [x]/y*', '[\[\]*?/\\:]+', ' ', 'g'), ''''), '^''+|''+$', '', 'g'), '\s+', ' ', 'g')), 1, 100)) AS tab FROM part")
def sf13(spark, d):
    raw = F.concat(F.lit("'"), F.col("p_brand"), F.lit(": [x]/y*"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(raw, r"[\[\]*?/\\:]+", " "), r"\s+", " "))
    return table(spark, d, "part").select("p_brand").distinct().select("p_brand", plain.alias("raw"), T.tab_name(raw).alias("tab"))


FORMULA = "CASE o_orderkey % 4 WHEN 0 THEN concat('=сумм(A', o_custkey, '; B2)') WHEN 1 THEN concat('=IFERROR(COUNTIFS(A:A;>', o_custkey, ')/ 2;0)') WHEN 2 THEN concat('=ЕСЛИОШИБКА(СЧЁТЕСЛИ(A1:A', o_custkey, ';1);0)') END"


@query("sf14_formulas", f"SELECT k, replace(replace(replace(replace(replace(replace(regexp_replace(upper(t), '\\s+', '', 'g'), 'СУММ(', 'SUM('), 'СЧЁТЕСЛИМН(', 'COUNTIFS('), 'СЧЁТЕСЛИ(', 'COUNTIF('), 'ЕСЛИОШИБКА(', 'IFERROR('), 'ЕСЛИ(', 'IF('), ';', ',') AS formula FROM (SELECT o_orderkey AS k, {FORMULA} AS t FROM orders)")
def sf14(spark, d):
    return written(spark, d, "orders", "o_orderkey", t=FORMULA).select("k", T.formula(F.col("t")).alias("formula"))


@query("nf01_rating_to_five", f"WITH {OBS} SELECT domain, listing_id, month, {RATING} AS rating_x100 FROM obs")
def nf01(spark, d):
    return observations(spark, d).select("domain", "listing_id", "month", rating().alias("rating_x100"))


COUNT = "CASE o_orderkey % 7 WHEN 0 THEN concat(o_custkey % 90, ',', o_custkey % 10, ' тыс') WHEN 1 THEN concat(o_custkey % 900, 'k') WHEN 2 THEN concat(o_custkey % 9, ' млн') WHEN 3 THEN concat(o_custkey, '') WHEN 4 THEN concat('0,', o_custkey % 10, ' тыс.') WHEN 5 THEN concat('many ', o_custkey) ELSE concat(o_custkey, ' x') END"


@query("nf02_compact_counts", f"SELECT k, CAST(round(CAST(replace(nullif(regexp_extract(l, '^(\\d+(?:[.,]\\d+)?)', 1), ''), ',', '.') AS DECIMAL(18,6)) * CASE regexp_extract(l, '^\\d+(?:[.,]\\d+)?\\s*([a-zа-я]*)', 1) WHEN 'тыс' THEN 1000 WHEN 'k' THEN 1000 WHEN 'к' THEN 1000 WHEN 'млн' THEN 1000000 WHEN 'm' THEN 1000000 WHEN 'м' THEN 1000000 WHEN '' THEN 1 END) AS BIGINT) AS n FROM (SELECT k, lower(trim(t)) AS l FROM (SELECT o_orderkey AS k, {COUNT} AS t FROM orders))")
def nf02(spark, d):
    return written(spark, d, "orders", "o_orderkey", t=COUNT).select("k", N.compact_count(F.col("t")).alias("n"))


NUMBER = "CASE o_orderkey % 7 WHEN 0 THEN concat(o_custkey % 100, ',', 10 + o_custkey % 90) WHEN 1 THEN concat(1 + o_custkey % 9, ' ', 100 + o_orderkey % 900) WHEN 2 THEN concat(' ', o_custkey, '.5 ') WHEN 3 THEN concat('x', o_custkey) WHEN 4 THEN concat('-', o_custkey) WHEN 5 THEN concat('оценка ', o_custkey % 5, ',', o_custkey % 10, ' из 5') ELSE '' END"


@query("nf03_locale_numbers", f"SELECT k, CASE WHEN regexp_matches(s, '^-?\\d+([.]\\d+)?$') THEN CAST(round(CAST(s AS DOUBLE) * 100) AS BIGINT) END AS whole_x100, CASE WHEN f <> '' THEN CAST(round(CAST(replace(f, ',', '.') AS DOUBLE) * 100) AS BIGINT) END AS first_x100 FROM (SELECT k, replace(regexp_replace(t, '[\\s ]+', '', 'g'), ',', '.') AS s, regexp_extract(t, '(\\d+(?:[.,]\\d+)?)', 1) AS f FROM (SELECT o_orderkey AS k, {NUMBER} AS t FROM orders))")
def nf03(spark, d):
    rows = written(spark, d, "orders", "o_orderkey", t=NUMBER)
    return rows.select("k", F.round(N.plain_number(F.col("t")) * 100).cast("long").alias("whole_x100"), F.round(N.number_in(F.col("t")) * 100).cast("long").alias("first_x100"))


@query("nf04_strict_values", f"SELECT k, CASE WHEN regexp_matches(trim(t), '^\\d{{1,9}}$') THEN CAST(trim(t) AS INTEGER) END AS n FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN {NUMBER} ELSE {COUNT} END AS t FROM orders)")
def nf04(spark, d):
    return written(spark, d, "orders", "o_orderkey", t=f"CASE WHEN o_orderkey % 2 = 0 THEN {NUMBER} ELSE {COUNT} END").select("k", N.strict_count(F.col("t")).alias("n"))


SKU = "CASE p_partkey % 5 WHEN 0 THEN concat('00', p_partkey) WHEN 1 THEN concat(' ', p_partkey, ' ', 100 + p_size, ' ') WHEN 2 THEN '0' WHEN 3 THEN concat('A', p_partkey) ELSE concat(p_partkey, '9876543210') END"


@query("nf06_sku", f"SELECT k, CASE WHEN regexp_matches(s, '^\\d{{1,18}}$') THEN s END AS sku FROM (SELECT k, ltrim(regexp_replace(t, '\\s+', '', 'g'), '0') AS s FROM (SELECT p_partkey AS k, {SKU} AS t FROM part))")
def nf06(spark, d):
    return written(spark, d, "part", "p_partkey", t=SKU).select("k", N.sku(F.col("t")).alias("sku"))


@query("nf07_id_buckets", "SELECT p_partkey, CASE WHEN p_partkey <= 143 THEN 1 WHEN p_partkey <= 287 THEN 2 WHEN p_partkey <= 431 THEN 3 WHEN p_partkey <= 1061 THEN 4 ELSE 5 END AS bucket, p_partkey // 100 AS volume FROM part")
def nf07(spark, d):
    return table(spark, d, "part").select("p_partkey", N.bucket_of(F.col("p_partkey"), [143, 287, 431, 1061]).alias("bucket"), F.floor(F.col("p_partkey") / 100).alias("volume"))


SCORE = "CASE o_orderkey % 4 WHEN 0 THEN concat(o_custkey % 5, ',', o_custkey % 10, ' • ', o_custkey, ' отзыва') WHEN 1 THEN concat('5 • ', 1 + o_custkey % 9, ' ', 100 + o_orderkey % 900, ' отзыва') WHEN 2 THEN 'нет отзывов' ELSE concat(o_custkey % 5, '.', 10 + o_custkey % 90, ' · ', o_custkey % 50) END"


@query("nf08_score_and_count", f"SELECT k, CAST(CAST(replace(nullif(regexp_extract(t, '^\\s*(\\d(?:[.,]\\d{{1,2}})?)\\s*[•·]', 1), ''), ',', '.') AS DECIMAL(3,2)) * 100 AS BIGINT) AS rating_x100, CAST(nullif(regexp_replace(regexp_extract(t, '[•·]\\s*(\\d[\\d\\s ]*)', 1), '[\\s ]+', '', 'g'), '') AS BIGINT) AS n FROM (SELECT o_orderkey AS k, {SCORE} AS t FROM orders)")
def nf08(spark, d):
    found = N.score_and_count(F.col("t"))
    return written(spark, d, "orders", "o_orderkey", t=SCORE).select("k", (found["rating"] * 100).cast("long").alias("rating_x100"), found["count"].alias("n"))


MASS = "CASE WHEN o_orderkey % 9 > 0 THEN concat(o_custkey % 500, ',', o_orderkey % 10) END"
MASS_UNIT = "CASE o_custkey % 5 WHEN 0 THEN 'мг' WHEN 1 THEN 'г' WHEN 2 THEN 'мкг' WHEN 3 THEN 'гр' ELSE 'шт' END"


@query("nf09_masses", f"SELECT k, CAST(trunc(CAST(replace(n, ',', '.') AS DECIMAL(18,4)) * CASE u WHEN 'мкг' THEN 1 WHEN 'мг' THEN 1000 WHEN 'г' THEN 1000000 WHEN 'гр' THEN 1000000 END) AS BIGINT) AS ug FROM (SELECT o_orderkey AS k, {MASS} AS n, {MASS_UNIT} AS u FROM orders)")
def nf09(spark, d):
    return written(spark, d, "orders", "o_orderkey", n=MASS, u=MASS_UNIT).select("k", N.micrograms(F.replace("n", F.lit(","), F.lit(".")), F.col("u")).alias("ug"))


@query("nf10_rating_text", "SELECT p_size, CASE WHEN h IS NULL THEN '—' WHEN h % 100 = 0 THEN CAST(h // 100 AS VARCHAR) WHEN h % 10 = 0 THEN CAST(h // 100 AS VARCHAR) || ',' || CAST(h % 100 // 10 AS VARCHAR) ELSE CAST(h // 100 AS VARCHAR) || ',' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') END AS shown FROM (SELECT DISTINCT p_size, CASE WHEN p_size % 7 <> 0 THEN p_size * 10 - p_size % 3 END AS h FROM part)")
def nf10(spark, d):
    hundredths = F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 10 - F.col("p_size") % 3)
    return table(spark, d, "part").select("p_size").distinct().select("p_size", N.rating_text(hundredths / 100).alias("shown"))


@query("nf11_backoff", "SELECT DISTINCT p_size AS attempt, least(60000, CAST(500 * pow(3, least(p_size - 1, 20)) AS BIGINT)) AS delay FROM part")
def nf11(spark, d):
    return table(spark, d, "part").select(F.col("p_size").alias("attempt")).distinct().select("attempt", N.backoff(F.col("attempt"), 500, 60_000).alias("delay"))


NAMED = "CASE substr(m, 6, 2) " + " ".join(f"WHEN '{i:02d}' THEN '{n}'" for i, n in enumerate(D.MONTHS, 1)) + " END || ' ' || substr(m, 1, 4)"


@query("df01_month_labels", f"SELECT m, {NAMED} AS label, m AS back FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders)")
def df01(spark, d):
    months = table(spark, d, "orders").select(D.month_of(F.col("o_orderdate")).alias("m")).distinct()
    label = D.month_label(F.col("m"))
    return months.select("m", label.alias("label"), D.month_of_label(label, 2020).alias("back"))


@query("df02_next_month", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m') AS following FROM orders")
def df02(spark, d):
    months = table(spark, d, "orders").select(D.month_of(F.col("o_orderdate")).alias("m")).distinct()
    return months.select("m", D.next_month(F.col("m")).alias("following"))


@query("df03_earlier_and_later", "SELECT o_orderkey, least(strftime(o_orderdate, '%Y-%m'), '1997-06') AS earlier, greatest(strftime(o_orderdate, '%Y-%m'), '1997-06') AS later FROM orders")
def df03(spark, d):
    m = D.month_of(F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", F.least(m, F.lit("1997-06")).alias("earlier"), F.greatest(m, F.lit("1997-06")).alias("later"))


@query("df04_instants", "SELECT event_id AS k, CAST(CASE event_id % 5 WHEN 0 THEN epoch(date_trunc('second', ts)) WHEN 1 THEN epoch(date_trunc('second', ts)) - 10800 WHEN 2 THEN epoch(date_trunc('second', ts)) + 19800 END AS BIGINT) AS seconds FROM events")
def df04(spark, d):
    """Instants with a zone are read; a day alone and words are none."""
    local = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(F.col("event_id") % 5 == 0, "Z").when(F.col("event_id") % 5 == 1, "+03:00").otherwise("-05:30")
    text = F.when(F.col("event_id") % 5 < 3, F.concat(local, zone)).when(F.col("event_id") % 5 == 3, F.substring(local, 1, 10)).otherwise("soon")
    return table(spark, d, "events").select(F.col("event_id").alias("k"), F.unix_timestamp(D.instant(text)).alias("seconds"))


@query("uf01_canonical_url", """WITH q AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages), p AS (SELECT page_id, regexp_replace(bare, '\\?.*$', '') AS path, list_filter(string_split(CASE WHEN contains(bare, '?') THEN regexp_extract(bare, '\\?(.*)$', 1) ELSE '' END, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_|yclid$|gclid$|srsltid$|at$|from$|ref)')) AS kept FROM q)
  SELECT page_id, CASE WHEN len(kept) > 0 THEN path || '?' || array_to_string(kept, '&') ELSE path END AS url FROM p""")
def uf01(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("url"))


@query("uf02_row_identity", "SELECT page_id, 'site:' || lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '') || CASE WHEN p = '' THEN '/' ELSE p END AS identity FROM (SELECT page_id, url, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z]+://[^/]*(/.*)?$', 1), '/+$', '') AS p FROM pages)")
def uf02(spark, d):
    return table(spark, d, "pages").select("page_id", U.row_identity(F.lit("Site"), F.col("url")).alias("identity"))


@query("uf03_same_site", "SELECT page_id, h LIKE '%.example.com' AS same FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS h FROM pages)")
def uf03(spark, d):
    return table(spark, d, "pages").select("page_id", U.same_site(U.host(F.col("url")), F.lit("example.com")).alias("same"))


LINK = "CASE p_partkey % 8 WHEN 0 THEN concat('https://www.ozon.ru/product/name-', p_partkey, '/') WHEN 1 THEN concat('https://www.wildberries.ru/catalog/', p_partkey, '/detail.aspx') WHEN 2 THEN concat('https://market.yandex.ru/product--x/5--', p_partkey) WHEN 3 THEN concat('https://other.example/a/', p_partkey) WHEN 4 THEN concat('https://docs.google.com/spreadsheets/d/abc_DEF-', p_partkey, '/edit') WHEN 5 THEN concat('http://10.0.0.', p_size, '/x') WHEN 6 THEN concat('https://u@h.example/', p_partkey) ELSE concat('https://h.example:', CASE WHEN p_size % 2 = 0 THEN 443 ELSE 8443 END, '/', p_partkey) END"
LINKED = f"(SELECT p_partkey AS k, p_size, {LINK} AS t FROM part)"


@query("uf04_listing_ids", f"SELECT k, CASE WHEN contains(t, '/product/name-') OR contains(t, 'wildberries') OR contains(t, '--') THEN CAST(k AS VARCHAR) ELSE substr(sha256(t), 1, 20) END AS id FROM {LINKED}")
def uf04(spark, d):
    return written(spark, d, "part", "p_partkey", t=LINK).select("k", U.listing_id(F.col("t")).alias("id"))


@query("uf05_spreadsheet_ids", f"SELECT k, CASE WHEN starts_with(t, 'https://docs.google.com/spreadsheets/d/') THEN split_part(t, '/', 6) END AS id FROM {LINKED}")
def uf05(spark, d):
    return written(spark, d, "part", "p_partkey", t=LINK).select("k", U.spreadsheet_id(F.col("t")).alias("id"))


@query("uf06_product_urls", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'https://www.wildberries.ru/catalog/' || p_partkey || '/detail.aspx' WHEN 1 THEN 'https://www.ozon.ru/product/' || p_partkey || '/' END AS url FROM part")
def uf06(spark, d):
    site = F.when(F.col("p_partkey") % 3 == 0, "wildberries.ru").when(F.col("p_partkey") % 3 == 1, "ozon.ru").otherwise("other")
    return table(spark, d, "part").select("p_partkey", U.product_url(site, F.col("p_partkey").cast("string")).alias("url"))


@query("uf07_payload_hash", "SELECT o_orderkey, sha256('+' || o_orderkey || '|' || CASE WHEN o_custkey % 5 = 0 THEN '-' ELSE '+' || o_custkey END || '|+' || o_orderstatus) AS hash FROM orders")
def uf07(spark, d):
    maybe = F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", U.payload_hash(F.col("o_orderkey"), maybe, F.col("o_orderstatus")).alias("hash"))


@query("uf08_revision_hash", "SELECT l_orderkey, sha256(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, '|' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS revision FROM lineitem GROUP BY 1")
def uf08(spark, d):
    cells = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    text = F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c["l_linenumber"], c["l_partkey"], c["l_suppkey"])), "|")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sha2(text, 256).alias("revision"))


@query("uf09_json_keys", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def uf09(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("uf10_first_present", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END, ''), c_name) AS label FROM customer")
def uf10(spark, d):
    return table(spark, d, "customer").select("c_custkey", P.first_present(F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")), F.col("c_name")).alias("label"))


@query("uf11_signal_tags", "SELECT page_id, concat_ws(',', CASE WHEN contains(html, '<script') THEN 'script' END, CASE WHEN contains(html, '<table') THEN 'table' END, CASE WHEN contains(html, 'ld+json') THEN 'json-ld' END) AS signals FROM pages")
def uf11(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(P.tags(F.col("html"), {"script": "<script", "table": "<table", "json-ld": "ld\\+json"}), ",").alias("signals"))


#: Addresses of pages, and of sites that the report puts in sections, in the ways that they are written.
SITE = "CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN concat('https://www.Ozon.ru/x/', page_id) WHEN 2 THEN 'reviews.yandex.ru' WHEN 3 THEN concat('my-apteka.s', page_id, '.example') WHEN 4 THEN concat(' WWW.shop', page_id, '.example:443/a?b#c ') WHEN 5 THEN 'zdrav.city' ELSE concat('http://rigla.ru/', page_id) END"
BARE = "regexp_replace(regexp_extract(lower(trim(t)), '^(?:[a-z]+://)?(?:www\\.)?([^/?#:]+)', 1), '^reviews\\.', 'market.')"
SITED = f"(SELECT page_id AS k, {BARE} AS domain FROM (SELECT page_id, {SITE} AS t FROM pages))"


@query("prj01_domains", f"SELECT k, domain FROM {SITED}")
def prj01(spark, d):
    return written(spark, d, "pages", "page_id", t=SITE).select("k", U.domain(F.col("t")).alias("domain"))


@query("prj02_categories", f"SELECT k, CASE WHEN domain IN ('ozon.ru', 'market.yandex.ru') THEN 'marketplaces' WHEN domain = 'rigla.ru' OR list_has_any(string_split(replace(domain, '-', '.'), '.'), ['apteka', 'pharm', 'farm', 'zdrav', 'drugstore']) THEN 'pharmacies' ELSE 'review-sites' END AS category FROM {SITED}")
def prj02(spark, d):
    return written(spark, d, "pages", "page_id", t=SITE).select("k", P.category(U.domain(F.col("t"))).alias("category"))


@query("prj03_platform_labels", "SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'First' WHEN 'NATION_2' THEN 'Second' ELSE n_name END AS label FROM nation")
def prj03(spark, d):
    labels = spark.createDataFrame([("NATION_1", "First"), ("NATION_2", "Second")], "n_name string, label string")
    return table(spark, d, "nation").join(F.broadcast(labels), "n_name", "left").select("n_nationkey", F.coalesce("label", "n_name").alias("label"))


@query("prj04_brand_match", "SELECT p_partkey, contains(' ' || lower(p_name) || ' ', ' widget ') OR contains(' ' || lower(p_name) || ' ', ' small bolt ') AS matches FROM part")
def prj04(spark, d):
    return table(spark, d, "part").select("p_partkey", P.matches_any(T.folded(F.col("p_name")), ["widget", "small bolt"]).alias("matches"))


@query("prj05_exact_brand", "SELECT DISTINCT p_brand, regexp_matches(p_brand, '(^|[^\\p{L}\\p{N}])(?i:brand#1)($|[^\\p{L}\\p{N}])') AS exact FROM part")
def prj05(spark, d):
    return table(spark, d, "part").select("p_brand").distinct().select("p_brand", P.names_exactly(F.col("p_brand"), "Brand#1").alias("exact"))


@query("prj06_free_text_search", "SELECT p_partkey FROM part WHERE contains(lower(p_brand || ' ' || p_name || ' ' || p_type), 'cold wid')")
def prj06(spark, d):
    return P.search(table(spark, d, "part"), ["p_brand", "p_name", "p_type"], "Cold wid").select("p_partkey")


FEEDBACK = "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 20 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS reviews, CASE WHEN l_discount > 0.05 THEN CAST(round(l_discount * 300) AS BIGINT) WHEN l_discount > 0.03 THEN 0 END AS rating_count, CASE WHEN l_quantity < 20 THEN 'no_reviews' WHEN l_tax > 0.06 THEN 'blocked' ELSE 'ok' END AS status FROM lineitem)"


@query("prj07_feedback", FEEDBACK + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN status = 'blocked' THEN reviews ELSE greatest(reviews, coalesce(rating_count, 0)) END AS reviews, CASE WHEN status <> 'blocked' AND rating_count IS NOT NULL THEN reviews END AS written, CASE WHEN status = 'blocked' THEN status WHEN greatest(reviews, coalesce(rating_count, 0)) > 0 THEN 'ok' ELSE 'no_reviews' END AS status FROM r")
def prj07(spark, d):
    written = F.when(F.col("l_quantity") < 20, 0).otherwise(F.col("l_quantity").cast("long"))
    counted = F.when(F.col("l_discount") > 0.05, F.round(F.col("l_discount") * 300).cast("long")).when(F.col("l_discount") > 0.03, 0)
    status = F.when(F.col("l_quantity") < 20, "no_reviews").when(F.col("l_tax") > 0.06, "blocked").otherwise("ok")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", written.alias("reviews"), counted.alias("rating_count"), status.alias("status"), F.lit(None).cast("double").alias("rating"), F.lit(None).cast("long").alias("written_review_count"), F.lit(False).alias("has_written_review_count"))
    return P.unify_feedback(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "reviews", F.col("written_review_count").alias("written"), "status")


@query("prj13_issue_reasons", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'blocked' WHEN o_totalprice > 400000 THEN 'too_large' WHEN o_orderpriority LIKE '4%' THEN 'unspecified' ELSE 'none' END AS reason FROM orders")
def prj13(spark, d):
    cases = [(F.col("o_orderstatus") == "P", "blocked"), (F.col("o_totalprice") > 400000, "too_large"), (F.col("o_orderpriority").startswith("4"), "unspecified")]
    return table(spark, d, "orders").select("o_orderkey", P.first_case(cases, "none").alias("reason"))


MESSAGE = "CASE event_id % 7 WHEN 0 THEN concat('quota_exceeded for ', event_type) WHEN 1 THEN concat('HTTP ', CASE WHEN user_id % 2 = 0 THEN 403 ELSE 404 END, ' at ', user_id) WHEN 2 THEN concat(event_type, ': Captcha shown') WHEN 3 THEN concat('unexpected token in JSON at ', user_id) WHEN 4 THEN concat('лимит запросов ', user_id, ' исчерпан') WHEN 5 THEN concat('access denied to ', event_type) END"


@query("prj14_error_kinds", f"SELECT k, CASE WHEN t IS NULL THEN 'error' WHEN starts_with(t, 'quota_exceeded') OR t LIKE 'лимит%исчерпан' THEN 'quota_exceeded' WHEN contains(t, 'Captcha') OR contains(t, 'denied') OR contains(t, '403') AND starts_with(t, 'HTTP 403') THEN 'blocked' ELSE 'parser_changed' END AS kind FROM (SELECT event_id AS k, {MESSAGE} AS t FROM events)")
def prj14(spark, d):
    return written(spark, d, "events", "event_id", t=MESSAGE).select("k", P.error_kind(F.col("t")).alias("kind"))


@query("prj15_runnable_sites", "SELECT n_nationkey FROM nation WHERE n_name NOT IN ('NATION_3', 'NATION_9')")
def prj15(spark, d):
    blocked = spark.createDataFrame([("NATION_3",), ("NATION_9",)], "n_name string")
    return table(spark, d, "nation").join(F.broadcast(blocked), "n_name", "left_anti").select("n_nationkey")


@query("prj16_unsafe_urls", f"SELECT k, starts_with(t, 'http:') OR contains(t, '@') OR contains(t, ':8443/') AS unsafe FROM {LINKED}")
def prj16(spark, d):
    return written(spark, d, "part", "p_partkey", t=LINK).select("k", U.unsafe_url(F.col("t")).alias("unsafe"))


@query("prj17_retry_eligibility", "SELECT o_custkey, bool_and(o_orderstatus <> 'P') AND bool_or(o_orderstatus = 'F') AS eligible FROM orders GROUP BY 1")
def prj17(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg((F.bool_and(F.col("o_orderstatus") != "P") & F.bool_or(F.col("o_orderstatus") == "F")).alias("eligible"))


@query("prj18_narrow_candidates", "WITH f AS (SELECT p_brand, count(*) AS n, bool_or(p_type = 'PROMO') AS any_promo FROM part GROUP BY 1) SELECT p_partkey FROM part JOIN f USING (p_brand) WHERE n = 1 OR NOT any_promo OR p_type = 'PROMO'")
def prj18(spark, d):
    return P.narrow(table(spark, d, "part"), "p_brand", F.col("p_type") == "PROMO").select("p_partkey")


@query("prj20_own_metrics_only", f"WITH {OBS} SELECT domain, listing_id, month, CASE WHEN rating_count <= reviews THEN rating_count END AS own_count FROM obs")
def prj20(spark, d):
    return observations(spark, d).select("domain", "listing_id", "month", F.when(F.col("rating_count") <= F.col("reviews"), F.col("rating_count")).alias("own_count"))
