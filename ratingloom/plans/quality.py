"""Queries of the data-quality rules, over a run with seeded faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..registry import query
from .bindings import EXPECTED, PARTITIONS, RATING, expected, observations, partitions, rating, table

MONTH = "1998-06"

RUN = PARTITIONS + f""", {EXPECTED}, want AS (SELECT domain, brand FROM expected WHERE brand <> 'Brand#25'),
p0 AS (SELECT domain, brand, CASE WHEN discovered % 7 = 0 THEN 'error' WHEN collected = 0 AND discovered % 3 = 0 THEN 'no_results' ELSE 'complete' END AS status, CASE WHEN discovered % 10 = 4 THEN 0 ELSE discovered END AS discovered, collected FROM parts WHERE discovered % 13 <> 1),
p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p0 WHERE discovered % 11 = 5),
x AS (SELECT domain, brand FROM parts WHERE discovered % 14 = 0 UNION ALL SELECT domain, brand FROM parts WHERE discovered % 28 = 0 UNION ALL SELECT domain, brand FROM parts WHERE discovered % 17 = 3 UNION ALL SELECT 'stray.example', 'Brand#1'),
o AS (SELECT domain, CASE WHEN score_sum // 100 = 41 THEN '' ELSE listing_id END AS listing_id, brand, CASE WHEN (score_sum // 100) % 13 = 0 THEN NULL WHEN (score_sum // 100) % 10 < 6 THEN reviews ELSE 0 END AS reviews,
  CASE WHEN (score_sum // 100) % 10 < 7 AND (score_sum // 100) % 4 <> 0 THEN {RATING} END AS rating, CASE WHEN (score_sum // 100) % 10 < 6 THEN 'ok' WHEN (score_sum // 100) % 10 < 8 THEN 'no_reviews' WHEN (score_sum // 100) % 10 < 9 THEN 'not_found' ELSE 'blocked' END AS status,
  (score_sum // 100) % 2 = 0 AS historical, (score_sum // 100) % 4 = 0 AS rating_unavailable, (score_sum // 100) % 8 <> 0 AS has_raw_rating, CASE WHEN (score_sum // 100) % 16 = 4 THEN (score_sum // 100) % 3 END AS raw_rating FROM obs WHERE month = '{MONTH}'),
e AS (SELECT domain, brand, 'failed' AS message FROM parts WHERE discovered % 7 = 0 OR discovered % 19 = 2)
"""


def run(spark, d) -> Q.Run:
    parts = partitions(spark, d)
    pair = parts.select("domain", "brand", "discovered")
    status = F.when(F.col("discovered") % 7 == 0, "error").when((F.col("collected") == 0) & (F.col("discovered") % 3 == 0), "no_results").otherwise("complete")
    p0 = parts.filter("discovered % 13 <> 1").select("domain", "brand", status.alias("status"), F.when(F.col("discovered") % 10 == 4, 0).otherwise(F.col("discovered")).alias("discovered"), "collected")
    picked = lambda condition: pair.filter(condition).select("domain", "brand")
    exclusions = picked("discovered % 14 = 0").union(picked("discovered % 28 = 0")).union(picked("discovered % 17 = 3")).union(spark.createDataFrame([("stray.example", "Brand#1")], "domain string, brand string"))
    q = F.expr("score_sum div 100")
    obs = observations(spark, d, [MONTH])
    seen = obs.select(
        "domain", F.when(q == 41, "").otherwise(F.col("listing_id")).alias("listing_id"), "brand",
        F.when(q % 13 == 0, None).when(q % 10 < 6, F.col("reviews")).otherwise(0).alias("reviews"), F.when((q % 10 < 7) & (q % 4 != 0), rating()).alias("rating"),
        F.when(q % 10 < 6, "ok").when(q % 10 < 8, "no_reviews").when(q % 10 < 9, "not_found").otherwise("blocked").alias("status"),
        (q % 2 == 0).alias("historical"), (q % 4 == 0).alias("rating_unavailable"), (q % 8 != 0).alias("has_raw_rating"), F.when(q % 16 == 4, q % 3).alias("raw_rating"),
    )
    errors = pair.filter("discovered % 7 = 0 or discovered % 19 = 2").select("domain", "brand", F.lit("failed").alias("message"))
    return Q.Run(expected(spark, d).filter("brand <> 'Brand#25'"), p0.union(p0.filter("discovered % 11 = 5")), exclusions, seen, errors)


ANTI = "SELECT DISTINCT a.domain, a.brand FROM {a} a WHERE {where} NOT EXISTS (SELECT 1 FROM {b} b WHERE b.domain = a.domain AND b.brand = a.brand)"
SEMI = ANTI.replace("NOT EXISTS", "EXISTS")
RULES = {
    "qa01_duplicate_exclusion": (Q.duplicate_exclusion, "SELECT domain, brand FROM x GROUP BY 1, 2 HAVING count(*) > 1"),
    "qa02_exclusion_warning": (Q.exclusion_warning, "SELECT DISTINCT domain, brand FROM x"),
    "qa03_stray_exclusion": (Q.stray_exclusion, ANTI.format(a="x", where="", b="want")),
    "qa04_progress": (Q.progress, "SELECT w.n AS expected, r.n AS reported, r.n AS finished, w.n = r.n AS ok FROM (SELECT count(*) AS n FROM want) w, (SELECT count(*) AS n FROM p) r"),
    "qa05_unexpected_partition": (Q.unexpected_partition, ANTI.format(a="p", where="", b="want")),
    "qa06_duplicate_partition": (Q.duplicate_partition, "SELECT domain, brand FROM p GROUP BY 1, 2 HAVING count(*) > 1"),
    "qa07_excluded_but_successful": (Q.excluded_but_successful, SEMI.format(a="p", where="a.status <> 'error' AND", b="x")),
    "qa08_failed_not_excluded": (Q.failed_not_excluded, ANTI.format(a="p", where="a.status = 'error' AND", b="x")),
    "qa09_complete_without_cards": (Q.complete_without_cards, "SELECT DISTINCT domain, brand FROM p WHERE status = 'complete' AND discovered = 0"),
    "qa10_empty_with_counts": (Q.empty_with_counts, "SELECT DISTINCT domain, brand FROM p WHERE status = 'no_results' AND (discovered <> 0 OR collected <> 0)"),
    "qa11_missing_partition": (Q.missing_partition, ANTI.format(a="want", where="", b="p")),
    "qa12_broken_contract": (Q.broken_contract, "SELECT domain, listing_id FROM o WHERE listing_id = '' OR reviews < 0 OR rating NOT BETWEEN 0 AND 500"),
    "qa13_outside_request": (Q.outside_request, "SELECT a.domain, a.listing_id FROM o a WHERE NOT EXISTS (SELECT 1 FROM want b WHERE b.domain = a.domain AND b.brand = a.brand)"),
    "qa13_in_excluded_partition": (Q.in_excluded_partition, "SELECT a.domain, a.listing_id FROM o a WHERE EXISTS (SELECT 1 FROM x b WHERE b.domain = a.domain AND b.brand = a.brand)"),
    "qa14_duplicate_key": (Q.duplicate_key, "SELECT lower(domain) AS domain, listing_id FROM o GROUP BY 1, 2 HAVING count(*) > 1"),
    "qa15_unread_status": (Q.unread_status, "SELECT domain, listing_id, status FROM o WHERE status NOT IN ('ok', 'no_reviews', 'not_found')"),
    "qa16_wrong_zero": (Q.wrong_zero, "SELECT domain, listing_id FROM o WHERE status = 'no_reviews' AND (reviews IS DISTINCT FROM 0 OR rating IS NOT NULL)"),
    "qa17_incomplete_metrics": (Q.incomplete_metrics, "SELECT domain, listing_id FROM o WHERE status = 'ok' AND (coalesce(reviews, 0) <= 0 OR (rating IS NULL AND NOT rating_unavailable) OR (rating_unavailable AND (rating IS NOT NULL OR NOT has_raw_rating OR coalesce(raw_rating, 0) <> 0)))"),
    "qa18_rating_not_yet": (Q.rating_not_yet, "SELECT domain, listing_id FROM o WHERE status = 'ok' AND rating_unavailable"),
    "qa19_wrong_not_found": (Q.wrong_not_found, "SELECT domain, listing_id FROM o WHERE status = 'not_found' AND (NOT historical OR reviews IS NOT NULL OR rating IS NOT NULL)"),
    "qa20_count_mismatch": (Q.count_mismatch, "SELECT DISTINCT domain, brand, CASE WHEN status = 'complete' AND collected <> discovered THEN 'uncollected' WHEN status = 'complete' AND seen <> collected THEN 'snapshot' ELSE 'not_empty' END AS kind FROM (SELECT p.*, coalesce(s.n, 0) AS seen FROM p LEFT JOIN (SELECT domain, brand, count(*) AS n FROM o GROUP BY 1, 2) s ON s.domain = p.domain AND s.brand = p.brand) WHERE (status = 'complete' AND (collected <> discovered OR seen <> collected)) OR (status = 'no_results' AND seen <> 0)"),
    "qa21_unexplained_error": (Q.unexplained_error, "SELECT DISTINCT a.domain, a.brand, a.message FROM e a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.domain = a.domain AND b.brand = a.brand) AND NOT EXISTS (SELECT 1 FROM p b WHERE b.domain = a.domain AND b.brand = a.brand AND b.status = 'error')"),
}

for _name, (_rule, _sql) in RULES.items():
    query(_name, f"WITH {RUN} {_sql}")(lambda spark, d, rule=_rule: rule(run(spark, d)))


#: Each rule's own SQL, its columns joined.
ALL = {rule.__name__: sql for rule, sql in RULES.values() if rule.__name__ in Q.BLOCKERS} | {"progress": f"SELECT expected, reported, finished FROM ({RULES['qa04_progress'][1]}) WHERE NOT ok"}


@query("qa_all_blockers", f"WITH {RUN} " + " UNION ".join(f"SELECT '{name}' AS rule, concat_ws('/', *COLUMNS(*)) AS subject FROM ({sql})" for name, sql in ALL.items()))
def qa_all(spark, d):
    return Q.blockers(run(spark, d))


@query("qa22_import_checks", "SELECT c_custkey, concat_ws(',', CASE WHEN c_nationkey > 20 THEN 'brand' END, CASE WHEN c_acctbal < 0 THEN 'metrics' END, CASE WHEN c_custkey % 9 = 0 THEN 'url' END) AS problems FROM customer WHERE c_nationkey > 20 OR c_acctbal < 0 OR c_custkey % 9 = 0")
def qa22(spark, d):
    found = F.array_compact(F.array(F.when(F.col("c_nationkey") > 20, "brand"), F.when(F.col("c_acctbal") < 0, "metrics"), F.when(F.col("c_custkey") % 9 == 0, "url")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(found, ",").alias("problems")).filter("problems <> ''")


CELLS = "SELECT 'T' || o_orderkey % 3 AS tab, o_orderkey % 100 - CASE WHEN o_orderkey % 97 = 0 THEN 200 ELSE 0 END AS r, o_orderkey // 100 AS c, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 35 = 0 THEN '=1+1' ELSE o_orderstatus END END AS text, CASE WHEN o_orderkey % 5 <> 0 OR o_orderkey % 41 = 0 THEN o_totalprice END AS number, CASE WHEN o_orderkey % 23 = 0 THEN CASE WHEN o_orderkey % 46 = 0 THEN 'SUM(A1)' ELSE '=SUM(A1)' END END AS formula FROM orders"


@query("qa23_cell_problems", f"WITH k AS ({CELLS}), z AS (SELECT tab, r, c, CASE WHEN r < 0 OR c < 0 THEN 'place' WHEN text IS NOT NULL AND number IS NOT NULL THEN 'two_values' WHEN formula IS NOT NULL AND NOT starts_with(formula, '=') THEN 'formula' WHEN formula IS NULL AND regexp_matches(text, '^[=+@]') THEN 'injection' END AS kind FROM k) SELECT * FROM z WHERE kind IS NOT NULL UNION ALL SELECT tab, NULL, NULL, 'too_many' FROM k GROUP BY tab HAVING count(*) > 4900")
def qa23(spark, d):
    k = F.col("o_orderkey")
    cells = table(spark, d, "orders").select(
        F.concat(F.lit("T"), (k % 3).cast("string")).alias("tab"), (k % 100 - F.when(k % 97 == 0, 200).otherwise(0)).alias("r"), F.floor(k / 100).alias("c"),
        F.when(k % 35 == 0, "=1+1").when(k % 5 == 0, F.col("o_orderstatus")).alias("text"), F.when((k % 5 != 0) | (k % 41 == 0), F.col("o_totalprice")).alias("number"),
        F.when(k % 46 == 0, "SUM(A1)").when(k % 23 == 0, "=SUM(A1)").alias("formula"),
    )
    return Q.cell_problems(cells, 4900)
