"""Queries of routed and budgeted sources, over the events: a user is a site, an error a failed attempt."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admission as A
from ..registry import query
from .bindings import table


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


ATTEMPTS = "a AS (SELECT event_id, user_id, ts, event_type NOT IN ('error', 'signup') AS ok FROM events), g AS (SELECT *, row_number() OVER w AS k, max(CASE WHEN ok THEN 1 ELSE 0 END * row_k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS good FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_k FROM a) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
ROUTES = f"WITH {ATTEMPTS}, r AS (SELECT event_id, user_id, k - 1 - coalesce(good, 0) AS failures FROM g)"


def attempts(spark, d):
    return events(spark, d).select("event_id", "user_id", "ts", (~F.col("event_type").isin("error", "signup")).alias("ok"))


@query("src04_circuit_breaker", f"{ROUTES} SELECT event_id, failures, CASE WHEN failures >= 2 THEN 'fallback' ELSE 'primary' END AS source FROM r")
def src04(spark, d):
    """Attempts that go to the fallback as the two before them have failed."""
    return A.circuit_breaker(attempts(spark, d), "user_id", ["ts", "event_id"], "ok", after=2, seconds=86_400 * 7).select("event_id", "failures", "source")


@query("src04_rebound_listings", f"""{ROUTES}, l AS (SELECT user_id, arg_max(CASE WHEN failures >= 2 THEN 'fallback' ELSE 'primary' END, event_id) AS source FROM r GROUP BY 1)
  SELECT o_custkey, o_orderkey, l.source, CASE WHEN l.source = 'primary' THEN o_orderkey % 50 WHEN o_orderkey % 3 <> 0 THEN 100 END AS reviews, CASE WHEN l.source = 'primary' OR o_orderkey % 3 <> 0 THEN 'ok' ELSE 'parser_changed' END AS status FROM orders JOIN l ON l.user_id = o_custkey""")
def src04_rebound(spark, d):
    """Listings by the last route of their site; the fallback lacks every third listing."""
    routed = A.circuit_breaker(attempts(spark, d), "user_id", ["ts", "event_id"], "ok", after=2).groupBy("user_id").agg(F.max_by("source", "event_id").alias("source"))
    orders = table(spark, d, "orders")
    primary = orders.select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 50).alias("reviews"), F.lit("ok").alias("status"))
    fallback = orders.filter("o_orderkey % 3 <> 0").select("o_custkey", "o_orderkey", F.lit(100).cast("long").alias("reviews"), F.lit("ok").alias("status"))
    return A.rebound(primary, fallback, routed.withColumnRenamed("user_id", "o_custkey"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "source", "reviews", "status")


@query("src05_budgeted_calls", """WITH RECURSIVE c AS (SELECT event_id, user_id, CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 'reserve' WHEN event_type = 'error' THEN 'release' ELSE 'other' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  t AS (SELECT event_id, user_id, kind, k, 0 AS used FROM c WHERE k = 1 UNION ALL
        SELECT c.event_id, c.user_id, c.kind, c.k, CASE t.kind WHEN 'reserve' THEN least(5, t.used + 1) WHEN 'release' THEN greatest(0, t.used - 1) ELSE t.used END FROM t JOIN c ON c.user_id = t.user_id AND c.k = t.k + 1)
  SELECT event_id, kind, CAST(used AS BIGINT) AS used, kind <> 'reserve' OR used < 5 AS admitted FROM t""")
def src05(spark, d):
    """Reservations of each user while five slots last; a release frees one."""
    kind = F.when(F.col("event_type").isin("purchase", "click", "view"), "reserve").when(F.col("event_type") == "error", "release").otherwise("other")
    calls = events(spark, d).select("event_id", "user_id", "ts", kind.alias("kind"))
    return A.budgeted(calls, "user_id", ["ts", "event_id"], "kind", 5, seconds=86_400 * 7).select("event_id", "kind", "used", "admitted")
