"""Queries of the stateful behaviours: streamed where the result is the same at every pace, in batch else."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import windows as W
from ..registry import query
from ..streaming import events as E
from ..streaming import activity as A
from ..sources.publications import Publications
from ..sources.sinks import scratch_path
from .bindings import table


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream(spark, d):
    return E.open_stream(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)


def folder(spark) -> str:
    return scratch_path(spark, "stream")


def seconds(column: str):
    return F.unix_timestamp(column).alias(column)


CENTS = "CASE WHEN event_type = 'error' THEN -CAST(round(value * 100) AS BIGINT) ELSE CAST(round(value * 100) AS BIGINT) END"
BUCKETS = f"b AS (SELECT CAST(floor(epoch(ts) / 1800) * 1800 AS BIGINT) AS start, CAST(sum({CENTS}) AS BIGINT) AS cents, count(*) AS n FROM events GROUP BY 1)"


@query("str01_latest_state", "SELECT user_id, arg_max(event_type, event_id) AS state, count(*) AS n FROM events GROUP BY 1")
def str01(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.count("*").alias("n"))


@query("str01_run_states", "SELECT user_id, CASE max(event_id % 8) FILTER (event_id % 8 < 6) WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'review' WHEN 3 THEN 'publishing' WHEN 4 THEN 'published' WHEN 5 THEN 'failed' END AS state FROM events GROUP BY 1")
def str01_machine(spark, d):
    """The state machine, streamed: a run never goes back, whatever order its events come in; words that are no state change nothing."""
    states = F.array(*map(F.lit, E.RUN_STATES))
    changes = stream(spark, d).select("user_id", "ts", F.coalesce(F.get(states, (F.col("event_id") % 8).cast("int")), F.lit("noise")).alias("event_type"))
    told = E.run_to_end(E.run_states(changes), f"runs_{uuid.uuid4().hex}", "update", folder(spark))
    return told.groupBy("user_id").agg(F.max_by("state", "changes").alias("state"))


@query("str02_pending_after_checkpoint", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def str02(spark, d):
    done = events(spark, d).filter("event_type = 'purchase'").select("event_id")
    return events(spark, d).select("event_id").join(done, "event_id", "left_anti")


@query("str03_activity_trace", "WITH s AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2) SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'warning' ELSE 'done' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM s) WHERE n <= 64")
def str03(spark, d):
    last = events(spark, d).groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    return W.last_n(last, ["user_id"], ["event_id"], 64).select("user_id", "event_id", F.when(F.col("event_type") == "error", "warning").otherwise("done").alias("status"))


@query("str04_stalled_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3900000000 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def str04(spark, d):
    return E.stalled_sessions(events(spark, d)).select("user_id", seconds("start"), "n")


@query("str05_quota_buckets", f"WITH {BUCKETS} SELECT start, cents, n FROM b")
def str05(spark, d):
    """Streamed in full: the complete table after the last file."""
    done = E.run_to_end(E.quota_buckets(stream(spark, d), late=None), f"quota_{uuid.uuid4().hex}", "complete", folder(spark))
    return done.select(seconds("start"), "cents", "n")


@query("str05_quota_pairs", f"WITH {BUCKETS} SELECT b.start, b.cents, b.cents + coalesce(p.cents, 0) AS counted, b.cents + coalesce(p.cents, 0) > 45000 AS over FROM b LEFT JOIN b p ON p.start = b.start - 1800")
def str05_pairs(spark, d):
    return E.quota_pairs(events(spark, d), cap=45_000).select(seconds("start"), "cents", "counted", "over")


@query("str06_lease_slots", "SELECT event_id, CAST(floor(epoch(ts) / 600) AS BIGINT) AS slot, CAST(floor(epoch(ts) / 600) AS BIGINT) - 1 AS adjacent FROM events")
def str06(spark, d):
    slot = F.floor(F.unix_timestamp("ts") / 600)
    return events(spark, d).select("event_id", slot.alias("slot"), (slot - 1).alias("adjacent"))


@query("str07_unexpired_evidence", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def str07(spark, d):
    from ..sources.sinks import unexpired

    return unexpired(events(spark, d), "ts", "2024-04-19 00:00:00", 90).select("event_id")


@query("str08_imports_without_replays", "SELECT DISTINCT event_id, user_id FROM events")
def str08(spark, d):
    """Every event streamed twice, the second time as a replay within the watermark."""
    seen = stream(spark, d).select("event_id", "user_id", "ts")
    replayed = seen.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return E.run_to_end(E.first_imports(replayed, ["event_id"]), f"imports_{uuid.uuid4().hex}", "append", folder(spark)).select("event_id", "user_id")


@query("str08_import_window", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 09:55:00' AND TIMESTAMP '2024-01-10 10:35:00'")
def str08_window(spark, d):
    return E.in_session(events(spark, d), "2024-01-10 10:00:00").select("event_id")


@query("str09_publications", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT props) AS published FROM events GROUP BY 1, 2")
def str09(spark, d):
    return events(spark, d).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("props").alias("published"))


@query("str03_activity_pairs", """WITH e AS (SELECT user_id AS run, event_id AS activity, event_type, epoch_us(ts) AS us FROM events),
  w AS (SELECT max(CASE WHEN event_type IN ('error', 'signup') THEN us ELSE us + 300000000 END) // 1000 - 7200000 AS mark FROM e),
  s AS (SELECT run, activity, us, CASE WHEN event_type <> 'error' THEN us + 300000000 END AS finish, (SELECT min(x.us) FROM e x WHERE x.run = e.run AND x.event_type = 'signup' AND x.us >= e.us) AS ending, us + 3900000000 AS silence FROM e WHERE event_type <> 'signup'),
  o AS (SELECT *, least(coalesce(finish, silence), coalesce(ending, silence), silence) AS finished FROM s)
  SELECT run, activity, us AS started, finished, CASE finished WHEN finish THEN 'complete' WHEN ending THEN 'interrupted' ELSE 'stalled' END AS status FROM o, w WHERE (finished + 999) // 1000 <= mark""")
def str03_pairs(spark, d):
    """Every event starts an activity of five minutes, errors never finish, and a signup ends its user's run; streamed."""
    before = A.use_rocks(spark)
    try:
        e = stream(spark, d).select(F.col("user_id").alias("run"), F.col("event_id").alias("activity"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
        mark = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"))
        start, finish, end = mark(A.START, F.col("ts")), mark(A.FINISH, F.col("ts") + F.expr("INTERVAL 5 MINUTES")), mark(A.END, F.col("ts"))
        marks = F.when(F.col("event_type") == "signup", F.array(end)).when(F.col("event_type") == "error", F.array(start)).otherwise(F.array(start, finish))
        rows = e.select("run", "activity", F.inline(marks))
        return E.run_to_end(A.activity_pairs(rows), f"activity_{uuid.uuid4().hex}", "append", folder(spark))
    finally:
        if before is None:
            spark.conf.unset(A.PROVIDER)
        else:
            spark.conf.set(A.PROVIDER, before)


@query("str03_last_activities", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 64")
def str03_ring(spark, d):
    """The 64 last activities of each run, every one of its events being one."""
    return W.last_n(events(spark, d).select("user_id", "event_id"), ["user_id"], ["event_id"], 64).select("user_id", "event_id")


@query("str09_published_once", "SELECT 1 AS number, count(*) AS n, 3 AS attempts FROM events")
def str09_once(spark, d):
    """A streamed report, published three times as a batch that runs again is: once in full, then as what it is already."""
    made = Publications(spark, folder(spark), "stream")
    attempts = []
    for _ in range(3):
        counted = E.run_to_end(E.quota_buckets(stream(spark, d), late=None), f"quota_{uuid.uuid4().hex}", "complete", folder(spark))
        attempts.append(made.publish(counted.select(seconds("start"), "cents", "n"), "quota", "2024-01"))
    if [new for _, new in attempts] != [True, False, False]:
        raise RuntimeError("a content was published twice")
    return made.history().join(made.read("quota", "2024-01").agg(F.sum("n").alias("n"))).select(F.col("number").cast("int").alias("number"), "n", F.lit(len(attempts)).alias("attempts"))
