"""Streams of activity and quota events, and the same results in batch."""

from __future__ import annotations

import atexit
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import remove_path


def open_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Event files as a stream, with event time that a watermark takes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def quota_buckets(events: DataFrame, minutes: int = 30, late: str | None = "2 hours") -> DataFrame:
    """Cents reserved in tumbling buckets; releases count back."""
    events = events.withWatermark("ts", late) if events.isStreaming and late else events
    cents = F.round(F.col("value") * 100).cast("long")
    signed = F.when(F.col("event_type") == "error", -cents).otherwise(cents)
    return events.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(F.sum(signed).alias("cents"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "cents", "n")


def quota_pairs(events: DataFrame, minutes: int = 30, cap: int = 450) -> DataFrame:
    """Each bucket with the one before it: what counts against the cap. An empty bucket counts nothing."""
    buckets = quota_buckets(events, minutes)
    before = buckets.select((F.col("start") + F.expr(f"INTERVAL {int(minutes)} MINUTES")).alias("start"), F.col("cents").alias("previous"))
    paired = buckets.join(before, "start", "left").withColumn("counted", F.col("cents") + F.coalesce("previous", F.lit(0)))
    return paired.select("start", "cents", "counted", (F.col("counted") > cap).alias("over"))


def stalled_sessions(events: DataFrame, key: str = "user_id", gap: str = "65 minutes", late: str | None = "2 hours") -> DataFrame:
    """Activity of a key without a pause of `gap`: a session's end is where it stalled."""
    events = events.withWatermark("ts", late) if events.isStreaming and late else events
    return events.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_imports(events: DataFrame, key: list[str], within: str = "30 minutes") -> DataFrame:
    """Events without replays; in a stream, replays within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)


def in_session(events: DataFrame, opened: str, minutes: int = 30, skew: int = 5) -> DataFrame:
    """Events of an import session: not before it opened nor after it closed, give or take the clocks' skew."""
    start = F.to_timestamp(F.lit(opened))
    return events.filter((F.col("ts") >= start - F.expr(f"INTERVAL {int(skew)} MINUTES")) & (F.col("ts") <= start + F.expr(f"INTERVAL {int(minutes + skew)} MINUTES")))


RUN_STATES = ("queued", "running", "review", "publishing", "published", "failed")


def run_states(events: DataFrame, key: str = "user_id", state: str = "event_type") -> DataFrame:
    """Latest state and number of changes of each run, kept over batches by a state machine that never goes back."""
    order = {s: i for i, s in enumerate(RUN_STATES)}

    def advance(keys: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        place, changes = held.get if held.exists else (-1, 0)
        for rows in batches:
            for value in rows.sort_values("ts")[state]:
                if order.get(value, -1) > place:
                    place, changes = order[value], changes + 1
        held.update((place, changes))
        yield pd.DataFrame({key: [keys[0]], "state": [RUN_STATES[place] if place >= 0 else None], "changes": [changes]})

    return events.groupBy(key).applyInPandasWithState(advance, f"{key} long, state string, changes long", "place int, changes long", "update", "NoTimeout")


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str, seconds: float | None = None) -> DataFrame:
    """Everything the stream gives for the input there is now, as a table; Parquet beside the checkpoint.

    A limit in seconds is an error when it passes, never a shorter table.
    """
    spark, root, written = stream.sparkSession, f"{checkpoint}-{name}", set()
    atexit.register(remove_path, spark, root)

    def write(batch: DataFrame, number: int) -> None:
        # A complete batch replaces the one before it; a batch that runs again replaces itself.
        path = root if mode == "complete" else f"{root}/{number}"
        batch.write.mode("overwrite").parquet(path)
        written.add(path)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if seconds is None:
            q.awaitTermination()
        elif not q.awaitTermination(seconds):
            raise TimeoutError(f"stream {name} has not come to its end in {seconds:g} s")
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(*sorted(written)) if written else spark.createDataFrame([], stream.schema)
