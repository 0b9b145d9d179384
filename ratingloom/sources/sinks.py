"""Writers: month snapshots, content-addressed evidence, publications that can be repeated."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where there is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what lies there is gone when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended: its folder is the cluster's to clean
        pass


def written_once(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table of the shared folder, for what reads them more than once; gone when the driver ends."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def replace_month(snapshot: DataFrame, path: str, month: str = "month") -> None:
    """Overwrites the months that the rows have; other months stay."""
    snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def replace_all(rows: DataFrame, path: str) -> None:
    """Overwrites all that is there."""
    rows.write.mode("overwrite").parquet(path)


def dump_json(rows: DataFrame, path: str, group: list[str], totals: dict[str, Column]) -> None:
    """Rows as JSON lines, and their totals by group beside them."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    rows.groupBy(*group).agg(*[c.alias(n) for n, c in totals.items()]).write.mode("overwrite").json(f"{path}/summary")


def add_evidence(payloads: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """Payloads not stored yet, one for each content hash."""
    hashed = payloads.withColumn("hash", F.sha2(F.to_json(F.struct(*columns)), 256)).dropDuplicates(["hash"])
    return hashed.join(stored.select("hash"), "hash", "left_anti")


def unexpired(evidence: DataFrame, stored_at: str, now: str, days: int = 90) -> DataFrame:
    return evidence.filter(F.col(stored_at) > F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {int(days)} DAYS"))


def payload_hash(rows: DataFrame, order: list[str]) -> str:
    """One hash of a table's content: of its rows' hashes, summed, so that no task sees them all."""
    text = F.to_json(F.struct(*rows.columns))
    low = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    high = F.conv(F.substring(F.sha2(text, 256), 13, 12), 16, 10).cast("decimal(38,0)")
    n, a, b = rows.agg(F.count("*"), F.sum(low), F.sum(high)).first()
    return f"{n}-{a or 0}-{b or 0}"


def publish(spark: SparkSession, report: DataFrame, path: str, sheet: str, month: str) -> bool:
    """Publishes a report as the next revision of its sheet and month; false if the latest one has this very content."""
    from .publications import Publications

    return Publications(spark, path).publish(report, sheet, month)[1]
