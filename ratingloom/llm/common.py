"""Shared pieces of the training-data operators: inputs, scratch tables, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a kernel works on at once; bounds the memory of its temporaries.
KERNEL_BYTES = 1 << 19


#: Bytes of an Arrow batch between Spark and a Python worker. Spark's own limit is ten thousand rows or 64 MB, of which both sides hold several at once.
BATCH_BYTES = 8 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by their bytes, so that long texts do not make large ones."""
    spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local one only where there is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


class Scratch:
    """Tables that cut lineage: Parquet below spark.checkpoint.dir, so they outlive lost executors.

    drop() removes a table as soon as nothing reads it any more; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.live: set[str] = set()
        atexit.register(self.close)

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("compression", codec).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        self.live.add(path)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            delete_path(self.spark, table._scratch_path)
            self.live.discard(table._scratch_path)

    def drop_others(self, *tables: DataFrame) -> None:
        """Removes all but these tables, once nothing else is read any more."""
        for path in self.live - {t._scratch_path for t in tables}:
            delete_path(self.spark, path)
            self.live.discard(path)

    def close(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # the session has ended: its folder is the cluster's to clean
            pass


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark itself resolves them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> bool:
    """Whether there was something to delete."""
    fs, p = hadoop_path(spark, path)
    return fs.delete(p, True)


#: What a Python worker keeps from one task to the next, by name. Workers outlive a stage, and so would a model that no later one reads.
WORKER: dict[str, object] = {}


def worker_model(name: str, make: Callable[[], object]) -> object:
    """A model that tasks of one kind share in a worker; the models of other kinds go."""
    if name not in WORKER:
        release_models()
        WORKER[name] = make()
    return WORKER[name]


def release_models(kept: str | None = None) -> None:
    """Gives back what the worker holds of other models."""
    gone = [name for name in WORKER if name != kept]
    for name in gone:
        del WORKER[name]
    if gone:
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: a worker that waits for its next task holds no more than it needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems give freed memory back by themselves, or not
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = KERNEL_BYTES, model: str | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `limit` bytes of text (one row at least), and their texts as UTF-8; null is empty. `model` names the worker_model() that is used."""
    release_models(model)
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            part = batch.slice(start, stop - start)
            yield part, [t or b"" for t in part.column(column).cast(pa.large_binary()).to_pylist()]
            start = stop
    give_back()


def map_texts(df: DataFrame, column: str, schema: str, kernel: Callable[[pa.RecordBatch, list[bytes]], dict], limit: int = KERNEL_BYTES, model: str | None = None) -> DataFrame:
    """Runs `kernel` over text chunks and returns the columns it makes, typed by `schema`."""

    def run(batches):
        target = None
        for batch, texts in text_chunks(batches, column, limit, model):
            made = kernel(batch, texts)
            if target is None:
                target = arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) if not isinstance(made[f.name], pa.Array) else made[f.name].cast(f.type) for f in target], schema=target)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


ARROW_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(name, ARROW_TYPES[kind]) for name, kind in (part.split() for part in schema.split(","))])


def vocabulary_file(name: str) -> str:
    """Place of a public tokenizer file: $TOKENIZER_DIR if set, else the installed package of such files."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
