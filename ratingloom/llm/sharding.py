"""Shards of a growing dataset: small immutable arrivals, size-tiered compaction, versioned manifests.

Every change is a new manifest: a small table of the live shards (file, rows, bytes, the version that added it), written
in a folder of its own. What commits it is one small file, named by the version, that names the folder: it is written
aside and renamed without overwriting, which either happens whole or fails because another writer took that version. So
readers always see one complete version, and files never change once written. (A local file system checks and renames
in two steps; HDFS and stores with conditional writes do it in one.)

Compaction takes shards below FULL of the target size, tier by tier (a tier spans one factor of FANOUT in bytes), and
fills groups up to the target with neighbours in size; a group is merged if that makes a full shard, or if it has FANOUT
shards. So a row is rewritten once for each tier it climbs, and what is full is never rewritten. Each group is one task's
rows, under twice the target, so no key or source can make one task large.

Only DataFrame functions touch the rows. A round plans over the SHARDS_PER_ROUND smallest shards, which bounds what is
numbered in one place and broadcast; rounds follow each other until no group is full. Earlier versions stay readable
until vacuum().

Defined cases: null ids and texts, empty and very long texts and repeated rows are kept as they are, each row once;
an empty table adds a version without shards; all columns are kept whatever their names, but for
`_metadata`, which is refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, delete_path, hadoop_path

TARGET = 64 << 20
FANOUT = 4
ARRIVAL_ROWS = 2_000
#: Share of the target from which a shard is full.
FULL = 0.75
SHARDS_PER_ROUND = 500_000
#: Place of a shard below the store's root.
FILE = r"(data/[^/]+/[^/]+)$"
MANIFEST = "file string, n_rows long, n_bytes long, added long"


class VersionTaken(RuntimeError):
    """Another writer committed first; read the latest version and try again."""


def rename_once(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a file unless the target exists; tells whether it did."""
    from py4j.protocol import Py4JJavaError

    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    path = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri(), spark._jsc.hadoopConfiguration())
    fs, folder = hadoop_path(spark, target.rsplit("/", 1)[0])
    fs.mkdirs(folder)
    try:
        context.rename(path(source), path(target), options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT, arrival_rows: int = ARRIVAL_ROWS):
        self.spark, self.root, self.target, self.fanout, self.arrival_rows = spark, root.rstrip("/"), target, fanout, arrival_rows

    # Versions

    def versions(self) -> list[int]:
        fs, path = hadoop_path(self.spark, f"{self.root}/versions")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def place(self, version: int) -> str:
        return f"{self.root}/versions/v{version:012d}"

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live shards of a version, the latest one by default."""
        version = self.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        if version not in self.versions() or version <= self.vacuumed():
            raise ValueError(f"no version {version}, or one that has been vacuumed")
        return self.named(version)

    def named(self, version: int) -> DataFrame:
        folder = self.spark.read.text(self.place(version)).first()[0]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{folder}")

    def commit(self, shards: DataFrame, onto: int) -> int:
        """Makes `shards` version onto + 1, at once or not at all."""
        name = uuid.uuid4().hex
        folder, aside, final = f"manifests/{name}", f"{self.root}/aside/{name}", self.place(onto + 1)
        shards.select("file", F.col("n_rows").cast("long").alias("n_rows"), F.col("n_bytes").cast("long").alias("n_bytes"), F.col("added").cast("long").alias("added")).write.parquet(f"{self.root}/{folder}")
        fs, path = hadoop_path(self.spark, aside)
        out = fs.create(path, False)
        out.write(bytearray(folder.encode()))
        out.close()
        if not rename_once(self.spark, aside, final):
            fs.delete(path, False)
            fs.delete(hadoop_path(self.spark, f"{self.root}/{folder}")[1], True)
            raise VersionTaken(f"version {onto + 1} exists")
        return onto + 1

    def latest(self) -> int:
        return (self.versions() or [0])[-1]

    def files(self, version: int | None = None) -> list[str]:
        """Places of a version's shards: what a reader must name, one string for each file."""
        return [f"{self.root}/{r[0]}" for r in self.manifest(version).select("file").collect()]

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version; None while there are no shards."""
        files = self.files(version)
        return self.spark.read.parquet(*files) if files else None

    # Writing

    def describe(self, folder: str, added: int) -> DataFrame:
        """Manifest rows of the files in a folder, from their footers."""
        found = self.spark.read.parquet(f"{self.root}/{folder}").select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("n_bytes"))
        return found.groupBy("name", "n_bytes").agg(F.count("*").alias("n_rows")).select(F.concat(F.lit(f"{folder}/"), "name").alias("file"), "n_rows", "n_bytes", F.lit(added).cast("long").alias("added"))

    def append(self, rows: DataFrame) -> int:
        """Adds rows as small shards, written where their partitions are; commits a version."""
        if "_metadata" in (c.lower() for c in rows.columns):
            raise ValueError("a column may not be named _metadata: it would hide the files that rows lie in")
        onto = self.latest()
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", self.arrival_rows).parquet(f"{self.root}/{folder}")
        return self.commit(self.manifest(onto).union(self.describe(folder, onto + 1)), onto)

    def plan(self, version: int) -> DataFrame:
        """file and group of the shards that the next round merges."""
        small = self.manifest(version).filter(F.col("n_bytes") < FULL * self.target).orderBy("n_bytes", "file").limit(SHARDS_PER_ROUND)
        tier = F.floor(F.log(F.greatest(F.col("n_bytes"), F.lit(1)) / self.target) / F.log(F.lit(float(self.fanout))))
        in_size = Window.partitionBy("tier").orderBy("n_bytes", "file")
        before = F.coalesce(F.sum("n_bytes").over(in_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        grouped = small.withColumn("tier", tier).withColumn("run", F.floor(before / self.target))
        sums = grouped.groupBy("tier", "run").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("total"))
        worth = sums.filter((F.col("n") >= self.fanout) | ((F.col("n") > 1) & (F.col("total") >= FULL * self.target)))
        numbered = worth.withColumn("group", F.row_number().over(Window.orderBy("tier", "run")) - 1)
        return grouped.join(numbered, ["tier", "run"]).select("file", "n_bytes", "group")

    def compact(self) -> int:
        """Merges until no group is worth it; commits a version for each round and returns the last."""
        scratch = Scratch(self.spark, "compaction")
        while True:
            onto = self.latest()
            plan = scratch.keep(self.plan(onto), "plan")
            chosen = [f"{self.root}/{r[0]}" for r in plan.select("file").collect()]
            if not chosen:
                scratch.close()
                return onto
            groups = plan.agg(F.max("group") + 1).first()[0]
            folder = f"data/{uuid.uuid4().hex}"
            # The rows stay together in one column, so that no name of theirs can clash.
            placed = self.spark.read.parquet(*chosen).select(F.struct("*").alias("row"), F.regexp_extract("_metadata.file_path", FILE, 1).alias("file"))
            merged = placed.join(F.broadcast(plan.select("file", "group")), "file").repartitionById(int(groups), F.col("group"))
            merged.select("row.*").write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            kept = self.manifest(onto).join(plan.select("file"), "file", "left_anti").select("file", "n_rows", "n_bytes", "added")
            self.commit(kept.union(self.describe(folder, onto + 1)), onto)

    def folders(self, version: int) -> set[str]:
        return {r[0] for r in self.named(version).select(F.substring_index("file", "/", 2).alias("folder")).distinct().collect()}

    def vacuum(self) -> int:
        """Deletes folders that an earlier version names and the latest does not; earlier versions can then not be read. Returns how many.

        A folder that no version names yet may be a writer's between its write and its commit: it is left alone.
        """
        versions = self.versions()
        if not versions:
            return 0
        live, gone, before = self.folders(versions[-1]), 0, self.vacuumed()
        # First of all nobody may start to read them any more. Their names stay taken, so that no late writer commits behind the latest.
        fs, path = hadoop_path(self.spark, f"{self.root}/vacuumed")
        out = fs.create(path, True)
        out.write(bytearray(str(versions[-1] - 1).encode()))
        out.close()
        for version in versions[:-1]:
            if version > before:
                for folder in self.folders(version) - live:
                    gone += delete_path(self.spark, f"{self.root}/{folder}")
        return gone

    def vacuumed(self) -> int:
        """The last version that cannot be read any more."""
        fs, path = hadoop_path(self.spark, f"{self.root}/vacuumed")
        return int(self.spark.read.text(f"{self.root}/vacuumed").first()[0]) if fs.exists(path) else 0


def placements(store: ShardStore, id_column: str = "doc_id") -> DataFrame:
    """For every row of the latest version: id, version, shard, and the shard's rows, bytes and tier."""
    version = store.latest()
    shards = store.manifest(version)
    files = store.files(version)
    if not files:
        return store.spark.createDataFrame([], f"{id_column} long, version long, shard string, shard_rows long, shard_bytes long, added long")
    rows = store.spark.read.parquet(*files).select(id_column, F.regexp_extract("_metadata.file_path", FILE, 1).alias("file"))
    return rows.join(shards, "file").select(id_column, F.lit(version).cast("long").alias("version"), F.col("file").alias("shard"), F.col("n_rows").alias("shard_rows"), F.col("n_bytes").alias("shard_bytes"), "added")
