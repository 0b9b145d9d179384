"""Reports published by several writers: numbered revisions of each sheet and month, each taken by one writer only.

A report is written aside, its content's hash gathered in the same pass, and read back. What publishes it is one small
file named by the next revision, written under another name and renamed without overwriting: that happens whole or not at
all, and of two writers one finds the revision taken. A rename whose answer got lost is settled by reading the revision:
it is ours if it holds our mark. A content that is the latest one already is not published again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class RevisionTaken(RuntimeError):
    """Another writer has published onto the revision that this report was made for."""


@dataclass(frozen=True)
class Revision:
    sheet: str
    month: str
    number: int
    hash: str
    place: str
    writer: str


def content(columns: list[str]) -> list[Column]:
    """Count and two sums of the rows' hashes: one content whatever the order of rows."""
    text = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)])), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(text, at, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return [F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(13).alias("b")]


class Publications:
    def __init__(self, spark: SparkSession, path: str, writer: str | None = None):
        self.spark, self.path, self.writer = spark, path.rstrip("/"), writer or uuid.uuid4().hex

    # Files

    def at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def put(self, path: str, text: str) -> None:
        fs, p = self.at(path)
        out = fs.create(p, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def get(self, path: str) -> str:
        fs, p = self.at(path)
        source = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def rename_once(self, source: str, target: str) -> None:
        """Renames a file; FileAlreadyExistsException if the target is there."""
        jvm = self.spark._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        fs, folder = self.at(target.rsplit("/", 1)[0])
        fs.mkdirs(folder)
        path = jvm.org.apache.hadoop.fs.Path
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri(), self.spark._jsc.hadoopConfiguration()).rename(path(source), path(target), options)

    # Revisions

    def folder(self, sheet: str, month: str) -> str:
        return f"{self.path}/commits/{quote(sheet, safe='')}/{quote(month, safe='')}"

    def numbers(self, sheet: str, month: str) -> list[int]:
        fs, p = self.at(self.folder(sheet, month))
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def revision(self, sheet: str, month: str, number: int | None = None) -> Revision | None:
        """A revision, the latest by default; None if there is none."""
        numbers = self.numbers(sheet, month)
        if not numbers or (number is not None and number not in numbers):
            return None
        return Revision(**json.loads(self.get(f"{self.folder(sheet, month)}/{numbers[-1] if number is None else number:09d}")))

    def read(self, sheet: str, month: str, number: int | None = None) -> DataFrame | None:
        found = self.revision(sheet, month, number)
        return self.spark.read.parquet(f"{self.path}/{found.place}") if found else None

    def history(self) -> DataFrame:
        """Every revision of every sheet and month."""
        schema = "sheet string, month string, number long, hash string, place string, writer string"
        fs, p = self.at(f"{self.path}/commits")
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").json(f"{self.path}/commits") if fs.exists(p) else self.spark.createDataFrame([], schema)

    def publish(self, report: DataFrame, sheet: str, month: str, onto: int | None = None) -> tuple[Revision, bool]:
        """The revision that has this content, and whether it was published now.

        `onto` is the revision that the report was made for (0: none); if another one has come since, nothing is
        published and RevisionTaken is raised, unless that one has this very content.
        """
        place = f"reports/{quote(sheet, safe='')}/{quote(month, safe='')}/{uuid.uuid4().hex}"
        seen = Observation()
        report.observe(seen, *content(report.columns)).write.parquet(f"{self.path}/{place}")
        mark = "-".join(str(seen.get[k]) for k in ("n", "a", "b"))
        back = self.spark.read.schema(report.schema).parquet(f"{self.path}/{place}").agg(*content(report.columns)).first()
        if "-".join(map(str, back)) != mark:
            self.drop(place)
            raise RuntimeError("the report reads back differently")
        latest = self.revision(sheet, month)
        if latest and latest.hash == mark:
            self.drop(place)
            return latest, False
        number = (latest.number if latest else 0) if onto is None else onto
        if (latest.number if latest else 0) != number:
            self.drop(place)
            raise RevisionTaken(f"revision {latest.number if latest else 0} of {sheet}, {month} is not {number}")
        ours = Revision(sheet, month, number + 1, mark, place, f"{self.writer}:{uuid.uuid4().hex}")
        if self.commit(ours):
            return ours, True
        self.drop(place)
        taken = self.revision(sheet, month, number + 1)
        if taken and taken.hash == mark:  # another writer had the same to say
            return taken, False
        raise RevisionTaken(f"revision {number + 1} of {sheet}, {month} is another writer's")

    def commit(self, ours: Revision) -> bool:
        """Takes the revision's name; false if it is taken. After any failure the revision itself tells whose it is."""
        aside, final = f"{self.path}/aside/{uuid.uuid4().hex}", f"{self.folder(ours.sheet, ours.month)}/{ours.number:09d}"
        self.put(aside, json.dumps(ours.__dict__))
        try:
            self.rename_once(aside, final)
            return True
        except Py4JJavaError:
            found = self.revision(ours.sheet, ours.month, ours.number)
            if found is None:
                raise
            return found.writer == ours.writer

    def drop(self, place: str) -> None:
        fs, p = self.at(f"{self.path}/{place}")
        fs.delete(p, True)
