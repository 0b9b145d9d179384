"""Captured pages as a data source of Spark's: spark.read.format("captured_pages") and spark.readStream.

A connector of a site is then a filter on `domain` that reaches the files: folders `domain=...` of other sites are no
partitions at all, and row groups whose statistics rule a page out are not read. A partition is one row group of one
file, so a site with many captures is many tasks. A stream reads files in the order of their arrival, each once.

Filters are pushed down where spark.sql.python.filterPushdown.enabled is on (see register()).
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = pa.schema([("page_id", pa.int64()), ("domain", pa.string()), ("url", pa.string()), ("html", pa.string())])
COMPARED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
SITE = re.compile(r"(?:^|/)domain=([^/]+)/")


@dataclass
class RowGroup(InputPartition):
    path: str
    group: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def files_below(path: str) -> list[fs.FileInfo]:
    """Parquet files of a folder, by arrival; a file is its own."""
    system, place = opened(path)
    info = system.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
    hidden = lambda name: any(p.startswith(("_", ".")) for p in posixpath.relpath(name, place).split("/")) and name != place
    files = [f for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet") and not hidden(f.path)]
    return sorted(files, key=lambda f: (f.mtime_ns or 0, f.path))


def site_of(path: str) -> str | None:
    """The site whose folder a file lies in."""
    found = SITE.search(path)
    return found[1] if found else None


def tested(filter_: Filter, values: pa.Array | pa.ChunkedArray):
    if isinstance(filter_, IsNotNull):
        return pc.is_valid(values)
    if isinstance(filter_, In):
        return pc.is_in(values, value_set=pa.array(list(filter_.value), values.type))
    return COMPARED[type(filter_)](values, pa.scalar(filter_.value, values.type))


def pages_of(path: str, group: int, filters: list[Filter], base: str) -> Iterator[pa.RecordBatch]:
    """Rows of one row group that pass all filters. The domain is the folder's, or that of the address."""
    system, _ = opened(base)
    with system.open_input_file(path) as source:
        file = pq.ParquetFile(source)
        have = set(file.schema_arrow.names)
        read = lambda columns: file.read_row_group(group, columns=[c for c in columns if c in have])
        keys = read(["page_id", "url", "domain"])
        if "domain" not in have:
            host = pc.struct_field(pc.extract_regex(pc.utf8_lower(keys["url"]), r"^[a-z]+://(?:www\.)?(?P<host>[^/?#:]+)"), "host")
            site = site_of(path)
            keys = keys.append_column("domain", pa.chunked_array([pa.array([site] * keys.num_rows, pa.string())]) if site else host)
        keep = None
        for f in filters:
            passed = pc.fill_null(tested(f, keys[f.attribute[0]]), False)
            keep = passed if keep is None else pc.and_(keep, passed)
        if keep is not None and not pc.any(keep).as_py():
            return  # the pages themselves are not read
        table = keys.append_column("html", read(["html"])["html"]) if "html" in have else keys.append_column("html", pa.nulls(keys.num_rows, pa.string()))
        table = table.filter(keep) if keep is not None else table
        yield from table.select(SCHEMA.names).cast(SCHEMA).to_batches()


class CapturedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.filters = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802, Spark's name
        for f in filters:
            if type(f) in (*COMPARED, In, IsNotNull) and f.attribute in (("domain",), ("page_id",), ("url",)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        sites = [f for f in self.filters if f.attribute == ("domain",)]
        system, _ = opened(self.path)
        out = []
        for info in files_below(self.path):
            site = site_of(info.path)
            if site is not None and not all(tested(f, pa.array([site]))[0].as_py() for f in sites):
                continue
            with system.open_input_file(info.path) as source:
                meta = pq.ParquetFile(source).metadata
            out += [RowGroup(info.path, g) for g in range(meta.num_row_groups) if self.possible(meta.row_group(g))]
        return out

    def possible(self, group: pq.RowGroupMetaData) -> bool:
        """Whether the least and greatest page_id of a row group let it have rows that pass."""
        for i in range(group.num_columns):
            column = group.column(i)
            if column.path_in_schema != "page_id" or column.statistics is None or not column.statistics.has_min_max:
                continue
            low, high = column.statistics.min, column.statistics.max
            for f in self.filters:
                if f.attribute != ("page_id",) or isinstance(f, IsNotNull):
                    continue
                wanted = list(f.value) if isinstance(f, In) else [f.value]
                inside = any(low <= v <= high for v in wanted)
                beyond = {GreaterThan: high > wanted[0], GreaterThanOrEqual: high >= wanted[0], LessThan: low < wanted[0], LessThanOrEqual: low <= wanted[0]}
                if not beyond.get(type(f), inside):
                    return False
        return True

    def read(self, partition: RowGroup | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from pages_of(partition.path, partition.group, self.filters, self.path)


class CapturedStream(DataSourceStreamReader):
    """Offsets are (time, name) of the last file read."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = files_below(self.path)
        return {"time": files[-1].mtime_ns or 0, "name": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = (start["time"], start["name"]), (end["time"], end["name"])
        system, _ = opened(self.path)
        out = []
        for info in files_below(self.path):
            if first < (info.mtime_ns or 0, info.path) <= last:
                with system.open_input_file(info.path) as source:
                    out += [RowGroup(info.path, g) for g in range(pq.ParquetFile(source).num_row_groups)]
        return out

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        yield from pages_of(partition.path, partition.group, [], self.path)


class CapturedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        return "page_id bigint, domain string, url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return CapturedReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return CapturedStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CapturedPages)
