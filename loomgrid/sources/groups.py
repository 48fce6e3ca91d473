"""A source with a partition for each item: here each row group of the Parquet files right in a folder.

spark.read.format("row_groups") after register(spark). Only the columns of the schema that is asked for are read; filters
that Spark pushes down leave out row groups whose statistics tell that they hold no such row (Spark still applies the
filters itself). Options: path; files (only the first so many, by name). Paths are opened by pyarrow's file systems."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: Whether a group with these least and greatest values can hold a row that passes.
CAN_HOLD = {
    EqualTo: lambda low, high, v: low <= v <= high,
    GreaterThan: lambda low, high, v: high > v,
    GreaterThanOrEqual: lambda low, high, v: high >= v,
    LessThan: lambda low, high, v: low < v,
    LessThanOrEqual: lambda low, high, v: low <= v,
    In: lambda low, high, v: any(low <= x <= high for x in v if x is not None),
}


@dataclass(frozen=True)
class Group(InputPartition):
    path: str
    number: int

    def __init__(self, path: str, number: int):
        object.__setattr__(self, "path", path)
        object.__setattr__(self, "number", number)
        object.__setattr__(self, "value", number)


def files(path: str, most: int | None = None) -> tuple[fs.FileSystem, list[str]]:
    """The *.parquet files right in a folder, or a file alone."""
    store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    if store.get_file_info(at).type == fs.FileType.File:
        return store, [at]
    found = [x.path for x in store.get_file_info(fs.FileSelector(at.rstrip("/"))) if x.type == fs.FileType.File and x.path.endswith(".parquet")]
    return store, sorted(found)[:most]


class RowGroups(DataSource):
    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def _files(self) -> list[str]:
        return files(self.options["path"], int(self.options["files"]) if "files" in self.options else None)[1]

    def schema(self) -> StructType:
        store, found = files(self.options["path"])
        if not found:
            raise ValueError(f"no Parquet files in {self.options['path']}")
        with store.open_input_file(found[0]) as f:
            return from_arrow_schema(pq.read_schema(f))

    def reader(self, schema: StructType) -> RowGroupReader:
        return RowGroupReader(self.options["path"], self._files(), schema)


class RowGroupReader(DataSourceReader):
    def __init__(self, path: str, found: list[str], schema: StructType):
        self.path, self.found, self.names = path, found, schema.names
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in CAN_HOLD and len(f.attribute) == 1:
                self.filters.append(f)
            yield f

    def _can_hold(self, group: pq.RowGroupMetaData) -> bool:
        columns = {group.column(k).path_in_schema: group.column(k).statistics for k in range(group.num_columns)}
        for f in self.filters:
            stats = columns.get(f.attribute[0])
            if stats is not None and stats.has_min_max:
                try:
                    if not CAN_HOLD[type(f)](stats.min, stats.max, f.value):
                        return False
                except TypeError:  # values of a kind that the statistics don't compare with
                    pass
        return True

    def partitions(self) -> list[Group]:
        store, out = files(self.path)[0], []
        for path in self.found:
            with store.open_input_file(path) as f:
                meta = pq.ParquetFile(f).metadata
                out += [Group(path, k) for k in range(meta.num_row_groups) if self._can_hold(meta.row_group(k))]
        return out

    def read(self, partition: Group):
        if not isinstance(partition, Group):  # nothing to read
            return
        with files(self.path)[0].open_input_file(partition.path) as f:
            yield from pq.ParquetFile(f).iter_batches(row_groups=[partition.number], columns=self.names)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RowGroups)


def row_groups(spark: SparkSession, path: str, *columns: str, first: int | None = None) -> DataFrame:
    """The files' rows, a partition for each row group; columns: only these are read."""
    register(spark)
    reader = spark.read.format(RowGroups.name()).option("path", path)
    if first is not None:
        reader = reader.option("files", first)
    if columns:
        whole = RowGroups({"path": path}).schema()
        reader = reader.schema(StructType([whole[c] for c in columns]))
    return reader.load()
