"""Tables kept by the hash of a key, so that joins and groups on that key move no rows.

A table is dealt once to `buckets` files, sorted by the key, and registered in the session's catalogue with that layout.
Two tables with equal keys and numbers of buckets are then joined bucket by bucket: no exchange, and as each bucket is
one sorted file, no sort that has to read ahead. A group by the key above such a join moves nothing either.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bucketed:
    """A table of the catalogue with its layout."""

    name: str
    key: str
    buckets: int
    path: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)

    def dropped(self, spark: SparkSession) -> None:
        """Removes the table and its files."""
        spark.sql(f"drop table if exists {self.name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str, buckets: int, folder: str, name: str | None = None) -> Bucketed:
    """Writes a table by the hash of its key to a folder that all executors share.

    Each bucket is one file: rows are dealt by the hash that the layout has, so no task writes several. A key with much of
    all rows makes its bucket large: give more columns' hash as the key, or join such keys another way."""
    if buckets < 1:
        raise ValueError("there must be a bucket")
    name = name or f"bucketed_{uuid.uuid4().hex}"
    path = f"{folder.rstrip('/')}/{name}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return Bucketed(name, key, buckets, path)


def joined(spark: SparkSession, left: Bucketed, right: Bucketed, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The inner join of two tables with one layout, without an exchange; finish: what is made of it, such as groups by the key.

    Nulls match nothing. Column names that both have, but for the key, get _x and _y."""
    if (left.key, left.buckets) != (right.key, right.buckets):
        raise ValueError(f"the layouts differ: {left.buckets} by {left.key}, {right.buckets} by {right.key}")
    a, b = left.rows(spark), right.rows(spark)
    both = (set(a.columns) & set(b.columns)) - {left.key}
    named = lambda df, suffix: df.select(*[F.col(c).alias(c + suffix if c in both else c) for c in df.columns])
    out = named(a, "_x").join(named(b, "_y").hint("merge"), left.key)
    return finish(out) if finish else out
