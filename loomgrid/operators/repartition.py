"""Moving rows: by hash, by range, to a partition by number, and all to all. Partition counts are always explicit, so AQE keeps them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType, VariantType


def hash_shuffled(df: DataFrame, column: str, parts: int) -> DataFrame:
    """Each value of the column in one of exactly `parts` partitions."""
    if parts < 1:
        raise ValueError("there must be a partition")
    return df.repartition(parts, column)


def range_sorted(df: DataFrame, column: str, parts: int) -> DataFrame:
    """Sorted by the column over all partitions in order."""
    return df.repartitionByRange(parts, column).sortWithinPartitions(column)


def dealt_by_id(df: DataFrame, id_column: str, parts: int) -> DataFrame:
    """Rows with id k in partition k, for ids from 0 to parts - 1."""
    return df.repartitionById(parts, F.col(id_column).cast("int"))


def partition_numbers(df: DataFrame, name: str = "part") -> DataFrame:
    return df.withColumn(name, F.spark_partition_id())


def salted(df: DataFrame, column: str, salts: int, parts: int, salt: Column | None = None) -> DataFrame:
    """As hash_shuffled(), but each value in up to `salts` partitions: for values that hold much of all rows."""
    return df.repartition(parts, F.col(column), F.pmod(salt if salt is not None else F.xxhash64(*df.columns), F.lit(salts)))


def all_to_all(items: DataFrame, source: str, workers: int) -> DataFrame:
    """(to, from, item): each source's number of rows, at each of `workers` partitions: one small item from every source to every worker."""
    counted = items.groupBy(F.col(source).alias("from")).agg(F.count("*").alias("item"))
    sent = counted.select(F.explode(F.sequence(F.lit(0), F.lit(workers - 1))).alias("to"), "from", "item")
    return sent.repartitionById(workers, "to").withColumn("to", F.col("to").cast("long"))


def row_bytes(df: DataFrame) -> Column:
    """Bytes of each row in memory, about: a word for each column and for the null bits, and what texts and nested values hold."""
    size = F.lit(8 * (len(df.columns) + 1)).cast("long")
    for field in df.schema:
        own = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            size += F.coalesce(F.octet_length(own), F.lit(0))
        elif isinstance(field.dataType, (ArrayType, MapType, StructType, VariantType)):
            size += F.coalesce(4 * F.octet_length(own.cast("string")), F.lit(0))
    return size


def held(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes of all rows in memory). Rows of fixed width are only counted, which Parquet's own counts answer."""
    rows, size = df.agg(F.count("*"), F.sum(row_bytes(df))).first()
    return rows, size or 0


def item_bytes(rows: int, columns: int, width: int = 8, index: bool = False) -> int:
    """Bytes that count as moved: rows of fixed-width columns, with the row labels or without."""
    return rows * width * (columns + index)
