"""Grouped aggregates with tunable fan-in and fan-out. Rows with a null key are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def max_count_mean(df: DataFrame, key: str, ints: str, floats: str, sort: bool = False, split_out: int | None = None, split_every: int | None = None) -> DataFrame:
    """(key, max and count of `ints`, mean of `floats`) of each key.

    sort: by key. split_out: partitions of the result; rows are then dealt by key after their partial aggregation.
    split_every: partial results meet in a tree, at most so many in one step, for keys that hold much of all rows."""
    df = df.where(F.col(key).isNotNull())
    names = [f"{ints}_max", f"{ints}_count", f"{floats}_mean"]
    if split_out is None and split_every is None:
        out = df.groupBy(key).agg(F.max(ints).alias(names[0]), F.count(ints).alias(names[1]), F.avg(floats).alias(names[2]))
        return out.orderBy(key) if sort else out
    if split_every is not None and split_every < 2:
        raise ValueError("at least two results must meet in a step")
    steps, part = df.rdd.getNumPartitions(), F.spark_partition_id()
    partial = df.groupBy(key, (part if split_every is None else F.floor(part / split_every)).alias("_step"))
    partial = partial.agg(F.max(ints).alias("_max"), F.count(ints).alias("_n"), F.sum(floats).alias("_sum"), F.count(floats).alias("_k"))
    while split_every is not None and (steps := -(-steps // split_every)) > split_every:
        partial = partial.groupBy(key, F.floor(F.col("_step") / split_every).alias("_step")).agg(F.max("_max").alias("_max"), F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"), F.sum("_k").alias("_k"))
    if split_out is not None:
        partial = partial.repartition(split_out, key)
    out = partial.groupBy(key).agg(F.max("_max").alias(names[0]), F.sum("_n").alias(names[1]), F.try_divide(F.sum("_sum"), F.sum("_k")).alias(names[2]))
    return out.orderBy(key) if sort else out


def column_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.sum(c).alias(c) for c in columns])


def result_bytes(df: DataFrame, widths: dict[str, int] | None = None) -> int:
    """Bytes of a result of fixed-width columns: rows times width, 8 where not told otherwise."""
    return df.count() * sum((widths or {}).get(c, 8) for c in df.columns)
