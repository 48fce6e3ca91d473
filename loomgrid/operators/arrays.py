"""Arrays in long form: (i, j, v) for two dimensions, (i, v) for one. Positions are columns, so results depend on no order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_vectors(df: DataFrame, row: str, vector: str) -> DataFrame:
    """(i, j, v) of a table of rows of vectors."""
    return df.select(F.col(row).alias("i"), F.posexplode(vector).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def to_vectors(x: DataFrame) -> DataFrame:
    """(i, v): the rows of an array in long form as vectors, in the order of j. A row's cells meet in one place."""
    return x.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("v"))


def column(x: DataFrame, j: int) -> DataFrame:
    return x.where(F.col("j") == j).select("i", "v")


def vector_columns(df: DataFrame, row: str, vector: str, *columns: int) -> DataFrame:
    """(i, v0, v1, ...): columns of a table of rows of vectors, without a join: they are aligned as they lie."""
    return df.select(F.col(row).alias("i"), *[F.element_at(vector, c + 1).cast("double").alias(f"v{k}") for k, c in enumerate(columns)])


def transposed(x: DataFrame) -> DataFrame:
    return x.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def added(x: DataFrame, y: DataFrame) -> DataFrame:
    """x + y of arrays of one shape: rows of a position are brought together by one aggregate, of both sides at once."""
    keys = [c for c in x.columns if c != "v"]
    return x.unionByName(y).groupBy(*keys).agg(F.sum("v").alias("v"))


def transpose_sum(x: DataFrame) -> DataFrame:
    """(x + x.T).sum()"""
    return added(x, transposed(x)).agg(F.sum("v").alias("v"))


def total(x: DataFrame) -> DataFrame:
    return x.agg(F.sum("v").alias("v"))


def mean(x: DataFrame) -> DataFrame:
    return x.agg(F.avg("v").alias("v"))


def every(x: DataFrame, step: int) -> DataFrame:
    """x[::step]: rows 0, step, ... under new numbers."""
    return x.where(F.col("i") % step == 0).withColumn("i", F.expr(f"i div {step}"))


def masked(x: DataFrame, y: DataFrame, above: float) -> DataFrame:
    """x[y > above] with the positions in x; its own order and length are what follows."""
    return x.join(y.where(F.col("v") > above).select("i"), "i", "left_semi")


def gathered(x: DataFrame, index: DataFrame) -> DataFrame:
    """x[index]: (i, v) in the order of index, (i, v) with v a position in x; positions may repeat."""
    return index.select(F.col("i").alias("k"), F.col("v").alias("i")).join(x, "i").select(F.col("k").alias("i"), "v")
