"""Known divisions: boundaries of a key as data, by which rows are dealt to partitions, numbered, stored and looked up.

Division k holds the keys from boundary k - 1 up to, but not with, boundary k. Boundaries are given, or the weighted
quantiles of a sample of rows. A key's partition is found by binary search among them, natively; so what follows
(moving rows, counting them, reading them back) agrees on it without sampling again. Keys may have several columns;
nulls come first, NaN last.

A division whose rows are too many for a task is a run of partitions: more boundaries are sampled within it, and rows of
one key that fill several partitions are parted by a hash of the whole row. So a task's memory doesn't grow with the input.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cmp_to_key
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..session import kept_table
from .repartition import held, partition_numbers, row_bytes

#: Rows that are sampled for a partition.
SAMPLED = 100
#: Bytes of rows for a task, with what sorting needs for each besides the row.
TASK_BYTES, SORTED = 64 << 20, 32
#: The column by which rows of one key are parted.
TIE = "_tie"


def _compare(a: tuple, b: tuple) -> int:
    """As Spark orders rows: null, numbers, NaN."""
    for x, y in zip(a, b):
        rank = [(v is not None) + (isinstance(v, float) and v != v) for v in (x, y)]
        if rank[0] != rank[1]:
            return rank[0] - rank[1]
        if rank[0] == 1 and x != y:
            return -1 if x < y else 1
    return 0


_ORDER = cmp_to_key(_compare)


@dataclass(frozen=True)
class Divisions:
    """bounds: the inner boundaries, rising, each a tuple with a value for each key column."""

    schema: StructType
    bounds: tuple[tuple, ...]

    def __post_init__(self):
        if any(_compare(a, b) >= 0 for a, b in pairwise(self.bounds)):
            raise ValueError("boundaries must rise")

    @property
    def keys(self) -> list[str]:
        return self.schema.names

    @property
    def parts(self) -> int:
        return len(self.bounds) + 1

    def table(self, spark: SparkSession) -> DataFrame:
        """(key columns) of the boundaries, for whoever wants to keep them."""
        return spark.createDataFrame(list(self.bounds), self.schema)

    def number(self, key: Sequence) -> int:
        """The partition of one key, on the driver."""
        return bisect_right([_ORDER(b) for b in self.bounds], _ORDER(tuple(key)))

    def numbered(self, df: DataFrame, name: str = "part") -> DataFrame:
        """df with each row's partition number: a search of log2(parts) steps, each a projection of its own within generated code, over the boundaries as one array."""
        if not self.bounds:
            return df.withColumn(name, F.lit(0))
        own = [F.col(f"`{k}`").cast(self.schema[k].dataType).alias(k) for k in self.keys]
        one = len(own) == 1  # else keys are compared as structs
        whole = StructType([StructField("bounds", ArrayType(self.schema[0].dataType if one else self.schema))])
        bounds = df.sparkSession.createDataFrame([([b[0] for b in self.bounds] if one else list(self.bounds),)], whole).scalar()
        rows = df.withColumns({"_own": own[0] if one else F.struct(*own), "_bounds": bounds}).withColumn(name, F.lit(0))
        step = 1 << (len(self.bounds).bit_length() - 1)
        while step:  # beyond the boundaries' end there is null, which isn't reached
            rows = rows.withColumn(name, F.col(name) + F.when(F.get("_bounds", F.col(name) + (step - 1)) <= F.col("_own"), step).otherwise(0))
            step //= 2
        return rows.drop("_own", "_bounds")


def _schema(df: DataFrame, keys: Sequence[str]) -> StructType:
    return df.select(*[F.col(f"`{k}`") for k in keys]).schema


def given(df: DataFrame, key: str, edges: Sequence) -> Divisions:
    """n partitions by n + 1 edges of one key; the first and the last also take what lies beyond them."""
    if len(edges) < 2:
        raise ValueError("a partition has two edges")
    return Divisions(_schema(df, [key]), tuple((e,) for e in edges[1:-1]))


def sampled(df: DataFrame, keys: Sequence[str], parts: int, weight: Column | None = None, seed: int = 7) -> Divisions:
    """At most `parts` partitions of about equal weight (a row weighs 1 unless told otherwise), from about SAMPLED sampled rows for each; a key that fills several partitions gets one."""
    rows = df.select(*[F.col(f"`{k}`") for k in keys], (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w"))
    share = parts * SAMPLED / max(1, df.count())
    some = rows.sample(share, seed) if share < 1 else rows
    counted = [tuple(r) for r in some.groupBy(*keys).agg(F.sum("_w").alias("_w")).collect()]  # bounded by the sample
    counted.sort(key=lambda r: _ORDER(r[:-1]))
    total, before, bounds = sum(r[-1] or 0 for r in counted), 0.0, []
    for row in counted:
        if before * parts >= total * (len(bounds) + 1) and before:
            bounds.append(row[:-1])
            while before * parts >= total * (len(bounds) + 1) and len(bounds) < parts - 1:  # this much weight has gone by already
                bounds.append(bounds[-1])
        before += row[-1] or 0
    return Divisions(_schema(df, keys), tuple(dict.fromkeys(bounds[: parts - 1])))


def _tied(df: DataFrame, divisions: Divisions) -> DataFrame:
    """df with TIE where the divisions have it as a key."""
    return df if TIE not in divisions.keys else df.withColumn(TIE, F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t]))


def refined(df: DataFrame, divisions: Divisions) -> tuple[Divisions, tuple[int, ...]]:
    """(divisions with as many sampled boundaries between the given ones as partitions of about TASK_BYTES need, the first partition of each given division but the first). Where a key fills several partitions, TIE is one more key."""
    rows, size = held(df)
    parts = -(-(size + rows * SORTED) // TASK_BYTES)
    if parts <= 1:
        return divisions, tuple(range(1, divisions.parts))
    weight, schema, more = row_bytes(df) + SORTED, divisions.schema, ()
    fine = sampled(df, divisions.keys, parts, weight)
    if fine.parts < parts:
        schema, more = StructType([*schema, StructField(TIE, LongType())]), (None,)  # null: no row of the key lies below
        fine = sampled(_tied(df, Divisions(schema, ())), schema.names, parts, weight)
    marked = sorted([(_ORDER((*b, *more)), 0, (*b, *more)) for b in divisions.bounds] + [(_ORDER(b), 1, b) for b in fine.bounds], key=lambda m: m[:2])
    rising = [m for k, m in enumerate(marked) if not k or marked[k - 1][0] < m[0]]
    return Divisions(schema, tuple(b for _, _, b in rising)), tuple(k + 1 for k, m in enumerate(rising) if m[1] == 0)


def _dealt(df: DataFrame, divisions: Divisions, name: str) -> DataFrame:
    return divisions.numbered(_tied(df, divisions), name).repartitionById(divisions.parts, F.col(name)).drop(TIE)


def divided(df: DataFrame, divisions: Divisions, name: str = "part", sort: bool = True) -> DataFrame:
    """Rows in partitions of refined() divisions, sorted by the keys within them: so by them over all partitions in order. `name`: the division of the partition that the row is really in."""
    fine, firsts = refined(df, divisions)
    rows = _dealt(df, fine, name).drop(name)
    if sort:
        rows = rows.sortWithinPartitions(*[F.col(f"`{k}`") for k in divisions.keys])
    of = Divisions(StructType([StructField("_real", IntegerType())]), tuple((k,) for k in firsts))
    return of.numbered(partition_numbers(rows, "_real"), name).drop("_real")


def positions(df: DataFrame, order: Sequence[str], name: str = "i", parts: int | None = None) -> DataFrame:
    """df with each row's place, from 0, in the order of some columns: for tables that have no positions of their own.

    Boundaries are sampled, rows of each partition counted, and the counts' running total (one number for each partition)
    joined back to rows that are numbered within their partition. The order should leave no ties: rows that tie get places
    that are theirs alone, in an order that isn't known."""
    spark = df.sparkSession
    divisions, _ = refined(df, sampled(df, order, parts or int(spark.conf.get("spark.sql.shuffle.partitions"))))
    counts = dict(divisions.numbered(_tied(df, divisions).select(*[F.col(f"`{k}`") for k in divisions.keys]), "_part").groupBy("_part").count().collect())
    before, starts = 0, []
    for part in range(divisions.parts):
        starts.append((part, before))
        before += counts.get(part, 0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*[F.col(f"`{k}`") for k in order]))
    rows = _dealt(df, divisions, "_part").withColumn("_place", place)
    known = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))
    return rows.join(known, "_part").withColumn(name, F.col("_start") + F.col("_place") - 1).drop("_part", "_start", "_place")


def reset_index(df: DataFrame, name: str = "i") -> DataFrame:
    """df with new row labels from 0, in the order that its rows have now (of its partitions, and within them).

    Rows are written once with their partition and their number in it, so that later steps see one order; what is joined
    to them is a running total for each partition."""
    spark = df.sparkSession
    rows = kept_table(df.withColumn("_place", F.monotonically_increasing_id()), "indexed")  # partition * 2^33 + number
    part = F.shiftright("_place", 33).cast("int")
    before, starts = 0, []
    for number, n in sorted(rows.groupBy(part.alias("_part")).count().collect()):
        starts.append((number, before))
        before += n
    known = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))
    within = F.col("_place").bitwiseAND(F.lit(2**33 - 1))
    return rows.withColumn("_part", part).join(known, "_part").withColumn(name, F.col("_start") + within).drop("_part", "_place", "_start")


@dataclass(frozen=True)
class Stored:
    """A table kept by its divisions: a folder for each partition, of which look-ups read only those that can hold their keys."""

    path: str
    divisions: Divisions

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def lookup(self, spark: SparkSession, *key) -> DataFrame:
        """Rows with this key: of one partition."""
        match = [F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in zip(self.divisions.keys, key)]
        out = self.rows(spark).where(F.col("_part") == self.divisions.number(key))
        for m in match:
            out = out.where(m)
        return out.drop("_part")

    def between(self, spark: SparkSession, low, high) -> DataFrame:
        """Rows whose first key column lies from low to high, both included: of the partitions between theirs."""
        first, rest = self.divisions.keys[0], len(self.divisions.keys) - 1
        numbers = [self.divisions.number((low, *[None] * rest)), self.divisions.number((high, *[float("nan")] * rest))]
        if rest:  # the upper end's other columns aren't known
            numbers[1] = bisect_right([_ORDER(b[:1]) for b in self.divisions.bounds], _ORDER((high,)))
        return self.rows(spark).where(F.col("_part").between(*numbers) & F.col(f"`{first}`").between(low, high)).drop("_part")


def stored(df: DataFrame, divisions: Divisions, folder: str) -> Stored:
    """Writes the table and its boundaries under a new name in a folder that all executors share; opened() finds them again."""
    path = f"{folder.rstrip('/')}/divided-{uuid.uuid4().hex}"
    divided(df, divisions, "_part").write.partitionBy("_part").parquet(f"{path}/rows")
    divisions.table(df.sparkSession).coalesce(1).write.parquet(f"{path}/bounds")
    return Stored(path, divisions)


def opened(spark: SparkSession, path: str) -> Stored:
    bounds = spark.read.parquet(f"{path}/bounds")
    found = sorted((tuple(r) for r in bounds.collect()), key=_ORDER)  # one for each partition
    return Stored(path, Divisions(bounds.schema, tuple(found)))
