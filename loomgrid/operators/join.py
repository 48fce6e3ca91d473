"""Inner equi-joins with a choice of strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repartition import held, range_sorted

#: Spark's hint for each strategy; "auto" leaves the choice to Catalyst and AQE.
HINTS = {"auto": None, "broadcast": "broadcast", "shuffle": "shuffle_hash", "merge": "merge"}
#: Bytes of a side up to which a broadcast that was asked for is done.
MOST_BROADCAST = 256 << 20
#: Bytes that a hash table needs for a row besides the row; the driver holds rows, table and blocks at once, so a table may take 1 / SHARE of its heap.
ENTRY, SHARE = 64, 16


def strategy(broadcast: bool = False, shuffle: bool = False) -> str:
    """Which strategy two flags ask for: shuffle goes before broadcast."""
    return "shuffle" if shuffle else "broadcast" if broadcast else "auto"


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame, most: int) -> bool:
    """Whether the hash table of a plan's rows fits into `most` bytes and into the driver. Catalyst's estimate is of compressed files, so rows are counted where it is small enough."""
    most = min(most, int(df.sparkSession._jvm.java.lang.Runtime.getRuntime().maxMemory()) // SHARE)
    if estimated_bytes(df) > most:
        return False
    rows, size = held(df)
    return size + rows * ENTRY <= most


def inner_join(left: DataFrame, right: DataFrame, on: str, how: str = "auto", null_safe: bool = False, suffixes: tuple[str, str] = ("_x", "_y"), most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Rows of both sides with equal keys. The right side is the one that a broadcast sends or a hash table holds.

    Columns of both sides that share a name get the suffixes. Null keys match nothing, or each other with null_safe.
    A broadcast is only done where fits_broadcast(); beyond, both sides are sorted and merged, which needs no side in memory."""
    if how not in HINTS:
        raise ValueError(f"unknown strategy {how!r}; known: {', '.join(HINTS)}")
    both = (set(left.columns) & set(right.columns)) - {on}
    name = lambda df, suffix: df.select(*[F.col(c).alias(c + suffix if c in both else c) for c in df.columns])
    left, right = name(left, suffixes[0]), name(right, suffixes[1])
    if how == "broadcast" and not fits_broadcast(right, most_broadcast):
        how = "merge"
    if HINTS[how]:
        right = right.hint(HINTS[how])
    if not null_safe:
        return left.join(right, on, "inner")
    key = right.withColumnRenamed(on, "_on")
    return left.join(key, F.col(on).eqNullSafe(F.col("_on")), "inner").drop("_on")


def join_indexed(left: DataFrame, right: DataFrame, on: str, parts: int, how: str = "auto") -> DataFrame:
    """The join, range-partitioned and sorted by its key."""
    return range_sorted(inner_join(left, right, on, how), on, parts)
