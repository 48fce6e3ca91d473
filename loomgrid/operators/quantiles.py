"""Exact quantiles of groups of any size, by distributed rank selection.

A quantile lies between the values of two ranks. Each rank is looked for in an interval of its group's values. While an
interval holds more than MOST rows and more than one value, a round counts its rows in BUCKETS buckets, and the bucket
with the rank, cut to its own least and greatest value, is the next interval. All groups and ranks narrow together in a
round, counts are added up before they are shuffled, and no task holds more than the buckets it counts. Intervals that
are small enough then give up their values, MOST at most, in order.

Buckets are of equal width, or of equal ratio where an interval spans magnitudes, so some eight rounds reach any double.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an interval that are sorted in one place; buckets of a round; intervals that are sent to all tasks.
MOST, BUCKETS, SENT = 1 << 16, 1024, 1 << 16


def _scaled(v: Column) -> Column:
    """Rises with v, evenly over magnitudes: logarithms of sizes, from the smallest double up, with v's sign."""
    return F.signum(v) * (F.least(F.log(F.abs(v)), F.lit(800.0)) + 746.0)


def _place(v: Column, low: Column, high: Column) -> Column:
    """v's bucket between low and high: 0 for low, the last for high."""
    wide = (F.signum(low) != F.signum(high)) | (F.greatest(F.abs(low), F.abs(high)) > 4 * F.least(F.abs(low), F.abs(high)))
    size = lambda x: F.when(x == 0, 0.0).otherwise(_scaled(x))
    share = F.when(wide, (size(v) - size(low)) / (size(high) - size(low))).otherwise((v - low) / (high - low))
    inside = F.least(F.floor(share * (BUCKETS - 2)).cast("int"), F.lit(BUCKETS - 3)) + 1
    return F.when(v == low, 0).when(v == high, BUCKETS - 1).otherwise(inside)  # the ends have buckets of their own, so each round tells something


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], most: int = MOST) -> DataFrame:
    """(keys, n, q: the quantiles at `shares` in their order) of each group, interpolated between the two values around each rank.

    Null and NaN values are left out; groups without others give no row. Null keys are a group; without keys all rows are one. Result rows are computed
    when it is called up to the last step, whose input is kept in memory and on disk."""
    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{value}`").cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    same = lambda other: [F.col(f"r.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in keys]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).where("_n > 0")
    if (groups.agg(F.max("_n")).first()[0] or 0) <= most:  # every group is small enough as it is
        sorted_ = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.sort_array(F.collect_list("_v")).alias("_at"))
        return _interpolated(sorted_.where("_n > 0"), keys, shares, lambda rank: F.get("_at", rank.cast("int")))
    # the ranks around each share; the rank counts from 0 within the interval
    around = [F.lit(float(q)) * (F.col("_n") - 1) for q in shares]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in around for f in (F.floor, F.ceil)]))
    state = groups.select("*", F.explode(ranks).alias("_asked")).withColumn("_rank", F.col("_asked")).withColumn("_size", F.col("_n")).persist(StorageLevel.MEMORY_AND_DISK)
    is_open = (F.col("_size") > most) & (F.col("_low") < F.col("_high"))
    held = [state]
    while (n := state.where(is_open).count()) > 0:
        intervals = state.where(is_open).select(*keys, "_low", "_high").distinct()
        sent = F.broadcast(intervals) if n <= SENT else intervals
        inside = rows.alias("r").join(sent.alias("t"), _all(same("t") + [F.col("_v").between(F.col("_low"), F.col("_high"))]))
        counted = inside.groupBy(*[F.col(f"t.{k}").alias(k) for k in keys], "_low", "_high", _place(F.col("_v"), F.col("_low"), F.col("_high")).alias("_bucket"))
        counted = counted.agg(F.count("*").alias("_count"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        before = F.sum("_count").over(Window.partitionBy(*keys, "_low", "_high").orderBy("_bucket")) - F.col("_count")  # BUCKETS rows at most
        counted = counted.withColumn("_before", before)
        both = state.where(is_open).alias("r").join(counted.alias("t"), _all(same("t") + [F.col("r._low") == F.col("t._low"), F.col("r._high") == F.col("t._high"), F.col("_rank") >= F.col("_before"), F.col("_rank") < F.col("_before") + F.col("_count")]))
        next_ = both.select(*[F.col(f"r.{k}").alias(k) for k in keys], "_n", F.col("_least").alias("_low"), F.col("_most").alias("_high"), "_asked", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_count").alias("_size"))
        state = state.where(~is_open).unionByName(next_).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(state)
        if len(held) > 2:
            state.count()
            held.pop(0).unpersist()
    one = state.where(F.col("_low") == F.col("_high")).select(*keys, "_n", "_asked", F.col("_low").alias("_value"))
    few = state.where(F.col("_low") < F.col("_high"))
    ends = few.select(*keys, "_low", "_high").distinct()
    sent = F.broadcast(ends) if ends.count() <= SENT else ends
    inside = rows.alias("r").join(sent.alias("t"), _all(same("t") + [F.col("_v").between(F.col("_low"), F.col("_high"))]))
    values = inside.groupBy(*[F.col(f"t.{k}").alias(k) for k in keys], "_low", "_high").agg(F.sort_array(F.collect_list("_v")).alias("_values"))  # `most` of them
    picked = few.alias("r").join(values.alias("t"), _all(same("t") + [F.col("r._low") == F.col("t._low"), F.col("r._high") == F.col("t._high")]))
    picked = picked.select(*[F.col(f"r.{k}").alias(k) for k in keys], "_n", "_asked", F.get("_values", F.col("_rank").cast("int")).alias("_value"))
    found = one.unionByName(picked).groupBy(*keys, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_asked", "_value"))).alias("_at"))
    return _interpolated(found, keys, shares, lambda rank: F.col("_at")[rank.cast("long")])


def _interpolated(found: DataFrame, keys: Sequence[str], shares: Sequence[float], at: Callable[[Column], Column]) -> DataFrame:
    """at: a group's value of a rank."""
    out = []
    for q in shares:
        h = F.lit(float(q)) * (F.col("_n") - 1)
        low, high = at(F.floor(h)), at(F.ceil(h))
        out.append(F.when(F.floor(h) == F.ceil(h), low).otherwise(low + (high - low) * (h - F.floor(h))))
    return found.select(*keys, F.col("_n").alias("n"), F.array(*out).alias("q"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
