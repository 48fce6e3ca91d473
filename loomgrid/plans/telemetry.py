"""Statistics of runs and of transfers between workers, by native aggregates.

A transfer log has (worker, who, total, bandwidth): worker received `total` bytes from who. Bandwidths must be positive:
the harmonic mean is of their reciprocals, and others are left out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import divisions
from ..operators.quantiles import MOST, quantiles

#: The statistics of a pair of workers, in order.
STATISTICS = ["bandwidth_hmean", "bandwidth_hstd", "bandwidth_q25", "bandwidth_q50", "bandwidth_q75", "bandwidth_min", "bandwidth_max", "bandwidth_median", "total_bytes"]


def _reciprocal(x: Column) -> Column:
    return F.when(x > 0, 1 / x)


def hmean(x: Column) -> Column:
    """Harmonic mean; 0 of nothing."""
    return F.coalesce(1 / F.avg(_reciprocal(x)), F.lit(0.0))


def hstd(x: Column) -> Column:
    """Spread of the harmonic mean: sqrt(population variance of 1/x over n times the fourth power of their mean); 0 of nothing."""
    r = _reciprocal(x)
    return F.coalesce(F.sqrt(F.var_pop(r) / (F.count(r) * F.pow(F.avg(r), F.lit(4.0)))), F.lit(0.0))


def bandwidths(log: DataFrame, ignore_below: int | None = None, most: int = MOST) -> DataFrame:
    """STATISTICS of each (worker, who), of transfers of `ignore_below` bytes or more. Quantiles are exact; where a pair has more than `most` transfers they are found by rank selection, so none is too large for a task."""
    if ignore_below is not None:
        log = log.where(F.col("total") >= ignore_below)
    b = F.col("bandwidth")
    pair = ["worker", "who"]
    stats = [hmean(b).alias("bandwidth_hmean"), hstd(b).alias("bandwidth_hstd"), F.min(b).alias("bandwidth_min"), F.max(b).alias("bandwidth_max"), F.sum("total").alias("total_bytes")]
    if (log.groupBy(*pair).count().agg(F.max("count")).first()[0] or 0) <= most:  # a pair's values are few enough for one buffer
        q = [F.percentile(b, F.lit(x)).alias(f"bandwidth_q{int(x * 100)}") for x in (0.25, 0.5, 0.75)]
        return log.groupBy(*pair).agg(*stats, *q).withColumn("bandwidth_median", F.col("bandwidth_q50")).select(*pair, *STATISTICS)
    at = quantiles(log, pair, "bandwidth", [0.25, 0.5, 0.75], most).select(*[F.col(c).alias(f"_{c}") for c in pair], *[F.col("q")[k].alias(f"bandwidth_q{q}") for k, q in enumerate((25, 50, 75))])
    both = log.groupBy(*pair).agg(*stats).join(at, F.col("worker").eqNullSafe(F.col("_worker")) & F.col("who").eqNullSafe(F.col("_who")), "left")
    return both.withColumn("bandwidth_median", F.col("bandwidth_q50")).select(*pair, *STATISTICS)


def peer_matrix(stats: DataFrame, workers: DataFrame, sources: DataFrame) -> DataFrame:
    """(worker, who, STATISTICS as FLOAT) of every pair, 0 where nothing moved; workers (worker), sources (who): as many as the cluster has.

    The sources, as one array, are a scalar subquery that each worker's row is exploded by: the rows of a matrix of workers."""
    pairs = workers.select("worker", F.explode(sources.agg(F.sort_array(F.collect_list("who"))).scalar()).alias("who"))
    full = pairs.join(stats, ["worker", "who"], "left")
    return full.select("worker", "who", *[F.coalesce(F.col(s), F.lit(0)).cast("float").alias(s) for s in STATISTICS])


def address_index(workers: DataFrame) -> DataFrame:
    """(address, host, device, index): workers numbered from 0 by host, device and address."""
    rows = divisions.positions(workers.select("address", "host", "device"), ["host", "device", "address"], "index")
    return rows.select("address", "host", "device", F.col("index").cast("int").alias("index"))


def throughputs(runs: DataFrame) -> DataFrame:
    """One row over runs (data_processed, duration): harmonic mean and spread of the throughput, mean and population deviation of the time."""
    x = F.col("data_processed") / F.col("duration")
    return runs.where("duration > 0").agg(hmean(x).alias("throughput_hmean"), hstd(x).alias("throughput_hstd"), F.avg("duration").alias("wall_mean"), F.stddev_pop("duration").alias("wall_std"), F.count("*").alias("runs"))


def cluster_bandwidth(stats: DataFrame) -> DataFrame:
    """Harmonic mean and spread over the pairs that moved something."""
    x = F.col("bandwidth_hmean")
    return stats.where(x > 0).agg(hmean(x).alias("bandwidth_hmean"), hstd(x).alias("bandwidth_hstd"))


def busy_pairs(stats: DataFrame) -> DataFrame:
    """The report of pairs with any bytes."""
    return stats.where("total_bytes > 0").select("worker", "who", "bandwidth_q25", "bandwidth_q50", "bandwidth_q75", "total_bytes")


def cluster_totals(workers: DataFrame) -> DataFrame:
    return workers.agg(F.count("*").alias("nworkers"), F.sum("nthreads").alias("nthreads"))


def tidy(runs: DataFrame, config: dict, num_workers: int) -> DataFrame:
    """A row for each run: the configuration's columns, then the run's, then num_workers."""
    return runs.select(*[F.lit(v).alias(k) for k, v in config.items()], *runs.columns, F.lit(num_workers).alias("num_workers"))
