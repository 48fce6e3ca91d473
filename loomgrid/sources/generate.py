"""Generators whose results are known in closed form. Every value is an expression of the row's number and a seed, so it depends on no partitioning, and a lost partition is made again alike."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multiplier of the hash of a row's number: the golden ratio's share of 2**32.
MULTIPLIER = 2654435761


#: A prime beyond any number of rows of a chunk, so that it has no factor in common with one.
PRIME = 2**31 - 1


def permuted(i: Column, n: int, shift: int = 0) -> Column:
    """A permutation of 0 to n - 1, n below PRIME."""
    if n >= PRIME:
        raise ValueError(f"a chunk has fewer than {PRIME} rows")
    return F.pmod(i * PRIME + shift, F.lit(n)) if n > 0 else i


def hashed(i: Column, seed: int, n: int) -> Column:
    """A number below n that looks random in i (below 2**31) and seed."""
    return F.pmod(F.floor(F.pmod((F.pmod(i, F.lit(2**31)) + seed) * MULTIPLIER, F.lit(2**32)) / 256).cast("long"), F.lit(n))


def _rows(spark: SparkSession, chunks: int, rows: int) -> DataFrame:
    return spark.range(0, chunks * rows, 1, chunks).select((F.expr(f"id div {rows}") if rows else F.lit(0)).alias("chunk"), F.pmod("id", F.lit(max(rows, 1))).alias("r"), "id")


def merge_build(spark: SparkSession, chunks: int, rows: int) -> DataFrame:
    """(key, shuffle, payload): keys 0 to chunks * rows - 1, each once; shuffle deals them to all chunks; payload is a permutation in each chunk."""
    return _rows(spark, chunks, rows).select(F.col("id").alias("key"), F.pmod(permuted(F.col("r"), rows), F.lit(chunks)).alias("shuffle"), permuted(F.col("r"), rows, 1).alias("payload"))


def merge_other(spark: SparkSession, chunks: int, rows: int, fraction: float = 0.3) -> DataFrame:
    """(key, payload): in each chunk, max(int(rows // chunks * fraction), 1) keys of each chunk of the build side (none for fraction 0), the rest beyond all its keys."""
    if not 0 <= fraction <= 1:
        raise ValueError("the fraction must lie between 0 and 1")
    each = matches_each(chunks, rows, fraction)
    part = rows // chunks
    r, chunk = F.col("r"), F.col("chunk")
    hit = F.expr(f"r div {max(each, 1)}") * rows + chunk * part + permuted(F.pmod(r, F.lit(max(each, 1))), part) if part else r
    key = F.when(r < each * chunks, hit).otherwise(F.lit(rows * chunks) + chunk * rows + r)
    return _rows(spark, chunks, rows).select(key.alias("key"), permuted(r, rows, 2).alias("payload"))


def matches_each(chunks: int, rows: int, fraction: float) -> int:
    return max(int(rows // chunks * fraction), 1) if fraction and rows >= chunks else 0


def merge_matches(chunks: int, rows: int, fraction: float = 0.3) -> int:
    """Rows of the join of merge_build and merge_other of the same size."""
    return chunks * chunks * matches_each(chunks, rows, fraction)


def groupby_rows(spark: SparkSession, chunks: int, rows: int, ratio: float = 0.01, seed: int = 0) -> DataFrame:
    """(key, int64, float64): max(int(ratio * all rows), 1) possible keys."""
    n = max(int(ratio * chunks * rows), 1)
    return _rows(spark, chunks, rows).select(hashed(F.col("id"), seed, n).alias("key"), permuted(F.col("r"), rows, 1).alias("int64"), permuted(F.col("r"), rows, 2).cast("double").alias("float64"))


def dealt(parts: int, workers: int, counts: Sequence[int] | None = None) -> list[int]:
    """Partitions of each worker: as even as can be, the first workers one more; or the counts given, which must add up."""
    if counts is None:
        return [parts // workers + (k < parts % workers) for k in range(workers)]
    if len(counts) != workers:
        raise ValueError(f"{len(counts)} counts for {workers} workers")
    if sum(counts) != parts:
        raise ValueError(f"the counts add up to {sum(counts)}, not {parts}")
    return list(counts)


def shuffle_rows(spark: SparkSession, parts: int, part_bytes: int, workers: int = 1, counts: Sequence[int] | None = None, seed: int = 0) -> DataFrame:
    """(data, worker): part_bytes // 8 uniform doubles in each of `parts` partitions. Spark places tasks itself; worker only tells what was asked for."""
    ends, at = [], 0
    for n in dealt(parts, workers, counts):
        at += n
        ends.append(at)
    worker = F.coalesce(*[F.when(F.col("chunk") < e, F.lit(k)) for k, e in enumerate(ends)])
    return _rows(spark, parts, part_bytes // 8).select((hashed(F.col("id"), seed, 1 << 24) / float(1 << 24)).alias("data"), worker.alias("worker"))


def mapped_source(spark: SparkSession, make: Callable, items: int, schema: str) -> DataFrame:
    """A partition for each of 0 to items - 1: make(i) gives a pyarrow table of `schema`."""

    def run(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                yield from make(i).to_batches()

    return spark.range(0, items, 1, items).mapInArrow(run, schema)


def uniform_array(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """(i, j, v), v in [0, 1)."""
    return spark.range(n * m).select(F.expr(f"id div {m}").alias("i"), F.pmod("id", F.lit(m)).alias("j"), (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / float(1 << 53)).alias("v"))


def normal_array(spark: SparkSession, n: int, mean: float = 10.0, std: float = 1.0, seed: int = 0) -> DataFrame:
    """(i, v), v normal, from two uniform numbers."""
    u = [(F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(k)), 11) + 0.5) / float(1 << 53) for k in (0, 1)]
    return spark.range(n).select(F.col("id").alias("i"), (F.sqrt(-2 * F.log(u[0])) * F.cos(u[1] * 6.283185307179586) * std + mean).alias("v"))


def int_array(spark: SparkSession, n: int, below: int, seed: int = 0) -> DataFrame:
    """(i, v), v from 0 to below - 1."""
    return spark.range(n).select(F.col("id").alias("i"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(below)).alias("v"))


def iota(spark: SparkSession, n: int, parts: int | None = None) -> DataFrame:
    """(v): 0 to n - 1."""
    return spark.range(0, n, 1, parts).withColumnRenamed("id", "v")


def timeseries(spark: SparkSession, start: str, end: str, step: str = "400 milliseconds", seed: int = 0) -> DataFrame:
    """(ts, x, y) at even steps from start up to end, not with it."""
    ts = spark.range(1).select(F.explode(F.expr(f"sequence(timestamp_ntz'{start}', timestamp_ntz'{end}', interval {step})")).alias("ts")).where(F.expr(f"ts < timestamp_ntz'{end}'"))
    return ts.select("ts", F.pmod(F.xxhash64("ts", F.lit(seed)), F.lit(1000)).alias("x"), (F.pmod(F.xxhash64("ts", F.lit(seed + 1)), F.lit(2_000_001)) / 1e6 - 1).alias("y"))


def partly_matching(df: DataFrame, key: str, matching: int, of: int) -> DataFrame:
    """df with `matching` of each `of` keys left as they are, spread over all keys, and the others moved below all keys that are 0 or more: so that a join finds a given share of them."""
    stays = F.pmod(F.col(key) * 7919, F.lit(of)) < matching
    return df.withColumn(key, F.when(stays, F.col(key)).otherwise(-1 - F.col(key)))
