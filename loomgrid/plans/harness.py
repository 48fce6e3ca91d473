"""A benchmark harness: warm-up, measured runs, harmonic statistics; and planning time without execution."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.repartition import all_to_all
from . import telemetry


@dataclass
class Benchmark:
    """once(spark, args) gives (bytes processed, DataFrame to compute); tidy columns come from args."""

    name: str
    once: Callable[[SparkSession, argparse.Namespace], tuple[int, DataFrame]]
    columns: list[str] = field(default_factory=list)


def parser(description: str = "") -> argparse.ArgumentParser:
    """The arguments that all benchmarks share."""
    p = argparse.ArgumentParser(description=description)
    p.add_argument("--runs", type=int, default=3)
    p.add_argument("--warmup-runs", type=int, default=1)
    p.add_argument("--workers", type=int, default=8)
    p.add_argument("--threads-per-worker", type=int, default=1)
    p.add_argument("--ignore-size", default="1 MiB")
    p.add_argument("--all-to-all", action="store_true")
    p.add_argument("--plan-only", action="store_true")
    p.add_argument("--output-basename")
    return p


def plan_seconds(df: DataFrame) -> float:
    """Time to analyse, optimise and plan, without running anything."""
    began = time.perf_counter()
    df._jdf.queryExecution().executedPlan()
    return time.perf_counter() - began


def run(spark: SparkSession, bench: Benchmark, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """(runs, summary): (data_processed, duration) of the measured runs in order, and telemetry.throughputs() of them."""
    if args.all_to_all:
        all_to_all(spark.range(0, args.workers, 1, args.workers), "id", args.workers).write.format("noop").mode("overwrite").save()
    rows = []
    for k in range(args.warmup_runs + args.runs):
        size, df = bench.once(spark, args)
        if args.plan_only:
            took = plan_seconds(df)
        else:
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
        if k >= args.warmup_runs:
            rows.append((size, took))
    runs = spark.createDataFrame(rows, "data_processed long, duration double")
    return runs, telemetry.throughputs(runs)


def tidied(runs: DataFrame, bench: Benchmark, args: argparse.Namespace) -> DataFrame:
    return telemetry.tidy(runs.withColumnRenamed("duration", "wallclock"), {c: getattr(args, c) for c in bench.columns}, args.workers)
