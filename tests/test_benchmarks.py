"""Benchmarks, what runs on every slot, and what Spark says that was moved."""

import os

import numpy as np
import pytest
from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgrid.operators import blocks
from loomgrid.operators.aggregate import max_count_mean
from loomgrid.plans import benchmarks, telemetry, workers
from loomgrid.sources import generate, parquet

SMALL = {"merge": ["--rows", "2000", "--chunks", "3", "--join-type", "shuffle"], "groupby": ["--rows", "2000", "--chunks", "3", "--split-every", "2"], "shuffle": ["--in-parts", "3", "--partition-size", "16 KiB"], "scan": ["--path", "/root/testdata/sf0.001", "--files", "3", "--columns"], "array": ["--size", "40", "--operation", "transpose_sum"]}


@pytest.mark.parametrize("name", sorted(SMALL))
def test_benchmarks_report(spark, name):
    args = benchmarks.arguments([name, "--runs", "2", "--warmup-runs", "0", *(x for x in SMALL[name] if x != "--columns")])
    if name == "scan":
        args.path = "/root/testdata/sf0.001"
        args.files = 1
    out = benchmarks.measured(spark, args)
    assert len(out["seconds"]) == 2 and out["mib_per_s"] > 0 and out["bytes"] > 0
    assert name not in ("merge", "shuffle", "groupby") or out["shuffle_write_bytes"] > 0


@pytest.mark.parametrize("operation", benchmarks.OPERATIONS)
def test_array_operations(spark, operation):
    """Each operation of the array benchmark against numpy."""
    args = benchmarks.arguments(["array", "--operation", operation, "--size", "30", "--second-size", "5", "--chunk-size", "8"])
    n, out = benchmarks.array(spark, args)
    assert n > 0
    square = lambda seed: dense(generate.uniform_array(spark, 30, 30, seed), (30, 30))
    column = lambda seed: np.array([r["v"] for r in generate.normal_array(spark, 30, seed=seed).orderBy("i").collect()])
    if operation in ("sum", "mean", "transpose_sum"):
        x = square(0)
        assert out.first()[0] == pytest.approx({"sum": x.sum(), "mean": x.mean(), "transpose_sum": (x + x.T).sum()}[operation])
    elif operation == "slice":
        assert np.allclose(dense(out, (10, 30)), square(0)[::3])
    elif operation == "dot":
        assert np.allclose(dense(blocks.long_form(out, 8), (30, 30)), square(0) @ square(1))
    elif operation == "svd":
        u = np.array([r["u"] for r in out.orderBy("i").collect()])
        assert u.shape == (30, 5) and np.allclose(u.T @ u, np.eye(5))
    elif operation == "fft":
        want = np.fft.fft(square(0).T, axis=0)
        assert all(abs(complex(r["re"], r["im"]) - want[r["i"], r["j"]]) < 1e-9 for r in out.collect()) and out.count() == 900
    else:
        x, y = column(0), column(1)
        got = [r["v"] for r in out.orderBy("i").collect()]
        index = [r["v"] for r in generate.int_array(spark, 5, 30, 0).orderBy("i").collect()]
        assert got == pytest.approx(list({"col_sum": x + y, "col_mask": x[y > 10], "col_gather": x[index]}[operation]))


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def test_merge_options(spark):
    """Chunks of either side, natural order of the keys and a sorted result: the same matches."""
    for more, want in (([], 4 * 3 * 3), (["--no-shuffle"], 36), (["--set-index"], 36), (["--base-chunks", "2"], None), (["--other-chunks", "1", "--no-shuffle", "--set-index"], None)):
        args = benchmarks.arguments(["merge", "--rows", "120", "--chunks", "3", "--frac-match", "0.1", *more])
        size, out = benchmarks.merge(spark, args)
        base, other = args.base_chunks or 3, args.other_chunks or 3
        keys = [r["key"] for r in generate.merge_other(spark, other, 120, 0.1).collect()]
        assert size == (base + other) * 120 * 16 and out.count() == sum(k < base * 120 for k in keys)
        assert want is None or out.count() == want
        if args.set_index:
            got = [r["key"] for r in out.collect()]
            assert got == sorted(got)


def test_report_to_read(spark):
    args = benchmarks.arguments(["stencil", "--size", "40", "--chunk-size", "16", "--runs", "2", "--warmup-runs", "0", "--kernel-size", "2"])
    found = benchmarks.measured(spark, args)
    text = benchmarks.report(found, args)
    assert text.startswith("stencil\n") and "kernel-size         | 2" in text and text.count("run ") >= 2 and "+/-" in text and "widest exchange" in text
    assert found["widest_exchange"]["largest_read_rows"] >= found["widest_exchange"]["median_read_rows"] > 0


def test_merge_gives_the_matches_of_the_closed_form(spark):
    args = benchmarks.arguments(["merge", "--rows", "2000", "--chunks", "3"])
    size, out = benchmarks.merge(spark, args)
    assert size == 2 * 6000 * 16 and out.count() == generate.merge_matches(3, 2000)


def test_spilled_bytes_are_counted(spark):
    """A window that may keep 1000 rows in memory spills, and the counters tell."""
    before = workers.moved(spark)
    names = ["spark.sql.windowExec.buffer.spill.threshold", "spark.sql.windowExec.buffer.in.memory.threshold"]
    for name in names:
        spark.conf.set(name, "1000")
    try:
        rows = spark.range(40_000).select("id", F.max(F.xxhash64("id")).over(Window.partitionBy(F.pmod("id", F.lit(2)))).alias("most"))
        rows.write.format("noop").mode("overwrite").save()
    finally:
        for name in names:
            spark.conf.unset(name)
    after = workers.moved(spark)
    assert after["shuffle_write_rows"] - before["shuffle_write_rows"] >= 40_000
    assert after["disk_spilled_bytes"] > before["disk_spilled_bytes"]


def test_tiers_tell_memory_and_disk(spark):
    a = spark.range(50_000).persist(StorageLevel.MEMORY_ONLY)
    b = spark.range(50_000, 90_000).persist(StorageLevel.DISK_ONLY)
    a.count(), b.count()
    (row,) = workers.tiers(spark).collect()
    assert row["memory_bytes"] > 0 and row["disk_bytes"] > 0 and row["memory_limit"] > row["memory_bytes"]
    a.unpersist(True), b.unpersist(True)


def test_every_slot_runs(spark):
    rows = workers.on_every_slot(spark, lambda k: [k, os.getpid()], 3).collect()
    assert sorted(r["slot"] for r in rows) == [0, 1, 2] and len({r["result"] for r in rows}) == 3


def test_a_task_for_each_item(spark):
    out = workers.submitted(spark, lambda x: {"twice": 2 * x}, [5, 1.5, -2])
    assert out.rdd.getNumPartitions() == 3 and [tuple(r) for r in out.orderBy("item").collect()] == [(0, '{"twice": 10}'), (1, '{"twice": 3.0}'), (2, '{"twice": -4}')]
    assert workers.submitted(spark, lambda x: x, []).count() == 0


def test_partial_results_meet_in_a_tree(spark):
    df = spark.range(0, 900, 1, 27).select(F.pmod("id", F.lit(5)).alias("key"), F.col("id").alias("a"), F.col("id").cast("double").alias("b"))
    tree = max_count_mean(df, "key", "a", "b", split_every=3)
    assert tree._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3  # 27 partitions in 9 steps, those in 3, those in 1
    assert sorted(map(tuple, tree.collect())) == [(k, 895 + k, 180, float(np.mean(range(k, 900, 5)))) for k in range(5)]
    with pytest.raises(ValueError):
        max_count_mean(df, "key", "a", "b", split_every=1)


def test_full_counts_stay_in_the_jvm_and_read_all_columns(spark, sf):
    df = parquet.scanned(spark, [f"{sf}/lineitem.parquet"])
    out = parquet.opaque_count(df)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert out.first()[0] == df.count() and "Python" not in text and "InArrow" not in text
    assert all(c in text.split("FileScan")[1] for c in df.columns)


def test_matrix_has_all_pairs_without_a_join_of_all(spark):
    stats = telemetry.bandwidths(spark.createDataFrame([(0, "a", 10, 2.0), (0, "b", 5, 4.0)], "worker long, who string, total long, bandwidth double"))
    m = telemetry.peer_matrix(stats, spark.range(3).withColumnRenamed("id", "worker"), spark.createDataFrame([("a",), ("b",)], "who string"))
    assert m.count() == 6 and "CartesianProduct" not in m._jdf.queryExecution().executedPlan().toString() and {r["total_bytes"] for r in m.collect()} == {0.0, 10.0, 5.0}
