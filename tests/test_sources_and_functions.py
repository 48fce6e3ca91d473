import datetime

import pytest
from conftest import plan
from pyspark.sql import functions as F

from loomgrid.functions import scalars, sizes
from loomgrid.plans import harness, telemetry
from loomgrid.session import MemoryTiers, Pool, configuration, executors, materialised, wait_for_workers
from loomgrid.sources import generate, parquet, sinks


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_discovery_and_projection(spark, sf, tmp_path):
    spark.range(100).withColumn("b", F.lit(1)).repartition(4).write.parquet(str(tmp_path / "t"))
    paths = parquet.discovered(spark, str(tmp_path / "t") + "/")
    assert len(paths) == 4 and paths == sorted(paths)
    assert parquet.discovered(spark, str(tmp_path / "t"), 3) == paths[:3]
    df = parquet.scanned(spark, paths, "id")
    assert "ReadSchema: struct<id:bigint>" in plan(df)
    assert "ReadSchema: struct<id:bigint>" in plan(parquet.opaque_count(df)) and parquet.opaque_count(df).first()[0] == 100
    files, size = parquet.on_disk(df).first()
    assert files == 4 and size > 0


def test_store_settings():
    assert parquet.store_settings({"key": "a"}) == {"spark.hadoop.fs.s3a.access.key": "a"}
    with pytest.raises(ValueError):
        parquet.store_settings({"kee": "a"})
    assert parquet.scan_settings(256, 0) == {"spark.sql.files.maxPartitionBytes": "256", "spark.sql.files.openCostInBytes": "0"}


@pytest.mark.parametrize("chunks, rows, fraction", [(1, 10, 0.3), (3, 30, 0.5), (4, 100, 0.3), (2, 7, 1.0), (3, 50, 0.0)])
def test_merge_generators(spark, chunks, rows, fraction):
    build, other = generate.merge_build(spark, chunks, rows), generate.merge_other(spark, chunks, rows, fraction)
    assert build.select("key").distinct().count() == chunks * rows == other.count()
    assert build.join(other, "key").count() == generate.merge_matches(chunks, rows, fraction)
    assert sorted(r[0] for r in build.limit(rows).select("payload").collect()) == list(range(rows))


def test_generators_do_not_depend_on_partitions(spark):
    a = generate.groupby_rows(spark, 4, 50, 0.1)
    assert a.select("key").distinct().count() <= 20 and a.agg(F.max("key")).first()[0] < 20
    x = generate.uniform_array(spark, 50, 40)
    assert sorted(map(tuple, x.collect())) == sorted(map(tuple, x.repartition(3).collect()))
    assert abs(x.agg(F.avg("v")).first()[0] - 0.5) < 0.03
    n = generate.normal_array(spark, 5000).agg(F.avg("v"), F.stddev("v")).first()
    assert abs(n[0] - 10) < 0.1 and abs(n[1] - 1) < 0.1
    assert generate.int_array(spark, 100, 7).where("v < 0 or v >= 7").count() == 0
    assert generate.iota(spark, 10000, 10).agg(F.sum("v")).first()[0] == 49995000
    assert generate.timeseries(spark, "2020-01-01 00:00:00", "2020-01-01 00:00:04").count() == 10


def test_dealing():
    assert generate.dealt(7, 3) == [3, 2, 2] and generate.dealt(4, 2, [1, 3]) == [1, 3]
    for counts in ([1, 2], [1, 1, 2]):
        with pytest.raises(ValueError):
            generate.dealt(4, 2, counts)


def test_shuffle_rows_and_mapped_source(spark):
    import pyarrow as pa

    df = generate.shuffle_rows(spark, 5, 800, workers=2)
    assert df.count() == 500 and df.where("data < 0 or data >= 1").count() == 0 and df.select("worker").distinct().count() == 2
    assert generate.mapped_source(spark, lambda i: pa.table({"x": [i] * i}), 4, "x long").count() == 6


@pytest.mark.parametrize("size, want", [(None, None), (0, None), ("0", None), ("0.0", None), ("0 GiB", None), (1, 1), ("1", 1), ("1GB", 10**9), ("1 MiB", 2**20), (1.0, 1000), ("1.0", 1000), (0.8, 800), ("0.8", 800)])
def test_sizes(spark, size, want):
    assert sizes.device_bytes(size, 1000) == want
    if isinstance(size, str):
        assert value(spark, scalars.parsed_bytes(F.lit(size), F.lit(1000))) == want


def test_sizes_are_aligned(spark):
    assert sizes.device_bytes(1000, 10**6, 256) == 768 == value(spark, scalars.parsed_bytes(F.lit("1000"), F.lit(10**6), 256))
    assert sizes.memory_limit("auto", 1000) == 1000 and sizes.memory_limit("default", 1000) == 800 and sizes.memory_limit("auto", None) is None
    assert value(spark, scalars.memory_limit(F.lit("default"), F.lit(1000))) == 800
    with pytest.raises(ValueError):
        sizes.byte_size("1 parsec")


@pytest.mark.parametrize("words, want", [([1152920405096267775, 0], [*range(20), *range(40, 60)]), ([17293823668613283840, 65535], [*range(20, 40), *range(60, 80)]), ([2**64 - 1, 0], [*range(64)]), ([0, 2**64 - 1], [*range(64, 128)])])
def test_bitmask(spark, words, want):
    import decimal

    df = spark.createDataFrame([([decimal.Decimal(w) for w in words],)], "w array<decimal(20,0)>")
    assert df.select(scalars.unpack_bitmask(F.transform("w", scalars.signed)).alias("x")).first()[0] == want


def test_other_functions(spark):
    v = F.array(*map(F.lit, ["0", "3", "7", "8"]))
    got = [value(spark, scalars.rotated(v, F.lit(i))) for i in range(4)]
    assert got == ["0,3,7,8", "3,7,8,0", "7,8,0,3", "8,0,3,7"]
    assert value(spark, scalars.parsed_device(F.lit("GPU-ab"))) == "GPU-ab" and value(spark, scalars.parsed_device(F.lit(" 3"))) == "3"
    assert value(spark, scalars.nth_device(F.lit(1), F.lit("0, GPU-1"))) == "GPU-1"
    assert value(spark, scalars.resources(F.lit("GPU=2 MEM=10e9"))) == {"GPU": 2.0, "MEM": 10e9} == value(spark, scalars.resources(F.lit("GPU=2,MEM=10e9")))
    assert value(spark, scalars.ports(F.lit("5:8"), F.lit(4))) == [5, 6, 7, 8] and value(spark, scalars.ports(F.lit("5"), F.lit(1))) == [5]
    assert value(spark, scalars.comma_choices(F.lit("a, b"), ["a", "b"])) == ["a", "b"]
    for bad in (scalars.parsed_device(F.lit("x")), scalars.ports(F.lit("5:6"), F.lit(4)), scalars.comma_choices(F.lit("a,z"), ["a"]), scalars.parsed_bytes(F.lit("1 parsec"), F.lit(1))):
        with pytest.raises(Exception):
            value(spark, bad)
    assert value(spark, scalars.log_name(F.lit("tcp://a/b-7"), "p")) == "p_b-7.txt"


def test_telemetry(spark):
    import numpy as np

    x = np.array([3.0, 5.0, 9.0, 20.0])
    df = spark.createDataFrame([(1, "a", 10, float(b)) for b in x] + [(1, "b", 0, 1.0)], "worker long, who string, total long, bandwidth double")
    r = telemetry.bandwidths(df, 1).first()
    m = np.mean(1 / x)
    assert r["bandwidth_hmean"] == pytest.approx(1 / m) and r["bandwidth_hstd"] == pytest.approx(np.sqrt(np.var(1 / x) / (4 * m**4)))
    assert [r[f"bandwidth_q{q}"] for q in (25, 50, 75)] == pytest.approx(list(np.quantile(x, [0.25, 0.5, 0.75])))
    assert telemetry.bandwidths(df, 100).count() == 0
    none = telemetry.cluster_bandwidth(telemetry.bandwidths(df, 100)).first()
    assert tuple(none) == (0.0, 0.0)


def test_sinks(spark, tmp_path):
    base, day = str(tmp_path / "out"), datetime.date(2020, 1, 2)
    names = []
    for _ in range(3):
        names.append(n := sinks.free_name(spark, base, day))
        spark.range(1).write.json(n + ".json")
    assert [n.rsplit("/", 1)[1] for n in names] == ["out", "out-20200102.0", "out-20200102.1"]
    assert sinks.save_results(str(tmp_path / "r"), *[spark.range(1)] * 3).endswith("r")
    for k in (1, 2):
        sinks.append_history(spark, str(tmp_path / "h"), [1.0, 2.005 * k], datetime.date(2020, 1, k))
    assert [tuple(r) for r in sinks.history(spark, str(tmp_path / "h")).collect()] == [(datetime.date(2020, 1, 1), 1.5), (datetime.date(2020, 1, 2), 2.5)]


def test_settings():
    assert MemoryTiers(total=1000, fast=0.5).settings()["spark.memory.offHeap.size"] == "500"
    assert "spark.memory.offHeap.size" not in MemoryTiers(total=1000).settings()
    for bad in (lambda: MemoryTiers(total=10, fast=20).settings(), lambda: MemoryTiers(10, fraction=2).settings(), lambda: Pool(managed=True, asynchronous=True).check(1), lambda: Pool(release_threshold=1).check(1), lambda: Pool(size=1024, maximum=512).check(1)):
        with pytest.raises(ValueError):
            bad()
    assert Pool(size=0.5).check(1024) == {"size": 512, "maximum": None, "release_threshold": None}


def test_introspection(spark):
    assert configuration(spark).where("key = 'spark.sql.session.timeZone' and value = 'UTC'").count() == 1
    assert executors(spark).count() >= 1 and wait_for_workers(spark, 1, seconds=1) and not wait_for_workers(spark, 99, seconds=0)
    df = materialised(spark.range(10))
    assert df.is_cached and df.unpersist().count() == 10


def test_harness(spark):
    args = harness.parser().parse_args(["--runs", "2", "--workers", "3", "--all-to-all"])
    bench = harness.Benchmark("range", lambda s, a: (800, s.range(100)), ["runs", "workers"])
    runs, summary = harness.run(spark, bench, args)
    assert runs.count() == 2 and summary.first()["throughput_hmean"] > 0
    row = harness.tidied(runs, bench, args).first().asDict()
    assert row["runs"] == 2 and row["num_workers"] == 3 and "wallclock" in row
    args.plan_only = True
    assert harness.run(spark, bench, args)[0].count() == 2
