import pytest
from conftest import plan
from pyspark.sql import functions as F

from loomgrid.operators import aggregate, join, repartition


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([(1, 10), (2, 20), (2, 21), (None, 30), (5, 50)], "key long, payload long")
    right = spark.createDataFrame([(1, 100), (2, 200), (None, 300), (7, 700)], "key long, payload long")
    return left, right


@pytest.mark.parametrize("how", list(join.HINTS))
def test_strategies_agree(sides, how):
    got = sorted(map(tuple, join.inner_join(*sides, "key", how).select("key", "payload_x", "payload_y").collect()))
    assert got == [(1, 10, 100), (2, 20, 200), (2, 21, 200)]


@pytest.mark.parametrize("how, node", [("broadcast", "BroadcastHashJoin"), ("shuffle", "ShuffledHashJoin"), ("merge", "SortMergeJoin")])
def test_hints_are_followed(spark, how, node):
    left, right = (spark.range(1000).withColumnRenamed("id", "key") for _ in range(2))
    assert node in plan(join.inner_join(left, right, "key", how))


def test_shuffle_goes_before_broadcast():
    assert join.strategy(True, True) == "shuffle" and join.strategy(True) == "broadcast" and join.strategy() == "auto"


def test_broadcast_is_checked(spark):
    left, right = (spark.range(1000).withColumnRenamed("id", "key") for _ in range(2))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(join.inner_join(left, right, "key", "broadcast", most_broadcast=100))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_broadcast_is_checked_by_rows(spark, tmp_path):
    """Files are smaller than the hash table of their rows."""
    path = f"file://{tmp_path}/narrow"
    spark.range(0, 200_000, 1, 1).select((F.col("id") % 7).alias("key"), F.lit("y" * 40).alias("text")).write.parquet(path)
    right, left = spark.read.parquet(path), spark.range(10).withColumnRenamed("id", "key")
    assert join.estimated_bytes(right) < 4 << 20 and repartition.held(right) == (200_000, 200_000 * 64)
    small = join.inner_join(left, right, "key", "broadcast", most_broadcast=32 << 20)
    large = join.inner_join(left, right, "key", "broadcast", most_broadcast=16 << 20)
    assert "BroadcastHashJoin" in plan(small) and "BroadcastHashJoin" not in plan(large)
    assert small.count() == large.count() == 200_000


def test_bytes_in_memory(spark):
    df = spark.createDataFrame([(1, "ab", [1, 2]), (2, None, None)], "a int, `b c` string, v array<int>")
    assert repartition.held(df) == (2, 2 * 32 + 2 + 4 * len("[1, 2]")) and repartition.held(df.where("false")) == (0, 0)


def test_null_keys(sides):
    assert join.inner_join(*sides, "key", null_safe=True).count() == 4


def test_unknown_strategy(sides):
    with pytest.raises(ValueError):
        join.inner_join(*sides, "key", "nested")


def test_join_indexed_is_sorted(spark):
    left = spark.range(500).select(F.pmod(F.col("id") * 7, F.lit(500)).alias("key"))
    keys = [r[0] for r in join.join_indexed(left, left.withColumn("x", F.lit(1)), "key", 5).collect()]
    assert keys == sorted(keys) and len(keys) == 500


def test_aggregate_variants_agree(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 50 != 0, F.pmod("id", F.lit(13))).alias("k"), F.col("id").alias("a"), (F.col("id") / 7).alias("b"))
    one = sorted(map(tuple, aggregate.max_count_mean(df, "k", "a", "b").collect()))
    assert all(k is not None for k, *_ in one)
    for how in ({"sort": True}, {"split_out": 3}, {"split_every": 2}, {"split_out": 3, "split_every": 2, "sort": True}):
        got = list(map(tuple, aggregate.max_count_mean(df, "k", "a", "b", **how).collect()))
        if how.get("sort"):
            assert got == sorted(got)
        assert [x[:3] for x in sorted(got)] == [x[:3] for x in one]
        assert [x[3] for x in sorted(got)] == pytest.approx([x[3] for x in one])


def test_split_out_sets_partitions(spark):
    df = spark.range(100).select(F.pmod("id", F.lit(9)).alias("k"), F.col("id").alias("a"), F.col("id").cast("double").alias("b"))
    assert aggregate.max_count_mean(df, "k", "a", "b", split_out=5).rdd.getNumPartitions() == 5


def test_hash_shuffle(spark):
    df = repartition.partition_numbers(repartition.hash_shuffled(spark.range(1000).withColumn("k", F.pmod("id", F.lit(40))), "k", 7))
    assert df.rdd.getNumPartitions() == 7
    assert df.groupBy("k").agg(F.countDistinct("part").alias("n")).agg(F.max("n")).first()[0] == 1


def test_salted_spreads_a_hot_key(spark):
    df = repartition.partition_numbers(repartition.salted(spark.range(1000).withColumn("k", F.lit(1)), "k", 8, 6, F.col("id")))
    assert df.select("part").distinct().count() > 1


def test_dealt_by_id(spark):
    df = repartition.partition_numbers(repartition.dealt_by_id(spark.range(60).withColumn("k", F.pmod("id", F.lit(6))), "k", 6))
    assert df.where("k <> part").count() == 0


def test_all_to_all(spark):
    assert repartition.all_to_all(spark.range(20).selectExpr("id % 5 as s"), "s", 5).where("item = 4").count() == 25


SPILL = """
from pyspark.sql import functions as F
from loomgrid.operators import join
from loomgrid.session import session

spark = session(workers=2, spark__testing__memory=64 << 20, spark__testing__reservedMemory=0, spark__sql__autoBroadcastJoinThreshold=-1, spark__sql__shuffle__partitions=2, spark__buffer__pageSize="1m")
a = spark.range(600_000).select(F.pmod(F.col("id") * 17, F.lit(600_000)).alias("key"), F.repeat(F.lit("x"), 120).alias("pad"))
n, s, w = join.inner_join(a, a.withColumnRenamed("pad", "other"), "key", "merge").agg(F.count("*"), F.sum("key"), F.sum(F.length("pad") + F.length("other"))).first()
print("GOT", n, s, w)
"""


def test_low_memory_stays_right():
    """A sort-merge join of sides larger than the memory for execution, which can only go by way of the disk, gives the same sums."""
    import subprocess
    import sys
    from pathlib import Path

    out = subprocess.run([sys.executable, "-c", SPILL], capture_output=True, text=True, timeout=200, cwd=Path(__file__).parent.parent)
    assert f"GOT 600000 {600_000 * 599_999 // 2} {600_000 * 240}" in out.stdout, out.stderr[-2000:]
