"""Known divisions, positions, quantiles and co-located tables: against plain Python, with plans that show what moves."""

import math
import random

import numpy as np
import pytest
from conftest import plan
from pyspark.sql import functions as F

from loomgrid.operators import colocated, divisions
from loomgrid.operators.quantiles import quantiles
from loomgrid.operators.repartition import partition_numbers
from loomgrid.session import shared_folder

NAN = float("nan")


def test_numbers_are_those_of_a_search(spark):
    values = [None, NAN, -math.inf, -1.5, 0.0, 1.0, 2.5, 2.5, 7.0, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for bounds in ([], [0.0], [0.0, 2.5], [-1.5, 0.0, 1.0, 2.5, 7.0], [None and 0, 1.0][1:], [1.0, NAN]):
        d = divisions.Divisions(df.schema, tuple((b,) for b in bounds))
        got = {repr(r["v"]): r["part"] for r in d.numbered(df).collect()}
        assert got == {repr(v): d.number((v,)) for v in values}
        plain = [b for b in bounds if b == b]
        for v in values:
            if v is not None and v == v:
                assert got[repr(v)] == sum(b <= v for b in plain)
        assert got["None"] == 0 and got["nan"] == len(bounds)
    with pytest.raises(ValueError, match="rise"):
        divisions.Divisions(df.schema, ((1.0,), (1.0,)))
    with pytest.raises(ValueError, match="edges"):
        divisions.given(df, "v", [1.0])


def test_rows_lie_in_their_partition_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randint(0, 50), k) for k in range(3000)] + [(None, None, -1), ("a", None, -2)]
    df = spark.createDataFrame(rows, "s string, n int, k long").repartition(5)
    d = divisions.sampled(df, ["s", "n"], 6)
    assert 2 <= d.parts <= 6
    out = partition_numbers(divisions.divided(df, d, "part"), "real").collect()
    assert len(out) == len(rows) and all(r["part"] == r["real"] for r in out)
    null_first = lambda r: tuple((v is not None, v) for v in (r["s"], r["n"]))
    assert [null_first(r) for r in out] == sorted(map(null_first, out))
    sizes = np.bincount([r["part"] for r in out])
    assert sizes.max() < 3 * len(rows) / d.parts


@pytest.mark.parametrize("hot", [0, 15_000])
def test_a_large_division_is_several_partitions(spark, monkeypatch, hot):
    """No task gets a whole division, nor all rows of one key; the order over all partitions stays."""
    rows = [(float(k % 997) if k >= hot else 500.5, k) for k in range(20_000)] + [(None, -1), (NAN, -2)]
    df = spark.createDataFrame(rows, "x double, k long").repartition(4, "k")
    d = divisions.given(df, "x", [0.0, 500.0, 501.0, 900.0, 1e9])
    monkeypatch.setattr(divisions, "TASK_BYTES", 1000 * (24 + divisions.SORTED))
    out = partition_numbers(divisions.divided(df, d, "part"), "real").collect()
    assert sorted((r["k"], repr(r["x"]), r["part"]) for r in out) == sorted((k, repr(x), d.number((x,))) for x, k in rows)
    assert np.bincount([r["real"] for r in out]).max() <= 2000
    assert len({(r["part"], r["real"]) for r in out}) == len({r["real"] for r in out})
    place = lambda r: (r["part"], r["x"] is not None, r["x"] is not None and r["x"] != r["x"], 0 if r["x"] is None or r["x"] != r["x"] else r["x"])
    assert [place(r) for r in out] == sorted(map(place, out)) and [r["real"] for r in out] == sorted(r["real"] for r in out)
    kept = divisions.stored(df, d, shared_folder(spark))
    assert kept.lookup(spark, 500.5).count() == hot and kept.rows(spark).count() == len(rows)
    at = sorted(divisions.positions(df, ["x"], parts=2).collect(), key=lambda r: r["i"])
    assert [r["i"] for r in at] == list(range(len(rows))) and at[0]["x"] is None and repr(at[-1]["x"]) == "nan"
    assert [r["x"] for r in at[1:-1]] == sorted(r["x"] for r in at[1:-1])


def test_boundaries_by_weight_and_hot_keys(spark):
    rows = [(k, 1) for k in range(100)] + [(1000, 900)] + [(2000 + k, 0) for k in range(1000)]
    df = spark.createDataFrame(rows, "k long, w long")
    d = divisions.sampled(df, ["k"], 10, weight=F.col("w"))
    assert d.parts <= 10 and d.number((1000,)) != d.number((2000,))
    hot = spark.createDataFrame([(7,)] * 900 + [(k,) for k in range(100)], "k long")
    assert divisions.sampled(hot, ["k"], 10).parts <= 5
    assert divisions.sampled(hot.where("false"), ["k"], 10).parts == 1


def test_a_look_up_reads_one_partition(spark):
    rows = [(float(k), k % 7) for k in range(2000)] + [(None, 1), (500.0, 99)]
    df = spark.createDataFrame(rows, "x double, y int").repartition(4)
    kept = divisions.opened(spark, divisions.stored(df, divisions.sampled(df, ["x"], 8), shared_folder(spark)).path)
    assert kept.divisions.parts == 8
    found = kept.lookup(spark, 500.0)
    assert sorted(r["y"] for r in found.collect()) == [3, 99] and kept.lookup(spark, None).count() == 1 and kept.lookup(spark, 0.5).count() == 0
    assert "PartitionFilters" in plan(found) and len({f for f in files_read(found)}) == 1
    between = kept.between(spark, 100.0, 350.5)
    assert between.count() == 251 and len(files_read(between)) <= 3 < 8


def files_read(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_positions(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 3), rng.choice([None, 1.5, 2.5, NAN]), k) for k in range(5000)]
    df = spark.createDataFrame(rows, "a int, b double, k long").repartition(7)
    out = divisions.positions(df, ["a", "b", "k"], parts=6)
    want = sorted(rows, key=lambda r: (r[0], (r[1] is not None) + (r[1] != r[1]), r[1] if r[1] is not None and r[1] == r[1] else 0, r[2]))
    assert {r["k"]: r["i"] for r in out.collect()} == {r[2]: i for i, r in enumerate(want)}
    assert divisions.positions(df.where("false"), ["a"]).count() == 0
    ties = divisions.positions(df.select("a"), ["a"], parts=3).orderBy("i").collect()
    assert [r["i"] for r in ties] == list(range(5000)) and [r["a"] for r in ties] == sorted(r["a"] for r in ties)


def test_positions_of_ten_million_rows(spark):
    df = spark.range(0, 10**7, 1, 8).select(F.expr("(id * 7368787) % 10000000").alias("x"))
    out = divisions.positions(df, ["x"], parts=8)
    text = plan(out)
    moves = [line for line in text.splitlines() if " Exchange" in line]
    assert "SinglePartition" not in text and "Window" in text and len(moves) == 1, text
    assert out.agg(F.count_if(F.col("i") == F.col("x")), F.count("*")).first()[:] == (10**7, 10**7)


def test_reset_index_keeps_the_order_at_hand(spark):
    df = spark.range(0, 5000, 1, 4).select(F.expr("(id * 3301) % 5000 as x"), F.lit("a").alias("_place"))
    out = divisions.reset_index(df.drop("_place").orderBy(F.desc("x")))
    assert out.where("i <> 4999 - x").count() == 0 and out.count() == 5000
    assert [r["n"] for r in divisions.reset_index(df.select("x").where("x < 3").coalesce(1), "n").orderBy("n").collect()] == [0, 1, 2]
    assert divisions.reset_index(df.select("x").where("false")).count() == 0


def numpy_quantiles(rows, shares):
    of = {}
    for g, v in rows:
        if v is not None and v == v:
            of.setdefault(g, []).append(v)
    out = {}
    for g, v in of.items():
        v.sort()
        h = [q * (len(v) - 1) for q in shares]
        out[g] = (len(v), [v[math.floor(x)] if x == int(x) else v[math.floor(x)] + (v[math.ceil(x)] - v[math.floor(x)]) * (x - math.floor(x)) for x in h])
    return out


@pytest.mark.parametrize("most", [1, 5, 100, 10**6])
def test_quantiles_of_any_values(spark, most):
    """Magnitudes, ties, one hot group, infinities, tiny groups; intervals of `most` rows."""
    rng = random.Random(most)
    rows = [("hot", rng.lognormvariate(0, 30)) for _ in range(2000)] + [("hot", -rng.lognormvariate(0, 3)) for _ in range(500)]
    rows += [("ties", rng.choice([1.0, 2.0, 2.0, 3.0])) for _ in range(900)] + [("one", 4.25)] + [("none", None), ("none", NAN)] + [(None, float(k)) for k in range(50)]
    rows += [("wide", v) for v in (-1e308, 1e308, 5e-324, -5e-324, 0.0, -0.0, 1.0, 1 + 2**-52, 1 - 2**-53)] * 3 + [("near", 1 + k * 2**-52) for k in range(400)] + [("zero", 0.0)] * 30
    shares = [0.0, 0.25, 0.5, 0.77, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: (r["n"], list(r["q"])) for r in quantiles(df, ["g"], "v", shares, most=most).collect()}
    want = numpy_quantiles(rows, shares)
    assert got.keys() == want.keys()
    for g, (n, q) in want.items():
        assert got[g] == (n, pytest.approx(q, rel=1e-12, abs=0)), g


def test_quantiles_with_infinities(spark):
    rows = [("a", v) for v in [math.inf, -math.inf, 0.0, 1.0, 2.0] * 20]
    (r,) = quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.25, 0.5, 0.75], most=1).collect()
    assert list(r["q"]) == [0.0, 1.0, 2.0]


@pytest.mark.parametrize("most", [3, 1000])
def test_quantiles_of_all_rows(spark, most):
    df = spark.createDataFrame([(float(k * k),) for k in range(101)], "v double")
    (r,) = quantiles(df, [], "v", [0.0, 0.5, 0.995], most=most).collect()
    assert (r["n"], list(r["q"])) == (101, pytest.approx([0.0, 2500.0, 9900.5]))
    assert quantiles(df.where("false"), [], "v", [0.5], most=most).count() == 0


def test_quantiles_hold_no_group_in_a_task(spark):
    """200,000 different values in one group: no more than `most` of them are collected anywhere."""
    df = spark.range(0, 200_000, 1, 8).select(F.lit(1).alias("g"), F.expr("cast(id * 7919 % 200000 as double)").alias("v"))
    out = quantiles(df, ["g"], "v", [0.1, 0.5, 0.999], most=1000)
    assert list(out.first()["q"]) == pytest.approx([19999.9, 99999.5, 199799.001])


def test_transfer_statistics_of_large_pairs(spark):
    """By rank selection the same as by one buffer for each pair."""
    from loomgrid.plans import telemetry

    log = spark.range(3000).selectExpr("id % 2 as worker", "case when id % 3 = 0 then 'a' else null end as who", "id as total", "cast((id * 37) % 101 + 1 as double) as bandwidth")
    one, other = ({(r["worker"], r["who"]): r for r in telemetry.bandwidths(log, 10, most=most).collect()} for most in (10**6, 5))
    assert one.keys() == other.keys() and len(one) == 4
    for k in one:
        assert list(one[k])[2:] == pytest.approx(list(other[k])[2:])


def test_colocated_tables_join_and_group_without_an_exchange(spark):
    rng = random.Random(5)
    left = [(rng.randint(0, 40) if rng.random() > 0.05 else None, k) for k in range(500)]
    right = [(k, k * 10) for k in range(0, 60, 2)] + [(None, 1)]
    a = colocated.bucketed(spark.createDataFrame(left, "key long, v long"), "key", 4, shared_folder(spark))
    b = colocated.bucketed(spark.createDataFrame(right, "key long, v long"), "key", 4, shared_folder(spark))
    out = colocated.joined(spark, a, b)
    want = sorted((k, v, w) for k, v in left for k2, w in right if k is not None and k == k2)
    assert sorted(map(tuple, out.select("key", "v_x", "v_y").collect())) == want
    grouped = colocated.joined(spark, a, b, lambda rows: rows.groupBy("key").agg(F.sum("v_x").alias("s")))
    for df in (out, grouped):
        assert "Exchange" not in plan(df) and "SortMergeJoin" in plan(df)
    sums = {}
    for k, v, _ in want:
        sums[k] = sums.get(k, 0) + v
    assert {r["key"]: r["s"] for r in grouped.collect()} == sums
    c = colocated.bucketed(spark.createDataFrame(right, "key long, v long"), "key", 3, shared_folder(spark))
    with pytest.raises(ValueError, match="layouts"):
        colocated.joined(spark, a, c)
    for t in (a, b, c):
        t.dropped(spark)
    assert not spark.catalog.tableExists(a.name)
