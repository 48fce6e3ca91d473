"""The transfer log as a stream, with restarts, late records and records of no time, against the batch; and what exchanges tell."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import repartition
from loomgrid.plans import telemetry, workers
from loomgrid.streaming import transfers

SCHEMA = "ts timestamp, worker long, who string, total long, bandwidth double"
START = datetime.datetime(2024, 5, 1)


def records(n, first=0, seed=3):
    rng = random.Random(seed + first)
    return [(START + datetime.timedelta(minutes=first + k + rng.randint(-5, 5)), rng.randint(0, 2), rng.choice(["a", "b", None]), rng.randint(0, 5000), rng.choice([rng.lognormvariate(3, 2), 8.0, 0.0])) for k in range(n)]


def put(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def ran(query):
    query.awaitTermination()
    assert query.exception() is None


def positive(rows):
    return [r for r in rows if r[4] > 0]


def test_batches_add_up_to_the_whole_log_with_two_restarts(spark, tmp_path):
    """After each run, what was kept equals the batch over all records so far, late ones too; a batch that runs again counts once."""
    log, parts, checkpoint, rows = tmp_path / "log", tmp_path / "parts", tmp_path / "checkpoint", []
    for run, (first, n) in enumerate(((0, 60), (60, 80), (20, 40))):  # the third run's records are late
        for k in range(2):
            new = positive(records(n // 2 + 40, first + k * n // 2))
            rows += new
            put(spark, log, new, f"run{run}-{k}")
        ran(transfers.accumulated(stream(spark, log), "ts", str(parts), str(checkpoint), ignore_below=100))
        kept = spark.read.parquet(str(parts))
        log_ = spark.createDataFrame(rows, SCHEMA)
        # quantiles of the batch interpolate; a histogram's lie at a rank, so both are compared at ranks
        exact = telemetry.bandwidths(log_, 100).drop(*[f"bandwidth_{q}" for q in ("q25", "q50", "q75", "median")])
        got = transfers.summarised(kept)
        theirs = {(r["worker"], r["who"]): r for r in exact.collect()}
        values = {}
        for r in rows:
            if r[3] >= 100:
                values.setdefault((r[1], r[2]), []).append(r[4])
        for r in got.collect():
            k = (r["worker"], r["who"])
            for c in exact.columns[2:]:
                assert r[c] == pytest.approx(theirs[k][c], rel=1e-9)
            v = sorted(values[k])
            for q in (0.25, 0.5, 0.75):
                assert r[f"bandwidth_q{int(q * 100)}"] == pytest.approx(v[int(q * (len(v) - 1))], rel=2 ** (1 / transfers.PER_OCTAVE) - 1)
        assert got.count() == len(theirs) == len(values)
    ran(transfers.accumulated(stream(spark, log), "ts", str(parts), str(checkpoint), ignore_below=100))  # nothing new
    assert spark.read.parquet(str(parts)).agg(F.sum("n")).first()[0] == sum(map(len, values.values()))


def test_windows_come_once_when_the_watermark_has_passed_them(spark, tmp_path):
    log, out, checkpoint = tmp_path / "log", tmp_path / "out", tmp_path / "checkpoint"
    go = lambda: ran(transfers.windows(stream(spark, log), "ts", str(out), str(checkpoint), "10 minutes", "20 minutes"))
    early, later, far = positive(records(100)), positive(records(100, 100)), [(START + datetime.timedelta(days=1), 0, "a", 10, 1.0)]
    put(spark, log, early, "a")
    go()
    put(spark, log, later, "b")
    go()
    put(spark, log, far, "c")
    go()
    put(spark, log, [(START, 2, "late", 10, 1.0)], "d")  # far behind the watermark
    go()
    put(spark, log, [(START + datetime.timedelta(days=2), 0, "a", 10, 1.0)], "e")
    go()
    got = transfers.summarised(spark.read.parquet(str(out)), "start", "worker", "who")
    want = transfers.summarised(transfers.partials(spark.createDataFrame(early + later + far, SCHEMA), "ts", "10 minutes", "0 seconds"), "start", "worker", "who")
    key = lambda df: sorted((str(r["start"]), r["worker"], str(r["who"]), r["total_bytes"], round(r["bandwidth_hmean"], 9), round(r["bandwidth_q50"], 9)) for r in df.collect())
    assert key(got) == key(want) and spark.read.parquet(str(out)).agg(F.sum("n")).first()[0] == len(early + later + far)


def test_bandwidths_that_are_not_positive_have_no_reciprocal(spark):
    rows = [(START, 0, "a", 10, b) for b in (0.0, -3.0, 2.0, 4.0)] + [(START, 1, "b", 5, 0.0), (None, 1, "c", 5, 1.0)]
    parts = transfers.partials(spark.createDataFrame(rows, SCHEMA), "ts", "1 hour", "0 seconds")
    got = {r["who"]: r for r in transfers.summarised(parts).collect()}
    assert set(got) == {"a", "b"} and got["a"]["bandwidth_hmean"] == pytest.approx(2 / (1 / 2 + 1 / 4)) and got["a"]["bandwidth_min"] == -3 and got["a"]["total_bytes"] == 40
    assert got["b"]["bandwidth_hmean"] == 0 and got["b"]["bandwidth_hstd"] == 0


def test_exchanges_of_one_action(spark):
    """A partition with half of all rows is seen as such; what other jobs move doesn't count."""
    rows = spark.range(0, 10_000, 1, 4).select("id", F.when(F.col("id") % 2 == 0, 3).otherwise(F.col("id") % 5).cast("int").alias("part"))
    dealt = repartition.dealt_by_id(rows, "part", 5)
    spark.range(1000).repartition(3).count()
    told = workers.exchanges(spark, lambda: dealt.write.format("noop").mode("overwrite").save()).orderBy("stage").collect()
    counts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    assert [(r["tasks"], r["written_rows"], r["read_rows"]) for r in told] == [(4, 10_000, 0), (5, 0, 10_000)]
    assert told[1]["largest_read_rows"] == max(counts.values()) == 6000 and told[1]["median_read_rows"] == sorted(counts.values())[2]
    assert told[0]["written_bytes"] > 0 and told[1]["read_bytes"] > 0 and all(r["disk_spilled_bytes"] == 0 for r in told)
    with pytest.raises(ZeroDivisionError):
        workers.exchanges(spark, lambda: 1 / 0)
    assert workers.exchanges(spark, lambda: None).count() == 0


def test_stages_that_spark_has_dropped(spark, monkeypatch):
    """Skipped ones may be missing, those that ran may not."""
    rows = spark.range(100).repartition(3, "id").groupBy("id").count()
    go = lambda: rows.write.format("noop").mode("overwrite").save()
    store = spark.sparkContext._jsc.sc().statusStore()
    assert workers.last_attempt(store, 10**6) is None
    found = workers.last_attempt

    def without(status):
        return lambda store, stage: x if (x := found(store, stage)) is not None and (x.status().toString() == "COMPLETE") != status else None

    monkeypatch.setattr(workers, "last_attempt", without(False))
    assert workers.exchanges(spark, go).count() >= 2
    monkeypatch.setattr(workers, "last_attempt", without(True))
    with pytest.raises(RuntimeError, match="retainedStages"):
        workers.exchanges(spark, go)
