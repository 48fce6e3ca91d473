"""Sessions: the factory, memory and spill settings, and what a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .functions.sizes import device_bytes

ROOT = str(Path(__file__).resolve().parent.parent)


def prepared(spark: SparkSession) -> SparkSession:
    """Lets Python workers of this machine import the package; a cluster has it installed or gets it by --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark


@dataclass(frozen=True)
class MemoryTiers:
    """How much each worker may hold in its fast pool, in memory and on disk, as Spark settings.

    Limits are sizes as in functions.sizes (bytes, "2 GB", a fraction of `total`, "auto"); None leaves Spark's default.
    The fast pool is Spark's off-heap memory; what exceeds a tier goes to the next by Spark's own block manager."""

    total: int
    fast: object = None
    fraction: float | None = None
    compress: bool = True
    extra: dict = field(default_factory=dict)

    def settings(self) -> dict[str, str]:
        out = {"spark.shuffle.spill.compress": str(self.compress).lower(), "spark.rdd.compress": str(self.compress).lower()}
        if (fast := device_bytes(self.fast, self.total)) is not None:
            if fast > self.total:
                raise ValueError(f"the fast pool ({fast} bytes) exceeds the worker's memory ({self.total} bytes)")
            out |= {"spark.memory.offHeap.enabled": "true", "spark.memory.offHeap.size": str(fast)}
        if self.fraction is not None:
            if not 0 < self.fraction < 1:
                raise ValueError("the fraction for execution and storage must lie between 0 and 1")
            out["spark.memory.fraction"] = str(self.fraction)
        return out | {k: str(v) for k, v in self.extra.items()}


@dataclass(frozen=True)
class Pool:
    """An allocator's options, checked as a whole before any is used."""

    size: object = None
    maximum: object = None
    managed: bool = False
    asynchronous: bool = False
    release_threshold: object = None

    def check(self, total: int) -> dict[str, int | None]:
        if self.managed and self.asynchronous:
            raise ValueError("a pool can't be both managed and asynchronous")
        if self.release_threshold is not None and not self.asynchronous:
            raise ValueError("a release threshold needs an asynchronous pool")
        size, most = device_bytes(self.size, total, 256), device_bytes(self.maximum, total, 256)
        if size is None and most is not None and not self.asynchronous:
            raise ValueError("a largest size needs a first size")
        if size is not None and most is not None and size > most:
            raise ValueError("the first size exceeds the largest")
        return {"size": size, "maximum": most, "release_threshold": device_bytes(self.release_threshold, total, 256)}


def session(workers: int = 8, threads: int = 1, tiers: MemoryTiers | None = None, master: str | None = None, **conf) -> SparkSession:
    """A session with AQE, UTC and as many shuffle partitions as threads at least; on a cluster, `workers` executors of `threads` cores."""
    if workers < 1 or threads < 1:
        raise ValueError("there must be a worker and a thread")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(max(8, workers * threads)),
        "spark.ui.enabled": "false",
    }
    if master:
        settings |= {"spark.executor.instances": str(workers), "spark.executor.cores": str(threads)}
    settings |= (tiers.settings() if tiers else {}) | {k.replace("__", "."): str(v) for k, v in conf.items()}
    return prepared(SparkSession.builder.master(master or f"local[{workers * threads}]").config(map=settings).getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir; a new local one only where that is unset and Spark runs locally."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found := f"file://{tempfile.mkdtemp()}")
    return found.rstrip("/")


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table under a new name in the shared folder: whole whatever executors are lost, and not computed again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialised(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Persists and computes all rows and columns now."""
    df = df.persist(level)
    df.write.format("noop").mode("overwrite").save()
    return df


def configuration(spark: SparkSession, prefix: str = "spark.") -> DataFrame:
    """(key, value) of the settings in force: the report that a cluster's `config` command gives."""
    rows = {k: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith(prefix)} | {r["key"]: r["value"] for r in spark.sql("SET").collect() if r["key"].startswith(prefix)}
    return spark.createDataFrame(sorted(rows.items()), "key string, value string")


def executors(spark: SparkSession) -> DataFrame:
    """(address, memory_bytes, free_bytes) of each block manager."""
    found = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    it, rows = found.iterator(), []
    while it.hasNext():
        x = it.next()
        rows.append((x._1(), int(x._2()._1()), int(x._2()._2())))
    return spark.createDataFrame(sorted(rows), "address string, memory_bytes long, free_bytes long")


def wait_for_workers(spark: SparkSession, n: int, least: float = 10.0, each: float = 2.0, seconds: float | None = None) -> bool:
    """Whether n executors came within max(least, each * n) seconds, or `seconds`."""
    import time

    end = time.time() + (max(least, each * n) if seconds is None else seconds)
    have = lambda: spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size()
    while (ready := have() >= n) is False and time.time() < end:
        time.sleep(0.1)
    return ready
