"""What runs on every worker at once, and what the workers moved: shuffle, spill and memory as Spark counts them."""

from __future__ import annotations

import json
import socket
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def on_every_slot(spark: SparkSession, f: Callable[[int], object], slots: int | None = None) -> DataFrame:
    """(slot, host, result as JSON): f(slot) run by `slots` tasks that all run at the same time (a barrier stage), as many as there are slots unless told otherwise.

    Fails where the cluster has fewer slots. An executor may hold several of them."""
    n = slots or spark.sparkContext.defaultParallelism

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([socket.gethostname()]), pa.array([json.dumps(f(k))])], ["slot", "host", "result"])

    return spark.range(0, n, 1, n).mapInArrow(run, "slot long, host string, result string", barrier=True)


def submitted(spark: SparkSession, f: Callable[[object], object], items: Sequence) -> DataFrame:
    """(item, result as JSON), in the order of items: f(item) run by a task for each item, on whichever worker is free; a lost one runs again."""

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([json.dumps(f(items[k]))])], ["item", "result"])

    return spark.range(0, len(items), 1, max(1, len(items))).mapInArrow(run, "item long, result string")


def moved(spark: SparkSession) -> dict[str, int]:
    """Bytes and rows over all stages so far that Spark still knows of: read from sources, shuffled, spilled from memory and to disk."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    names = {"input_bytes": "inputBytes", "shuffle_read_bytes": "shuffleReadBytes", "shuffle_write_bytes": "shuffleWriteBytes", "shuffle_write_rows": "shuffleWriteRecords", "memory_spilled_bytes": "memoryBytesSpilled", "disk_spilled_bytes": "diskBytesSpilled"}
    out = dict.fromkeys(names, 0)
    for k in range(stages.size()):
        for name, get in names.items():
            out[name] += int(getattr(stages.apply(k), get)())
    return out


#: Columns of exchanges(), by stage.
EXCHANGES = "stage int, tasks int, input_rows long, read_rows long, read_bytes long, largest_read_rows long, median_read_rows double, written_rows long, written_bytes long, memory_spilled_bytes long, disk_spilled_bytes long"


def last_attempt(store, stage: int):
    """What Spark knows of a stage, or None where it has dropped it: of the stages beyond spark.ui.retainedStages the skipped ones go first."""
    try:
        return store.lastStageAttempt(stage)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "NoSuchElementException":
            raise
        return None


def exchanges(spark: SparkSession, action: Callable[[], object]) -> DataFrame:
    """EXCHANGES of the jobs that an action starts, a row for each stage that ran: what it read from and wrote to exchanges, the largest and the median task's share of what was read, and spill.

    Jobs are told apart by a tag, so what else the session runs meanwhile doesn't count. Where an exchange keeps its
    number of partitions (an explicit count, or AQE's coalescing off), a task's share is a partition."""
    sc, tag = spark.sparkContext, f"exchanges-{uuid.uuid4().hex}"
    sc.addJobTag(tag)
    try:
        action()
    finally:
        sc.removeJobTag(tag)
    scala = sc._jsc.sc()
    scala.listenerBus().waitUntilEmpty(60_000)
    store, gateway = scala.statusStore(), sc._gateway
    jobs = store.jobsList(None)
    own = [j for j in (jobs.apply(k) for k in range(jobs.size())) if j.jobTags().contains(tag)]
    stages = sorted({int(j.stageIds().apply(k)) for j in own for k in range(j.stageIds().size())})
    at = gateway.new_array(gateway.jvm.double, 2)
    at[0], at[1] = 0.5, 1.0
    rows = []
    known = {stage: x for stage in stages if (x := last_attempt(store, stage)) is not None}
    if len(stages) - len(known) > sum(int(j.numSkippedStages()) for j in own):
        raise RuntimeError("Spark has dropped stages that ran: raise spark.ui.retainedStages")
    for stage, x in known.items():
        if x.status().toString() != "COMPLETE":  # skipped: an earlier one's files were at hand
            continue
        found = store.taskSummary(stage, x.attemptId(), at)
        shares = found.get().shuffleReadMetrics().readRecords() if found.isDefined() else None
        median, largest = (float(shares.apply(0)), int(shares.apply(1))) if shares is not None else (0.0, 0)
        rows.append((stage, x.numCompleteTasks(), *map(int, (x.inputRecords(), x.shuffleReadRecords(), x.shuffleReadBytes())), largest, median, *map(int, (x.shuffleWriteRecords(), x.shuffleWriteBytes(), x.memoryBytesSpilled(), x.diskBytesSpilled()))))
    return spark.createDataFrame(rows, EXCHANGES)


def tiers(spark: SparkSession) -> DataFrame:
    """(executor, memory_bytes, disk_bytes, memory_limit): bytes of persisted blocks that each executor holds in memory and on disk."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    rows = [(x.id(), int(x.memoryUsed()), int(x.diskUsed()), int(x.maxMemory())) for x in (found.apply(k) for k in range(found.size()))]
    return spark.createDataFrame(sorted(rows), "executor string, memory_bytes long, disk_bytes long, memory_limit long")
