"""The transfer log as a stream: statistics of each pair of workers by windows of time, and over all of it so far.

Records have a time beside (worker, who, total, bandwidth). They are added up to partial statistics (counts, sums of
reciprocals and their squares, least, greatest, bytes, for each bucket of a histogram of bandwidths), which merge: a
window's are the merged ones of its batches, a pair's the merged ones of its windows. So what is held is a few numbers
for each bucket of an open window; a watermark closes windows, and what comes after it is left out of windows().

Two ways to follow a log: accumulated() keeps every record, late ones too, by partial statistics of each batch, and so
equals the batch over the same records after each trigger; windows() gives each window once, when it is closed.

Histograms have buckets of equal ratio, 2^(1/PER_OCTAVE) wide, so quantiles are known to within that ratio. Everything
else equals plans.telemetry.bandwidths() over the same records, up to the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.telemetry import STATISTICS

#: Buckets of a histogram for each doubling.
PER_OCTAVE = 16
#: What partial statistics hold beside the histogram, and how two of them merge.
MERGED = {"n": F.sum, "positive": F.sum, "reciprocals": F.sum, "squares": F.sum, "least": F.min, "most": F.max, "bytes": F.sum}


def _bucket(bandwidth: Column) -> Column:
    return F.floor(F.log2(bandwidth) * PER_OCTAVE).cast("int")


def partials(log: DataFrame, time: str, window: str, watermark: str, ignore_below: int | None = None) -> DataFrame:
    """(start, worker, who, bucket, MERGED): partial statistics of each window, pair and bucket; of a stream or a table.

    Records without a time belong to no window. A bandwidth that isn't above 0 has the null bucket and no reciprocal."""
    if ignore_below is not None:
        log = log.where(F.col("total") >= ignore_below)
    if log.isStreaming:
        log = log.withWatermark(time, watermark)
    b = F.col("bandwidth")
    inverse = F.when(b > 0, 1 / b)
    rows = log.groupBy(F.window(time, window).alias("w"), "worker", "who", F.when(b > 0, _bucket(b)).alias("bucket")).agg(
        F.count("*").alias("n"), F.count(inverse).alias("positive"), F.sum(inverse).alias("reciprocals"), F.sum(inverse * inverse).alias("squares"),
        F.min("bandwidth").alias("least"), F.max("bandwidth").alias("most"), F.sum("total").alias("bytes"))
    return rows.select(F.col("w.start").alias("start"), "worker", "who", "bucket", *MERGED)


def windows(log: DataFrame, time: str, path: str, checkpoint: str, window: str = "10 minutes", watermark: str = "30 minutes", ignore_below: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts (or, with the same checkpoint, goes on with) a stream that writes each window's partial statistics to a folder, once, when the watermark has passed it.

    The state store holds the open windows. The file sink commits a batch's files as a whole, so after a restart nothing
    is missing and nothing counts twice."""
    rows = partials(log, time, window, watermark, ignore_below)
    return _started(rows.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, available_now)


def accumulated(log: DataFrame, time: str, path: str, checkpoint: str, window: str = "10 minutes", ignore_below: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts (or goes on with) a stream that writes the partial statistics of each batch to a folder of its own: no state, and late records count as well.

    A batch that runs again after a failure has the same number and writes its folder anew, so each record counts once."""

    def keep(batch: DataFrame, number: int) -> None:
        partials(batch, time, window, "0 seconds", ignore_below).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _started(log.writeStream.foreachBatch(keep), checkpoint, available_now)


def _started(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Partial statistics of the same keys and bucket as one."""
    return parts.groupBy(*keys, "bucket").agg(*[merge(c).alias(c) for c, merge in MERGED.items()])


def summarised(parts: DataFrame, *keys: str) -> DataFrame:
    """(keys, STATISTICS) from partial statistics: keys are worker and who, with start for each window.

    Quantiles are the middles of the buckets that hold their ranks, kept within the least and the greatest value."""
    keys = keys or ("worker", "who")
    hist = merged(parts, *keys)
    entry = F.struct("bucket", "positive")
    sums = hist.groupBy(*keys).agg(*[merge(c).alias(c) for c, merge in MERGED.items()], F.sort_array(F.collect_list(F.when(F.col("bucket").isNotNull(), entry))).alias("hist"))  # a bucket each: some hundreds
    mean = F.col("reciprocals") / F.col("positive")
    # population variance from sums; rounding may leave less than 0
    variance = F.greatest(F.col("squares") / F.col("positive") - mean * mean, F.lit(0.0))
    seen = F.transform("hist", lambda _, k: F.aggregate(F.slice("hist", F.lit(1), k + 1), F.lit(0).cast("long"), lambda a, h: a + h["positive"]))
    rows = sums.withColumn("seen", seen)

    def quantile(q: float) -> Column:
        rank = F.floor(F.lit(q) * (F.col("positive") - 1))
        at = F.size(F.filter("seen", lambda s: s <= rank))
        middle = F.pow(F.lit(2.0), (F.get("hist", at)["bucket"] + 0.5) / PER_OCTAVE)
        return F.greatest(F.least(middle, F.col("most")), F.col("least"))

    out = {
        "bandwidth_hmean": F.coalesce(1 / mean, F.lit(0.0)), "bandwidth_hstd": F.coalesce(F.sqrt(variance / (F.col("positive") * F.pow(mean, F.lit(4.0)))), F.lit(0.0)),
        "bandwidth_q25": quantile(0.25), "bandwidth_q50": quantile(0.5), "bandwidth_q75": quantile(0.75), "bandwidth_min": F.col("least"), "bandwidth_max": F.col("most"), "bandwidth_median": quantile(0.5), "total_bytes": F.col("bytes"),
    }
    return rows.select(*keys, *[out[s].alias(s) for s in STATISTICS])
