"""Result files: names that overwrite nothing, results, peer matrix and address map, and the history of throughputs."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "date DATE, throughput DOUBLE"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def free_name(spark: SparkSession, base: str, day: datetime.date | None = None, endings: tuple[str, ...] = (".json", ".matrix", ".address_map.json")) -> str:
    """`base`, or if a file of that name with one of the endings is there, the first free of base-YYYYMMDD.0, .1, ..."""
    taken = lambda b: any(_exists(spark, b + e) for e in endings)
    name, k = base, 0
    while taken(name):
        name = f"{base}-{(day or datetime.date.today()):%Y%m%d}.{k}"
        k += 1
    return name


def save_results(base: str, tidy: DataFrame, matrix: DataFrame, addresses: DataFrame) -> str:
    """Writes the tidy table and the address map as JSON lines and the peer matrix as Parquet, under a free name, which it returns."""
    name = free_name(tidy.sparkSession, base)
    tidy.write.mode("errorifexists").json(name + ".json")
    matrix.write.mode("errorifexists").parquet(name + ".matrix")
    addresses.write.mode("errorifexists").json(name + ".address_map.json")
    return name


def append_history(spark: SparkSession, path: str, throughputs: list[float], day: datetime.date | None = None) -> None:
    """Adds (day, mean of the throughputs to two digits) to a CSV without header."""
    row = spark.createDataFrame([(day or datetime.date.today(), round(sum(throughputs) / len(throughputs), 2))], HISTORY)
    row.coalesce(1).write.mode("append").csv(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).csv(path).orderBy(F.col("date"))
