"""Parquet scans: discovery, projection, a full scan that metadata can't answer, sizes on disk. All through Hadoop's file systems."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the options of one file system, as the other has them; fixed values.
S3_OPTIONS = {"key": "spark.hadoop.fs.s3a.access.key", "secret": "spark.hadoop.fs.s3a.secret.key", "token": "spark.hadoop.fs.s3a.session.token", "region": "spark.hadoop.fs.s3a.endpoint.region"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discovered(spark: SparkSession, folder: str, limit: int | None = None) -> list[str]:
    """Paths of the *.parquet entries right in a folder, sorted; the first `limit` of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/*.parquet")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(x.getPath()) for x in found or [])[:limit]


def scanned(spark: SparkSession, paths: Sequence[str], columns: str | Sequence[str] | None = None) -> DataFrame:
    """The rows of files, with only the columns asked for read from them."""
    df = spark.read.parquet(*paths)
    return df if columns is None else df.select(columns) if isinstance(columns, str) else df.select(*columns)


def opaque(df: DataFrame) -> DataFrame:
    """The same rows through a step that Catalyst can't see into, so that a count has to read every column asked for."""
    return df.mapInArrow(lambda batches: batches, df.schema)


def opaque_count(df: DataFrame) -> DataFrame:
    """(n): a count that reads all columns in full: it depends on a hash of every row, whose bits are then taken away. No column may hold maps, which have no hash."""
    bits = F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return df.agg((F.count("*") + F.coalesce(bits.bitwiseAND(F.lit(0)), F.lit(0))).alias("n"))


def on_disk(df: DataFrame) -> DataFrame:
    """(files, bytes) that a scan reads from, from the files' own listing."""
    files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).groupBy("p").agg(F.first("s").alias("s"))
    return files.agg(F.count("*").alias("files"), F.sum("s").alias("bytes"))


def scan_settings(split: int | None = None, pack: int | None = None) -> dict[str, str]:
    """Settings for the size of splits and for packing small files."""
    out = {}
    if split:
        out["spark.sql.files.maxPartitionBytes"] = str(split)
    if pack is not None:
        out["spark.sql.files.openCostInBytes"] = str(pack)
    return out


def store_settings(options: dict[str, str]) -> dict[str, str]:
    """Spark's settings for a store's options."""
    unknown = set(options) - set(S3_OPTIONS)
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    return {S3_OPTIONS[k]: v for k, v in options.items()}
