"""The source with a partition for each row group."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import plan
from pyspark.sql import functions as F

from loomgrid.sources.groups import row_groups


@pytest.fixture
def folder(tmp_path):
    for k in range(3):
        rows = pa.table({"a": list(range(k * 100, k * 100 + 100)), "b": [f"s{v % 7}" for v in range(100)], "c": [None if v % 10 == 0 else v / 2 for v in range(100)]})
        pq.write_table(rows, tmp_path / f"part-{k}.parquet", row_group_size=25)
    (tmp_path / "notes.txt").write_text("no table")
    (tmp_path / "below").mkdir()
    pq.write_table(pa.table({"a": [1]}), tmp_path / "below" / "x.parquet")
    return tmp_path


def test_a_partition_for_each_row_group(spark, folder):
    df = row_groups(spark, str(folder))
    assert df.rdd.getNumPartitions() == 12 and df.count() == 300 and df.columns == ["a", "b", "c"]
    plain = spark.read.parquet(*[str(folder / f"part-{k}.parquet") for k in range(3)])
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert row_groups(spark, str(folder), first=2).count() == 200 and row_groups(spark, str(folder / "part-1.parquet")).count() == 100


def test_only_the_columns_asked_for_are_read(spark, folder):
    df = row_groups(spark, str(folder), "c", "a")
    assert df.columns == ["c", "a"] and df.agg(F.sum("a"), F.count("c")).first()[:] == (sum(range(300)), 270)
    assert "b#" not in plan(df)


@pytest.mark.parametrize("where, parts, rows", [("a >= 250", 2, 50), ("a > 274 and a < 280", 1, 5), ("a = 130", 1, 1), ("a in (3, 299)", 2, 2), ("a < 0", 0, 0), ("b = 's3'", 12, 42), ("c > 49", 3, 3), ("c is null", 12, 30), ("a <= 24 or a = 299", 12, 26)])
def test_filters_leave_out_row_groups(spark, folder, where, parts, rows):
    df = row_groups(spark, str(folder)).where(where)
    assert df.count() == rows and df.rdd.getNumPartitions() in ((parts,) if parts else (0, 1))


def test_a_folder_without_files_says_so(spark, tmp_path):
    with pytest.raises(Exception, match="no Parquet files"):
        row_groups(spark, str(tmp_path))
