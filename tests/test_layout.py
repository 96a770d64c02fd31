"""The clustered layout: lookups by either column open few row groups, and none are missed."""

import datetime as dt
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from faultline.sources import layout
from faultline.sources.derived import Tables

COLUMNS = ["test_id", "time_started"]


@pytest.fixture(scope="module")
def log(spark, sf_dir):
    return Tables(spark, sf_dir).test_actions().cache()


@pytest.fixture(scope="module")
def path(log, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "log")
    layout.append_clustered(log, path, COLUMNS, bits=6, rows_per_file=100)
    return path


def rows_read(df) -> int:
    """Rows that the scan gave, after skipping row groups."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numOutputRows").value()


def test_everything_is_kept(spark, log, path):
    back = layout.read_clustered(spark, path)
    assert back.columns == log.columns
    assert back.exceptAll(log).count() == 0 and log.exceptAll(back).count() == 0


@pytest.mark.parametrize("bounds", [
    {"test_id": (742, 742)},
    {"time_started": ("1998-03-01", "1998-03-02 01:00:00")},
    {"test_id": (100, 200), "time_started": ("1997-01-01", None)},
    {"time_started": (None, dt.datetime(1995, 2, 1))},
])
def test_lookups_skip_row_groups(spark, log, path, bounds):
    want = log
    for name, (first, last) in bounds.items():
        kind = dict(log.dtypes)[name]
        for bound, keep in ((first, F.col(name).__ge__), (last, F.col(name).__le__)):
            if bound is not None:
                want = want.filter(keep(F.lit(bound).cast(kind)))
    found = layout.read_clustered(spark, path, **bounds)
    assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0
    assert rows_read(layout.read_clustered(spark, path, **bounds)) <= log.count() / 3


def test_a_hot_test_is_divided_by_time(spark, tmp_path):
    base = F.lit(dt.datetime(2001, 6, 1)).cast("timestamp_ntz")
    hot = spark.range(0, 6000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("bigint").alias("test_id"),
        (base + F.make_dt_interval(mins=F.col("id") * 7919 % 6000)).alias("time_started"))
    path = str(tmp_path / "hot")
    layout.append_clustered(hot, path, COLUMNS, rows_per_file=50)
    files = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{path}/*.parquet")]
    assert sum(files) == 6000 and max(files) <= 3 * 50 and len(files) >= 90
    one_hour = {"test_id": (7, 7), "time_started": ("2001-06-02 00:00:00", "2001-06-02 01:00:00")}
    assert rows_read(layout.read_clustered(spark, path, **one_hour)) <= 6000 / 10


def test_ranks_count_the_cuts(spark):
    cuts = [1, 3, 3, 3, 8, 9, 20]
    values = [None, -5, 1, 2, 3, 7, 8, 19, 20, 1 << 60]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = [r[0] for r in df.select(layout.rank_among(F.col("v"), cuts)).collect()]
    assert got == [0 if v is None else sum(c <= v for c in cuts) for v in values]


def test_bits_alternate(spark):
    df = spark.createDataFrame([(0, 0), (0b11, 0), (0, 0b11), (0b10, 0b01)], "a int, b int")
    key = layout.interleaved([F.col("a"), F.col("b")], 2)
    assert [r[0] for r in df.select(key).collect()] == [0, 0b1010, 0b0101, 0b1001]


def test_empty_table_and_null_keys(spark, log, tmp_path):
    layout.append_clustered(log.limit(0), str(tmp_path / "none"), COLUMNS)
    assert layout.read_clustered(spark, str(tmp_path / "none"), test_id=(1, 2)).count() == 0
    unknown = log.limit(50).withColumns({c: F.lit(None).cast(dict(log.dtypes)[c]) for c in COLUMNS})
    layout.append_clustered(unknown.unionByName(log.limit(50)), str(tmp_path / "null"), COLUMNS)
    assert layout.read_clustered(spark, str(tmp_path / "null")).filter("test_id is null").count() == 50
    # A second append keeps the rows of the first one.
    layout.append_clustered(log.limit(20), str(tmp_path / "null"), COLUMNS)
    assert layout.read_clustered(spark, str(tmp_path / "null")).count() == 120
