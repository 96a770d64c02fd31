"""Stored tables: schema creation, appends, versioned rewrites, series output."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.errors import normalize_no_error
from faultline.sources.schemas import TABLES

# Column that gives the date partition of each table that has one.
PARTITION_SOURCE = {
    "test_passes": "time_started",
    "test_results": "time_started",
    "test_actions": "time_started",
    "build_details": "start_date",
}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a session on one machine may go without that setting; it uses its warehouse folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "runs")
    return f"{root.rstrip('/')}/faultline-{uuid.uuid4().hex}"


def create_tables(spark: SparkSession, database: str, drop: bool = False) -> None:
    """Create every table of the schema; existing ones stay unless ``drop`` is set."""
    if drop:
        spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in TABLES.items():
        empty = spark.createDataFrame([], schema)
        writer = with_date(empty, name).write.mode("ignore").format("parquet")
        if name in PARTITION_SOURCE:
            writer = writer.partitionBy("event_date")
        writer.saveAsTable(f"{database}.{name}")


def with_date(df: DataFrame, table: str) -> DataFrame:
    """Add the partition column, the day."""
    if table not in PARTITION_SOURCE:
        return df
    return df.withColumn("event_date", F.col(PARTITION_SOURCE[table]).cast("date"))


def append(df: DataFrame, root: str, table: str) -> None:
    """Append rows as typed parquet below ``root``, one folder per day.

    Rebalancing on the date keeps files near the advisory size: busy days are split over many
    tasks and quiet days share one. All spellings of "no error" are stored as the empty type.
    """
    columns = [f.name for f in TABLES[table].fields]
    dated = with_date(df.select(*columns), table)
    if "error_type" in columns:
        dated = dated.withColumn(
            "error_type", F.coalesce(normalize_no_error(F.col("error_type")), F.lit("")))
    if table in PARTITION_SOURCE:
        dated = dated.hint("rebalance", "event_date")
        dated.write.mode("append").partitionBy("event_date").parquet(f"{root}/{table}")
    else:
        dated.hint("rebalance").write.mode("append").parquet(f"{root}/{table}")


def append_test(results: DataFrame, actions: DataFrame, root: str) -> None:
    """Append results and their actions.

    Actions go first: a crash in between leaves actions without a result, which the orphan
    check reports, instead of results whose actions are silently missing.
    """
    append(actions, root, "test_actions")
    append(results, root, "test_results")


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Store a catalog table bucketed and sorted on a join key, so that tables with the same
    layout join on it without a shuffle."""
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))


def rewrite(df: DataFrame, root: str, table: str, version: int) -> str:
    """Write a full new version next to the old one; the source is never overwritten."""
    path = f"{root}/{table}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_series(series: DataFrame, path: str) -> None:
    """Chart series as tidy rows, one folder per series."""
    series.hint("rebalance", "series").write.mode("overwrite").partitionBy("series").parquet(path)


def print_table(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)
