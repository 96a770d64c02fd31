"""Sources and restart-safe sinks of the streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.sources.storage import shared_dir


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet",
                schema: T.StructType | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, with a fixed schema."""
    if schema is None:
        schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


@dataclass(frozen=True)
class StreamRun:
    """Where a run keeps its data and its checkpoint; running again resumes it."""

    root: str

    @property
    def data(self) -> str:
        return f"{self.root}/data"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    @staticmethod
    def new(spark: SparkSession) -> "StreamRun":
        return StreamRun(shared_dir(spark))


@contextmanager
def settings_of(spark: SparkSession, settings: dict[str, str] | None) -> Iterator[None]:
    """The session with ``settings``; a stream copies them when it starts."""
    before = {key: spark.conf.get(key, None) for key in settings or {}}
    try:
        for key, value in (settings or {}).items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_updates(stream: DataFrame, run: StreamRun, settings: dict[str, str] | None = None) -> None:
    """Process everything available and store the changed rows of each batch.

    Every batch owns one folder and overwrites it, so a batch that runs again after a failure
    leaves the same rows. The stream starts with ``settings`` in place of the session's own.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run.data}/batch_id={batch_id}")

    with settings_of(stream.sparkSession, settings):
        started = (stream.writeStream.outputMode("update").foreachBatch(store)
                   .option("checkpointLocation", run.checkpoint).trigger(availableNow=True).start())
    started.awaitTermination()


def latest_rows(spark: SparkSession, run: StreamRun, schema: T.StructType,
                keys: list[str]) -> DataFrame:
    """Current value of every key of an update-mode run."""
    numbered = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    stored = spark.read.schema(numbered).parquet(run.data)
    values = [c for c in stored.columns if c not in (*keys, "batch_id")]
    newest = stored.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.col("batch_id")).alias("row"))
    return newest.select(*keys, *[F.col(f"row.{c}").alias(c) for c in values])


def run_appends(stream: DataFrame, run: StreamRun, settings: dict[str, str] | None = None) -> None:
    """Process everything available and append final rows as parquet; ``settings`` as above."""
    with settings_of(stream.sparkSession, settings):
        started = (stream.writeStream.outputMode("append").format("parquet")
                   .option("path", run.data).option("checkpointLocation", run.checkpoint)
                   .trigger(availableNow=True).start())
    started.awaitTermination()
