"""Requests per sliding window of event time, final once a watermark has passed the window.

A watermark stands ``delay`` behind the newest event of the batches before. A batch is counted per
test and window; counts of windows that the watermark had passed already are late and are stored
apart, so late rows are reported row by row and not lost. The others are added to the open counts.
Windows that the new watermark has passed are closed: appended once, never changed. State is the
open counts alone, whatever the history; attributes are joined on reading, so they may come later.

The last step of a batch is a numbered manifest; a batch that runs again begins at the one before
it. Ten folders of closed counts are written as one of the next level, so a row is rewritten once a
level and the number of folders grows with the logarithm of the batches. Rows without a time are in
no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.files import Folder
from faultline.streaming.rates import COMPACT, small_tasks, sweep
from faultline.streaming.sinks import StreamRun

_COUNTS = "test_id bigint, window_start timestamp_ntz, window_end timestamp_ntz, requests bigint"
_KEY = ["test_id", "window_start", "window_end"]
_EMPTY = {"closed": [], "late": [], "open": None, "watermark": None}


def _folders(state: dict) -> set[str]:
    named = [*state["closed"], *state["late"], *([state["open"]] if state["open"] else [])]
    return {name.split("/")[0] for name in named}


def _read(spark: SparkSession, run: StreamRun, folders: list[str]) -> DataFrame:
    return (spark.read.schema(_COUNTS).parquet(*[f"{run.data}/{f}" for f in folders]) if folders
            else spark.createDataFrame([], _COUNTS))


def _level(folder: str) -> int:
    return int(folder.split("-")[1]) if folder.startswith("level-") else 0


def _compacted(spark: SparkSession, run: StreamRun, live: list[str], kind: str, batch_id: int
               ) -> list[str]:
    level = 0
    while len(group := [f for f in live if _level(f) == level]) >= COMPACT:
        level += 1
        name = f"level-{level}-{kind}-{batch_id}"
        _read(spark, run, group).write.mode("overwrite").parquet(f"{run.data}/{name}")
        live = [f for f in live if f not in group] + [name]
    return live


def run_window_counts(actions: DataFrame, run: StreamRun, *, window: str = "60 seconds",
                      slide: str = "10 seconds", delay: str = "10 minutes") -> None:
    """Store the requests per test and sliding window of a stream of (test_id, time_started)."""

    def store(batch: DataFrame, batch_id: int) -> None:
        with small_tasks(batch, ["test_id", "time_started"]) as rows:
            count(rows, batch_id)

    def count(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        manifests = Folder(spark, f"{run.root}/manifest")
        earlier = [n for n in manifests.numbers() if n < batch_id]
        state = manifests.read(earlier[-1]) if earlier else _EMPTY
        newest = batch.agg(F.expr(f"CAST(max(time_started) AS timestamp_ntz) - INTERVAL {delay}")
                           .cast("string")).first()[0]
        passed = state["watermark"]
        # Written alike, year first, so the later one is the greater text.
        watermark = max(filter(None, (passed, newest)), default=None)
        counted = batch.groupBy("test_id", F.window("time_started", window, slide).alias("w")).agg(
            F.count("*").alias("requests")).select(
            "test_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"), "requests")
        if state["open"]:
            counted = counted.unionByName(_read(spark, run, [state["open"]]))
        by = lambda mark: F.col("window_end") <= F.lit(mark).cast("timestamp_ntz")
        folder = f"batch-{batch_id}"
        (counted.groupBy(*_KEY).agg(F.sum("requests").alias("requests"))
         .withColumn("part", F.when(by(passed), "late").when(by(watermark), "closed")
                     .otherwise("open"))
         .write.mode("overwrite").partitionBy("part").parquet(f"{run.data}/{folder}"))
        parts = manifests.folders(f"{run.data}/{folder}")
        made = lambda kind: [f"{folder}/part={kind}"] if f"part={kind}" in parts else []
        manifests.write(batch_id, {
            **{kind: _compacted(spark, run, state[kind] + made(kind), kind, batch_id)
               for kind in ("closed", "late")},
            "open": next(iter(made("open")), None), "watermark": watermark}, replace=True)
        sweep(manifests, run, _folders)

    (actions.writeStream.foreachBatch(store).option("checkpointLocation", run.checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def window_state(spark: SparkSession, run: StreamRun) -> dict:
    """The newest manifest: the folders of closed, late and open counts and the watermark."""
    manifests = Folder(spark, f"{run.root}/manifest")
    numbers = manifests.numbers()
    return manifests.read(numbers[-1]) if numbers else _EMPTY


def final_request_rates(spark: SparkSession, run: StreamRun, tests: DataFrame, seconds: int = 60
                        ) -> DataFrame:
    """Per environment and closed window of ``seconds``: requests, requests per second and how many
    more came too late for the window."""
    state = window_state(spark, run)
    counts = _read(spark, run, state["closed"]).withColumn("late", F.lit(0).cast("bigint"))
    late = _read(spark, run, state["late"]).select(
        *_KEY, F.lit(0).cast("bigint").alias("requests"), F.col("requests").alias("late"))
    summed = counts.unionByName(late).groupBy("test_id", "window_start").agg(
        F.sum("requests").alias("requests"), F.sum("late").alias("late"))
    return (summed.join(tests.select("test_id", "environ_name"), "test_id")
            .groupBy("window_start", "environ_name")
            .agg(F.sum("requests").alias("requests"), F.sum("late").alias("late_requests"))
            .withColumn("rps", F.col("requests") / F.lit(seconds)))
