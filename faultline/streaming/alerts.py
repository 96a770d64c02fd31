"""Alert streams: consecutive build failures and orphaned addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators.builds import failures_in_last, last_builds
from faultline.streaming.sinks import StreamRun

BUILD_COLUMNS = ["name", "id", "end_date", "result"]


def run_sequential_failures(builds: DataFrame, run: StreamRun, n: int = 3) -> None:
    """Keep the last ``n`` builds of every job across batches.

    Each batch merges its rows with the kept rows of the batch before and writes the new kept
    rows. Two folders take turns, so a repeated batch finds the state it began with and no more
    than two states are stored. The merge is a top-n per job, limited per task before the
    shuffle: a busy job is not sent to one task.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*BUILD_COLUMNS)
        if batch_id > 0:
            kept = batch.sparkSession.read.schema(rows.schema).parquet(
                f"{run.data}/turn={(batch_id - 1) % 2}")
            rows = rows.unionByName(kept)
        kept = last_builds(rows, n).select(*BUILD_COLUMNS, F.lit(batch_id).cast("long").alias("batch_id"))
        kept.write.mode("overwrite").parquet(f"{run.data}/turn={batch_id % 2}")

    (builds.writeStream.foreachBatch(merge).option("checkpointLocation", run.checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def current_failures(spark: SparkSession, run: StreamRun, schema, n: int = 3,
                     failed: str = "FAILURE") -> DataFrame:
    """Failures among the kept builds after the newest batch."""
    kept = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(run.data)
    newest = kept.agg(F.max("batch_id")).scalar()
    return failures_in_last(kept.filter(F.col("batch_id") == newest), n, failed)


def orphaned_ip_stream(events: DataFrame, *, wait_seconds: int = 120,
                       delay: str = "10 minutes") -> DataFrame:
    """Addresses that were detached and not attached again within the wait.

    A left outer interval join; unmatched rows appear once the watermark has passed the
    interval, so rows that are late by up to ``delay`` still count. The newest rows stay in
    state until later events come, or the rows of ``end_of_input``.
    """
    detached, attached = _sides(events, wait_seconds)
    joined = detached.withWatermark("detached_at", delay).join(
        attached.withWatermark("attached_at", delay), _reattached(wait_seconds), "left_outer")
    return joined.filter(F.col("attached_at").isNull()).select(
        "ip", F.col("detached_at").cast("timestamp_ntz").alias("detached_at"))


def end_of_input(events: DataFrame, *, wait_seconds: int = 120,
                 delay: str = "10 minutes") -> DataFrame:
    """Two events that close an input: an address without name is detached and attached again, so
    much later than the newest event that the watermark passes the waits of all others."""
    ahead = F.expr(f"INTERVAL {delay}") + F.expr(f"INTERVAL '{2 * wait_seconds}' SECOND")
    last = events.agg((F.max("event_time") + ahead).alias("at")).filter("at IS NOT NULL")
    pair = [F.struct((F.col("at") + F.expr(f"INTERVAL '{i}' SECOND")).alias("event_time"),
                     F.lit(kind).alias("kind")) for i, kind in enumerate(("detach", "attach"))]
    return last.select(F.explode(F.array(*pair)).alias("e")).select(
        F.lit("").alias("ip"), "e.event_time", "e.kind").select(*events.columns)


def orphaned_ips_batch(events: DataFrame, *, wait_seconds: int = 120) -> DataFrame:
    """The same selection over stored events, as an anti join."""
    detached, attached = _sides(events, wait_seconds)
    return detached.join(attached, _reattached(wait_seconds), "left_anti").select(
        "ip", F.col("detached_at").cast("timestamp_ntz").alias("detached_at"))


def _sides(events: DataFrame, wait_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Detach and attach events keyed by address and time slot.

    A slot is as long as the wait, so an attach event answers detach events of its own slot
    and of the one before. Joining on address and slot spreads a busy address over its slots
    and compares only neighbouring events.
    """
    timed = events.select("ip", "kind", F.col("event_time").cast("timestamp").alias("at"))
    slot = F.floor(F.unix_seconds("at") / wait_seconds).cast("bigint")
    detached = timed.filter(F.col("kind") == "detach").select(
        "ip", F.col("at").alias("detached_at"), slot.alias("slot"))
    attached = timed.filter(F.col("kind") == "attach").select(
        F.col("ip").alias("attached_ip"), F.col("at").alias("attached_at"),
        F.explode(F.array(slot - 1, slot)).alias("attached_slot"))
    return detached, attached


def _reattached(wait_seconds: int):
    until = F.col("detached_at") + F.expr(f"INTERVAL '{wait_seconds}' SECOND")
    return (
        (F.col("ip") == F.col("attached_ip")) & (F.col("slot") == F.col("attached_slot"))
        & (F.col("attached_at") > F.col("detached_at")) & (F.col("attached_at") <= until))
