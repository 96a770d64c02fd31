"""Latency reports by concurrency, zone and region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.numbers import nullif_zero, ratio
from faultline.functions.times import within
from faultline.operators.failures import recent_passes

TIMINGS = ["time_total", "time_to_active", "time_to_ping", "time_to_ssh"]


def latency_by(passes: DataFrame, results: DataFrame, *, keys: tuple[str, ...],
               order: tuple[str, ...], as_of, lookback: tuple[int, str],
               environ: str | None = None, loose: tuple[str, ...] = (),
               error_counts: bool = False) -> DataFrame:
    """Average timings per pass attributes and concurrency, without the "never" zeros.

    Sums and counts are taken per pass before the join and combined after it.
    """
    counted = ["hard_error_count", "soft_error_count"] if error_counts else []
    tests = within(results, as_of, lookback)
    per_pass = tests.groupBy("test_pass_id", "concurrency_count").agg(
        F.count("*").alias("n"),
        F.sum("hard_errors_exist").alias("failed"),
        *[F.sum(nullif_zero(F.col(c))).alias(f"{c}_sum") for c in TIMINGS],
        *[F.count(nullif_zero(F.col(c))).alias(f"{c}_n") for c in TIMINGS],
        *[F.sum(c).alias(c) for c in counted],
    )
    recent = recent_passes(passes, as_of, lookback, environ)
    joined = per_pass.join(recent.select("test_pass_id", *keys, *loose), "test_pass_id")
    return joined.groupBy(*keys, "concurrency_count").agg(
        F.sum("n").alias("total_booted"),
        *[F.min(c).alias(c) for c in loose],
        *[ratio(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(f"avg_{c}") for c in TIMINGS],
        ratio(F.sum("failed"), F.sum("n")).alias("pct_error"),
        *[F.sum(c).alias(c) for c in counted],
    ).orderBy(*order)


def latency_by_concurrency(results: DataFrame) -> DataFrame:
    """Average timings per concurrency over all tests, zeros included."""
    return results.groupBy("concurrency_count").agg(
        F.count("*").alias("total_nodes"),
        *[F.avg(c).alias(f"avg_{c}") for c in TIMINGS],
        F.avg("hard_errors_exist").alias("avg_error"),
    ).orderBy("concurrency_count")
