"""Failure-rate reports over tests and their passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.numbers import ratio
from faultline.functions.times import Bucket, instant, micros, within


def recent_passes(passes: DataFrame, as_of, lookback: tuple[int, str] | None,
                  environ: str | None = None) -> DataFrame:
    """Passes started inside the lookback, optionally of one environment."""
    passes = within(passes, as_of, lookback)
    if environ is not None:
        passes = passes.filter(F.col("environ_name") == environ)
    return passes


def failure_rate(passes: DataFrame, results: DataFrame, *, bucket: Bucket, keys: tuple[str, ...],
                 as_of, lookback: tuple[int, str], environ: str | None = None,
                 loose: tuple[str, ...] = (), ascending: bool = False) -> DataFrame:
    """Tests, hard failures and failure rate per time bucket and pass attributes.

    Buckets use the start of the test, the lookback uses the start of its pass. A test starts
    no earlier than its pass, so the lookback cuts down the tests as well. ``loose`` names
    attributes shown without being grouped on; their smallest value is shown.
    """
    per_pass = within(results, as_of, lookback).groupBy(
        "test_pass_id", bucket.start(F.col("time_started")).alias("bucket_start")
    ).agg(F.count("*").alias("n"), F.sum("hard_errors_exist").alias("failed"))
    recent = recent_passes(passes, as_of, lookback, environ)
    joined = per_pass.join(recent.select("test_pass_id", *keys, *loose), "test_pass_id")
    label = bucket.label(F.col("bucket_start")).alias("my_date")
    tests, failed = F.sum("n"), F.sum("failed")
    report = joined.groupBy(label, *keys).agg(
        *[F.min(c).alias(c) for c in loose],
        tests.alias("total_tests"),
        failed.alias("total_failures"),
        ratio(failed, tests).alias("failure_rate"),
    )
    order = F.col("my_date").asc() if ascending else F.col("my_date").desc()
    columns = ["my_date", *sorted({*keys, *loose}), "total_tests", "total_failures",
               "failure_rate"]
    return report.select(*columns).orderBy(order, *keys)


def failure_rate_by_env(passes: DataFrame, results: DataFrame, *, as_of,
                        windows: tuple[int, ...]) -> DataFrame:
    """Tests and failure rate per environment for several lookbacks in one scan.

    Each pass is assigned to every lookback that covers it, after its tests were summed up.
    """
    per_pass = within(results, as_of, (max(windows), "day")).groupBy("test_pass_id").agg(
        F.count("*").alias("n"), F.sum("hard_errors_exist").alias("failed"))
    covering = F.filter(
        F.array(*[F.lit(w) for w in windows]),
        lambda days: F.col("time_started") > instant(as_of) - F.make_dt_interval(days))
    recent = recent_passes(passes, as_of, (max(windows), "day")).select(
        "test_pass_id", "environ_name", covering.alias("window_list"))
    return (
        per_pass.join(recent, "test_pass_id")
        .groupBy("environ_name", "window_list")
        .agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"))
        .select("environ_name", F.explode("window_list").alias("window_days"), "n", "failed")
        .groupBy("window_days", "environ_name")
        .agg(F.sum("n").alias("total_booted"),
             ratio(F.sum("failed"), F.sum("n")).alias("pct_error"))
        .orderBy("window_days", "environ_name")
    )


def failure_rate_moving_avg(passes: DataFrame, results: DataFrame, *, as_of, period: int,
                            days: int, environ: str | None = None) -> DataFrame:
    """Failure rate of the ``period`` days before each of the last ``days`` days.

    Day ``i`` covers passes with ``as_of - (i + period) d < start < as_of - i d``, both ends
    strict, and weighs every test alike.
    """
    lookback = (days - 1 + period, "day")
    per_pass = within(results, as_of, lookback).groupBy("test_pass_id").agg(
        F.count("*").alias("n"), F.sum("hard_errors_exist").alias("failed"))
    recent = recent_passes(passes, as_of, lookback, environ)
    per_start = (
        per_pass.join(recent.select("test_pass_id", "environ_name", "time_started"),
                      "test_pass_id")
        .groupBy("environ_name", "time_started")
        .agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"))
    )
    # Day i covers a start of age a if i < a < i + period, so from ``first`` to ``last``: a start
    # is one rise and one fall of a running sum over the days, however many it is covered by.
    day = 86_400_000_000
    age = micros(instant(as_of)) - micros(F.col("time_started"))
    over = age - F.lit(period * day)
    first = F.when(over >= 0, F.floor(over / day) + 1).otherwise(0).cast("int")
    last = F.least(F.floor((age - 1) / day), F.lit(days - 1)).cast("int")
    steps = per_start.select("environ_name", "n", "failed", first.alias("i"), last.alias("j")).filter(
        "i <= j").groupBy("environ_name", "i", "j").agg(
        F.sum("n").alias("n"), F.sum("failed").alias("failed"))
    rises = steps.select("environ_name", F.col("i").alias("days_ago"), "n", "failed")
    falls = steps.select("environ_name", (F.col("j") + 1).alias("days_ago"),
                         (-F.col("n")).alias("n"), (-F.col("failed")).alias("failed"))
    spine = steps.select("environ_name").distinct().select(
        "environ_name", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("days_ago"),
        F.lit(0).alias("n"), F.lit(0).alias("failed"))
    so_far = Window.partitionBy("environ_name").orderBy("days_ago").rowsBetween(
        Window.unboundedPreceding, 0)
    return (
        rises.union(falls).union(spine).filter(F.col("days_ago") < days)
        .groupBy("environ_name", "days_ago").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"))
        .select("environ_name", "days_ago", F.sum("n").over(so_far).alias("total_tests"),
                F.sum("failed").over(so_far).alias("failed"))
        .filter("total_tests > 0")
        .select("environ_name", "days_ago", "total_tests",
                ratio(F.col("failed"), F.col("total_tests")).alias("failure_rate"))
        .orderBy("environ_name", "days_ago")
    )


def tests_per_bucket(results: DataFrame, bucket: Bucket) -> DataFrame:
    """Tests per time bucket."""
    starts = results.groupBy(bucket.start(F.col("time_started")).alias("s")).agg(
        F.count("*").alias("n"))
    return (starts.groupBy(bucket.label(F.col("s")).alias("my_date"))
            .agg(F.sum("n").alias("total_tests")).orderBy("my_date"))


def tests_per_bucket_env(passes: DataFrame, results: DataFrame, bucket: Bucket) -> DataFrame:
    """Tests per time bucket and environment."""
    per_pass = results.groupBy(
        "test_pass_id", bucket.start(F.col("time_started")).alias("s")
    ).agg(F.count("*").alias("n"))
    return (per_pass.join(passes.select("test_pass_id", "environ_name"), "test_pass_id")
            .groupBy(bucket.label(F.col("s")).alias("my_date"), "environ_name")
            .agg(F.sum("n").alias("total_tests")).orderBy("my_date", "environ_name"))


def tests_per_env_name(passes: DataFrame, results: DataFrame, *, as_of,
                       lookback: tuple[int, str]) -> DataFrame:
    """Tests started inside the lookback per environment and test name."""
    per_pass = within(results, as_of, lookback).groupBy("test_pass_id", "test_name").agg(F.count("*").alias("n"))
    return (per_pass.join(passes.select("test_pass_id", "environ_name"), "test_pass_id")
            .groupBy("environ_name", "test_name").agg(F.sum("n").alias("total_tests"))
            .orderBy("environ_name", "test_name"))


def tests_with_pass(passes: DataFrame, results: DataFrame, *, as_of, lookback: tuple[int, str],
                    environ: str | None = None) -> DataFrame:
    """Test rows next to their pass attributes, the row form behind the rates."""
    recent = recent_passes(passes, as_of, lookback, environ).select(
        "test_pass_id", "environ_name", "zone", F.col("time_started").alias("pass_started"))
    tests = within(results, as_of, lookback)
    return tests.select("test_id", "test_pass_id", "time_started", "hard_errors_exist").join(
        recent, "test_pass_id")
