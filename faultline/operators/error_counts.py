"""Error-type counts over actions, their tests and passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.errors import is_error, is_legacy_error, is_reportable
from faultline.functions.text import extract_bad_ip
from faultline.functions.times import Bucket, instant, interval, until, within
from faultline.operators.failures import recent_passes


def tests_in_context(passes: DataFrame, results: DataFrame, *, as_of=None,
                     lookback: tuple[int, str] | None = None, environ: str | None = None,
                     min_concurrency: int | None = None, test_columns: tuple[str, ...] = (),
                     pass_columns: tuple[str, ...] = ()) -> DataFrame:
    """Tests with columns of their pass. Without a condition on the passes a test whose pass is
    unknown stays, with NULLs."""
    recent = recent_passes(passes, as_of, lookback, environ)
    how = "left" if lookback is None and environ is None else "inner"
    tests = within(results, as_of, lookback)
    if min_concurrency is not None:
        tests = tests.filter(F.col("concurrency_count") >= min_concurrency)
    return tests.select("test_id", "test_pass_id", *test_columns).join(
        recent.select("test_pass_id", *pass_columns), "test_pass_id", how).drop("test_pass_id")


def recent_log(actions: DataFrame, as_of, lookback: tuple[int, str] | None) -> DataFrame:
    """The actions that a report over the lookback can hold. In a stored log an action starts no
    earlier than its test, so of a log that carries its date only the days of the lookback are
    read; a log without dates is cut at its end alone."""
    if lookback is not None and "event_date" in actions.columns:
        first = (instant(as_of) - interval(*lookback)).cast("date")
        actions = actions.filter(F.col("event_date") >= first)
    return until(actions, as_of)


def errors_per_test(actions: DataFrame, keep: Column, as_of, keys: tuple[str, ...],
                    loose: tuple[str, ...] = (), lookback: tuple[int, str] | None = None
                    ) -> DataFrame:
    """Errors counted per test and ``keys`` before any join: the log is combined where it is
    read, so a test that owns much of it becomes a few rows."""
    return (recent_log(actions, as_of, lookback).filter(keep).groupBy("test_id", *keys)
            .agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in loose]))


def error_counts(passes: DataFrame, results: DataFrame, actions: DataFrame, *,
                 keys: tuple[str, ...], count_name: str = "func_error_count", keep=None,
                 as_of=None, lookback: tuple[int, str] | None = None,
                 environ: str | None = None, min_concurrency: int | None = None,
                 loose: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """Errors per chosen columns of the action, the test and the pass, most frequent first
    within ``order``; ``loose`` columns show their smallest value."""
    wanted = [*keys, *loose]
    errors = errors_per_test(
        actions, is_error(F.col("error_type")) if keep is None else keep, as_of,
        keys=tuple(c for c in keys if c in ACTION_COLUMNS),
        loose=tuple(c for c in loose if c in ACTION_COLUMNS), lookback=lookback)
    tests = tests_in_context(
        passes, results, as_of=as_of, lookback=lookback, environ=environ,
        min_concurrency=min_concurrency,
        test_columns=tuple(c for c in wanted if c in TEST_COLUMNS),
        pass_columns=tuple(c for c in wanted if c in PASS_COLUMNS))
    counted = errors.join(tests, "test_id").groupBy(*keys).agg(
        F.sum("n").alias(count_name), *[F.min(c).alias(c) for c in loose])
    return counted.orderBy(*order, F.col(count_name).desc(), *keys)


ACTION_COLUMNS = {"function_name", "error_type", "error_text"}
TEST_COLUMNS = {"concurrency_count", "test_name"}
PASS_COLUMNS = {"environ_name", "zone", "region"}


def errors_by_bucket(passes: DataFrame, results: DataFrame, actions: DataFrame, *,
                     bucket: Bucket, as_of, lookback: tuple[int, str], environ: str,
                     min_concurrency: int, zone: bool = False) -> DataFrame:
    """Reportable errors per time bucket of the test, error type and concurrency, optionally
    per zone; the smallest function name of each group is shown."""
    zones = ("zone",) if zone else ()
    errors = errors_per_test(actions, is_reportable(F.col("error_type")), as_of,
                             keys=("error_type",), loose=("function_name",), lookback=lookback)
    tests = tests_in_context(
        passes, results, as_of=as_of, lookback=lookback, environ=environ,
        min_concurrency=min_concurrency, test_columns=("concurrency_count", "time_started"),
        pass_columns=zones)
    groups = [*zones, "error_type", "concurrency_count"]
    return (
        errors.join(tests, "test_id")
        .groupBy(bucket.start(F.col("time_started")).alias("s"), *groups)
        .agg(F.sum("n").alias("n"), F.min("function_name").alias("function_name"))
        .groupBy(bucket.label(F.col("s")).alias("my_date"), *groups)
        .agg(F.sum("n").alias("error_count"), F.min("function_name").alias("function_name"))
        .orderBy(F.col("my_date").desc(), F.col("error_count").desc(), *groups)
    )


def unpingable_ips(passes: DataFrame, results: DataFrame, actions: DataFrame, *, bucket: Bucket,
                   as_of, lookback: tuple[int, str], environ: str) -> DataFrame:
    """How often each address failed to answer, per day."""
    pings = actions.withColumn("bad_ip", extract_bad_ip(F.col("error_text")))
    errors = errors_per_test(pings, F.col("error_type") == "Ping Timeout", as_of,
                             keys=("bad_ip", "error_type"), lookback=lookback)
    tests = tests_in_context(
        passes, results, as_of=as_of, lookback=lookback, environ=environ,
        test_columns=("time_started",), pass_columns=("environ_name", "zone"))
    return (
        errors.join(tests, "test_id")
        .groupBy(bucket.label(bucket.start(F.col("time_started"))).alias("my_date"), "bad_ip")
        .agg(F.sum("n").alias("ip_used_x_times"),
             *[F.min(c).alias(c) for c in ("environ_name", "zone", "error_type")])
        .orderBy(F.col("my_date").desc(), "environ_name", "bad_ip")
    )


def recent_error_detail(passes: DataFrame, results: DataFrame, actions: DataFrame, *, as_of,
                        lookback: tuple[int, str]) -> DataFrame:
    """The error rows themselves."""
    tests = tests_in_context(passes, results, as_of=as_of, lookback=lookback,
                             pass_columns=("environ_name",))
    errors = recent_log(actions, as_of, lookback).filter(is_error(F.col("error_type")))
    return errors.join(tests, "test_id").select(
        "environ_name", "function_name", "error_type", "error_text")


def function_error_counts(actions: DataFrame) -> DataFrame:
    """Errors per function and type.

    Written against the tests as a left join on their unique id in SQL; that join neither
    adds nor removes action rows, so none is planned here.
    """
    return (actions.filter(is_error(F.col("error_type"))).groupBy("function_name", "error_type")
            .agg(F.count("*").alias("errors")).orderBy("function_name", "error_type"))


def error_type_histogram(actions: DataFrame) -> DataFrame:
    """Actions per error type, the empty and the missing type included."""
    return actions.groupBy("error_type").agg(F.count("*").alias("errors"))


def error_counts_not_none(results: DataFrame, actions: DataFrame) -> DataFrame:
    """Errors per type among actions of known tests, ``'None'`` and NULL left out."""
    known = actions.filter(F.col("error_type") != "None").join(
        results.select("test_id"), "test_id", "left_semi")
    return known.groupBy("error_type").agg(F.count("*").alias("errors"))


def error_counts_cross(passes: DataFrame, results: DataFrame, actions: DataFrame) -> DataFrame:
    """Error counts of the report whose join condition holds for every pass and test.

    Each matching row is counted once per pass, so the count is a product and the pairs are
    never built.
    """
    errors = actions.filter(is_error(F.col("error_type"))).join(
        results.select("test_id"), "test_id", "left_semi")
    n_passes = passes.agg(F.count("*")).scalar()
    environ = passes.agg(F.min("environ_name")).scalar()
    counted = errors.groupBy("error_type").agg(
        F.count("*").alias("n"), F.min("function_name").alias("function_name"))
    return counted.select(
        (F.col("n") * n_passes).alias("func_error_count"),
        environ.alias("environ_name"), "function_name", "error_type",
    ).orderBy(F.col("func_error_count").desc(), "error_type")


def tests_and_actions(results: DataFrame, actions: DataFrame) -> DataFrame:
    """Every test with its actions; tests without actions keep NULLs."""
    return results.select("test_id", "test_pass_id", "test_name").join(
        actions.select("test_id", "function_name",
                       F.col("time_started").alias("action_started"), "error_type"),
        "test_id", "left")


def recent_actions(results: DataFrame, actions: DataFrame, *, as_of,
                   lookback: tuple[int, str]) -> DataFrame:
    """Actions inside the lookback with the name of their test."""
    return within(actions, as_of, lookback).select("test_id", "function_name", "time_started").join(
        results.select("test_id", "test_name"), "test_id")


def distinct_errors(actions: DataFrame) -> DataFrame:
    return actions.select("error_type").distinct()


def legacy_errors(actions: DataFrame, mode: str = "faithful") -> DataFrame:
    """Action rows with an error, as the older layout spells it."""
    return actions.filter(is_legacy_error(F.col("error_type"), mode))
