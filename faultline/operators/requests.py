"""Request counts, rates and duration statistics over the action log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.errors import is_success
from faultline.functions.times import within


def actions_per_env(passes: DataFrame, results: DataFrame, actions: DataFrame, *, as_of,
                    lookback: tuple[int, str]) -> DataFrame:
    """Requests inside the lookback per environment."""
    per_test = within(actions, as_of, lookback).groupBy("test_id").agg(F.count("*").alias("n"))
    per_pass = per_test.join(results.select("test_id", "test_pass_id"), "test_id").groupBy(
        "test_pass_id").agg(F.sum("n").alias("n"))
    return (per_pass.join(passes.select("test_pass_id", "environ_name"), "test_pass_id")
            .groupBy("environ_name").agg(F.sum("n").alias("requests")).orderBy("environ_name"))


def request_count(passes: DataFrame, results: DataFrame, actions: DataFrame, *, as_of,
                  lookback: tuple[int, str], environ: str) -> DataFrame:
    """Requests of one environment; one row, 0 when there were none."""
    of_env = passes.filter(F.col("environ_name") == environ)
    return actions_per_env(of_env, results, actions, as_of=as_of, lookback=lookback).agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"))


def request_rate(passes: DataFrame, results: DataFrame, actions: DataFrame, *, as_of,
                 minutes: int, environ: str) -> DataFrame:
    """Requests per second of one environment over the last minutes, two digits."""
    counted = request_count(passes, results, actions, as_of=as_of, lookback=(minutes, "minute"),
                            environ=environ)
    rate = F.col("requests").cast("decimal(20,0)") / F.lit(minutes * 60).cast("decimal(10,0)")
    return counted.select(F.lit(environ).alias("environ_name"),
                          F.round(rate, 2).cast("double").alias("rps"))


def ssh_duration_stats(actions: DataFrame) -> DataFrame:
    """Duration of successful logins, the base for a timeout setting."""
    ok = actions.filter((F.col("function_name") == "ssh") & is_success(F.col("error_type")))
    return ok.agg(F.count("*").alias("total_ssh_calls"), F.avg("time_total").alias("time_avg"),
                  F.max("time_total").alias("time_max"), F.min("time_total").alias("time_min"))


def avg_time_of(actions: DataFrame, function: str = "wait_for_active_status") -> DataFrame:
    return actions.filter(F.col("function_name") == function).agg(
        F.count("*").alias("calls"), F.avg("time_total").alias("avg_time_total"))


def actions_of(actions: DataFrame, function: str) -> DataFrame:
    """Action rows of one function."""
    return actions.filter(F.col("function_name") == function)
