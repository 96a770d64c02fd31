"""Consecutive-failure alerts over build records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_builds(builds: DataFrame, n: int) -> DataFrame:
    """The last ``n`` builds of every job by end time, ties broken by id.

    Spark limits each job to ``n`` rows per task before the shuffle, so a job that owns most
    of the records does not fill one task.
    """
    w = Window.partitionBy("name").orderBy(F.col("end_date").desc(), F.col("id").desc())
    return builds.select("name", "id", "end_date", "result").withColumn(
        "rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def failures_in_last(builds: DataFrame, n: int, failed: str = "FAILURE") -> DataFrame:
    """Failed builds among the last ``n`` of every job."""
    return last_builds(builds, n).groupBy("name").agg(
        F.count_if(F.col("result") == failed).alias("failures"))


def sequential_failures(builds: DataFrame, n: int = 3, threshold: int | None = None,
                        failed: str = "FAILURE") -> DataFrame:
    """Jobs to alert on: at least ``threshold`` failures among the last ``n`` builds."""
    return failures_in_last(builds, n, failed).filter(
        F.col("failures") >= (n if threshold is None else threshold)).orderBy("name")


def job_failures(builds: DataFrame, job: str, n: int, failed: str = "FAILURE") -> DataFrame:
    """Failures among the last ``n`` builds of one job, as one number."""
    newest = (builds.filter(F.col("name") == job)
              .orderBy(F.col("end_date").desc(), F.col("id").desc()).limit(n))
    return newest.agg(F.count_if(F.col("result") == failed).alias("failures"))
