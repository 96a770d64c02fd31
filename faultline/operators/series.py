"""Chart series from failure-rate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.numbers import int_percent
from faultline.functions.times import Bucket, instant


def series_rows(report: DataFrame, bucket: Bucket, *, key: str, labels: list[str],
                environ: str | None = None) -> DataFrame:
    """Tidy series: one row per series and time, integer percent; other labels are dropped."""
    if environ is not None:
        report = report.filter(F.col("environ_name") == environ)
    kept = report.filter(F.col(key).isin(*labels))
    return kept.select(F.col(key).alias("series"), bucket.parse(F.col("my_date")).alias("point"),
                       int_percent(F.col("failure_rate")).alias("pct"))


def series_wide(rows: DataFrame, labels: list[str]) -> DataFrame:
    """One column per series, in the given order."""
    return rows.groupBy("point").pivot("series", labels).agg(F.max("pct")).orderBy("point")


def date_spine(as_of, days: int = 100, ahead: int = 0) -> Column:
    """Array of the last ``days`` days up to ``as_of`` and ``ahead`` days after it."""
    today = instant(as_of).cast("date")
    return F.sequence(F.date_sub(today, days - 1), F.date_add(today, ahead),
                      F.make_dt_interval(F.lit(1)))


def zero_filled(rows: DataFrame, as_of, days: int = 100, ahead: int = 0) -> DataFrame:
    """Series with a point for every day of the spine, 0 where there was no test.

    The spine is the chart's axis: points outside it do not appear, so ``days`` is one more than
    the lookback in days of the report that is shown whole.
    """
    labels = rows.select("series").distinct()
    spine = labels.select("series", F.explode(date_spine(as_of, days, ahead)).alias("day"))
    daily = rows.select("series", F.col("point").cast("date").alias("day"), "pct")
    return spine.join(daily, ["series", "day"], "left").select(
        "series", "day", F.coalesce("pct", F.lit(0)).alias("pct"))


def labels_of(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).alias("label")).distinct()
