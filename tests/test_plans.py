"""Physical plans: what must and must not appear, and skewed inputs."""

import contextlib
import datetime as dt
import io
import re

import pytest
from pyspark.sql import functions as F

from faultline.functions.times import DAY_ISO
from faultline.operators import builds, error_counts, failures, ranks, requests
from faultline.plans.registry import queries
from faultline.sources import readers, storage
from faultline.sources.derived import AS_OF, Tables

STREAMED = {q for q in queries() if "stream" in q} | {"io6_series_output", "w1_append_results"}


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


@contextlib.contextmanager
def settings(spark, **values):
    old = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in values}
    for key, value in values.items():
        spark.conf.set(key.replace("__", "."), value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """The test-run tables as stored parquet."""
    root = str(tmp_path_factory.mktemp("stored"))
    tables = Tables(spark, sf_dir)
    for name in ["test_passes", "test_results", "test_actions"]:
        storage.append(getattr(tables, name)(), root, name)
    return {name: readers.read_table(spark, root, name)
            for name in ["test_passes", "test_results", "test_actions"]}


@pytest.mark.parametrize("name", sorted(set(queries()) - STREAMED))
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    plan = plan_of(queries()[name](spark, sf_dir))
    for operator in ["CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"]:
        assert operator not in plan


def test_report_is_aggregated_before_the_join(spark, stored):
    report = failures.failure_rate(
        stored["test_passes"], stored["test_results"], bucket=DAY_ISO,
        keys=("environ_name", "zone"), as_of=AS_OF, lookback=(90, "day"))
    plan = plan_of(report)
    assert plan.index("Join") < plan.index("partial_count(1)")
    assert "PushedFilters: [IsNotNull(time_started), GreaterThan(time_started" in plan


def test_reports_read_only_the_days_of_their_lookback(spark, sf_dir, tmp_path):
    """Stored tables that carry their date are pruned to the lookback, with the same answer."""
    tables, kept = Tables(spark, sf_dir), {}
    for name in ("test_passes", "test_results", "test_actions"):
        rows = getattr(tables, name)().filter("time_started > timestamp_ntz'2001-06-01'")
        storage.append(rows, str(tmp_path), name)
        kept[name] = readers.read_table(spark, str(tmp_path), name, dated=True)
    log = list(kept.values())
    back = {"as_of": AS_OF, "lookback": (7, "day")}
    reports = [
        failures.failure_rate(*log[:2], bucket=DAY_ISO, keys=("zone",), **back),
        error_counts.error_counts(*log, keys=("environ_name", "error_type"), **back),
        requests.actions_per_env(*log, as_of=AS_OF, lookback=(60, "minute")),
    ]
    reports += [
        error_counts.errors_by_bucket(*log, bucket=DAY_ISO, environ="ASIA", min_concurrency=1, **back),
        error_counts.unpingable_ips(*log, bucket=DAY_ISO, environ="ASIA", **back),
        error_counts.recent_error_detail(*log, **back),
    ]
    for report in reports:
        assert re.search(r"PartitionFilters: \[[^\]]*event_date", plan_of(report))
    # The error reports read no day of any table, the log included, outside the lookback.
    for report in [reports[1], *reports[3:]]:
        for filters in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan_of(report)):
            assert re.search(r"event_date#\d+ >= 2001-06-26", filters), filters
            assert re.search(r"event_date#\d+ <= 2001-07-03", filters), filters
    plain = [getattr(tables, n)() for n in kept]
    want = failures.failure_rate(*plain[:2], bucket=DAY_ISO, keys=("zone",), **back)
    assert reports[0].collect() == want.collect()


def test_last_builds_are_limited_before_the_shuffle(spark, sf_dir):
    plan = plan_of(builds.failures_in_last(Tables(spark, sf_dir).build_details(), 3))
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("Partial")


def test_percentiles_shuffle_the_log_once(spark, stored):
    found = ranks.percentile_rows(stored["test_actions"])
    found.collect()
    assert "ReusedExchange" in plan_of(found)


def test_top_rows_do_not_sort_everything(spark, stored):
    assert "TakeOrderedAndProject" in plan_of(
        ranks.top_rows(stored["test_actions"], [F.col("time_total").desc()], 5))


def test_hot_test_is_counted_before_the_join(spark):
    """One test owns a third of all error rows: it reaches the join as a few counted rows, so no
    partition need be split."""
    base = dt.datetime(2001, 6, 30)
    started = F.lit(base).cast("timestamp_ntz").alias("time_started")
    passes = spark.createDataFrame(
        [(i, "E", "z", base) for i in range(20)],
        "test_pass_id long, environ_name string, zone string, time_started timestamp_ntz")
    results = spark.range(30_000).select(
        F.col("id").alias("test_id"), (F.col("id") % 20).alias("test_pass_id"), started)
    test_id = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 30_000)
    actions = spark.range(0, 120_000, 1, 16).select(
        test_id.cast("long").alias("test_id"), started,
        F.concat(F.lit("e"), (F.col("id") % 5).cast("string")).alias("error_type"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1",
                  spark__sql__adaptive__skewJoin__enabled="false"):
        counted = error_counts.error_counts(
            passes, results, actions, keys=("environ_name", "error_type"), as_of=AS_OF,
            lookback=(7, "day"))
        assert sum(r.func_error_count for r in counted.collect()) == 120_000
        plan = plan_of(counted)
    join = plan.index("SortMergeJoin")
    assert "partial_count(1)" in plan[join:] and "partial_count(1)" not in plan[:join]


def test_hot_pass_reaches_the_join_as_few_rows(spark):
    """Half of all tests belong to one pass; the shuffle carries partial sums only."""
    base = dt.datetime(2001, 6, 30)
    passes = spark.createDataFrame(
        [(i, "E", "z", base) for i in range(50)],
        "test_pass_id long, environ_name string, zone string, time_started timestamp_ntz")
    pass_id = F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id") % 50)
    results = spark.range(0, 200_000, 1, 8).select(
        "id", pass_id.cast("long").alias("test_pass_id"),
        F.lit(base).alias("time_started"), (F.col("id") % 4 == 0).cast("int").alias(
            "hard_errors_exist"))
    report = failures.failure_rate(passes, results, bucket=DAY_ISO, keys=("zone",), as_of=AS_OF,
                                   lookback=(7, "day")).collect()
    assert [(r.total_tests, r.total_failures) for r in report] == [(200_000, 50_000)]
