"""Registered queries: every operator over the tables derived from a benchmark directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions import errors, text, times
from faultline.functions.numbers import humanize_units
from faultline.operators import (
    builds, error_counts, failures, identity, latency, maintenance, ranks, requests, rollup,
    series, snapshots, summaries,
)
from faultline.plans import reports
from faultline.sources import layout, ledger, readers, storage, versions
from faultline.sources.derived import AS_OF, Tables
from faultline.streaming import alerts, keyed, rates, sinks, windows

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}


def query(name: str):
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        return build
    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))
        return run
    return {name: bind(build) for name, build in QUERIES.items()}


# -- scans ---------------------------------------------------------------------------------

for _name in ["test_passes", "test_results", "test_actions", "build_details", "build_node",
              "build_params", "account_external_ids", "accounts"]:
    query(f"scan_{_name}")(lambda t, n=_name: getattr(t, n)())


# -- filters, projections, sorts -----------------------------------------------------------

@query("f1_results_of_pass")
def _(t: Tables):
    return t.test_results().filter(F.col("test_pass_id") == 499260360)


@query("f1_results_of_concurrency")
def _(t: Tables):
    return t.test_results().filter(F.col("concurrency_count") == 16)


@query("f1_actions_of_test")
def _(t: Tables):
    return t.test_actions().filter(F.col("test_id") == 742)


def _clustered_log(t: Tables, **ranges) -> DataFrame:
    """The stored log, clustered by test and start, read within ranges of these."""
    path = storage.shared_dir(t.spark)
    layout.append_clustered(t.test_actions(), path, ["test_id", "time_started"])
    return layout.read_clustered(t.spark, path, **ranges)


@query("f1_clustered_actions_of_test")
def _(t: Tables):
    return _clustered_log(t, test_id=(742, 742))


@query("f7_clustered_actions_of_two_days")
def _(t: Tables):
    return _clustered_log(t, time_started=("2001-07-01 08:00:00", AS_OF))


@query("f1_actions_of_function")
def _(t: Tables):
    return requests.actions_of(t.test_actions(), "wait_for_active_status")


@query("f2_error_actions")
def _(t: Tables):
    actions = t.test_actions().filter(errors.is_error(F.col("error_type")))
    return actions.orderBy(F.col("test_id").desc())


@query("f3_legacy_errors")
def _(t: Tables):
    return error_counts.legacy_errors(t.spelled_actions())


@query("f4_text_contains_publickey")
def _(t: Tables):
    return t.test_actions().filter(F.col("error_text").like("%Permission denied (publickey)%"))


@query("f4_text_contains_timeout")
def _(t: Tables):
    return t.test_actions().filter(F.col("error_text").like("%Timeout%"))


@query("f5_f6_reportable_errors")
def _(t: Tables):
    return t.test_actions().filter(errors.is_reportable(F.col("error_type")))


for _days in [1, 5, 7, 10, 14, 20, 30, 60, 90, 360]:
    query(f"f7_passes_last_{_days}_days")(lambda t, d=_days: t.test_passes().filter(
        times.since(F.col("time_started"), AS_OF, d)))

for _count, _unit in [(3, "hour"), (48, "hour"), (60, "minute"), (60, "second")]:
    query(f"f7_actions_last_{_count}_{_unit}s")(lambda t, c=_count, u=_unit: t.test_actions().filter(
        times.since(F.col("time_started"), AS_OF, c, u)))


@query("f8_concurrent_results")
def _(t: Tables):
    return t.test_results().filter(F.col("concurrency_count") > 1).select(
        "test_id", "concurrency_count")


@query("f9_successful_ssh")
def _(t: Tables):
    return t.spelled_actions().filter((F.col("function_name") == "ssh")
                                      & errors.is_success(F.col("error_type")))


@query("f10_active_results")
def _(t: Tables):
    return t.test_results().filter(F.col("is_active") == 1).select(
        "test_id", "time_to_active").orderBy("time_to_active", "test_id")


@query("f11_servers_with_pattern")
def _(t: Tables):
    return snapshots.servers_with_pattern(
        t.servers(), "Customer#0000000[0-4]", ["Customer#000000007", "Customer#000000011"]
    ).select("id", "name")


@query("f12_unattached_ips")
def _(t: Tables):
    return snapshots.unattached(t.floating_ips())


@query("f13_ip_lookup")
def _(t: Tables):
    return t.floating_ips().filter(F.col("ip") == "15.0.0.7")


@query("f13_servers_with_account")
def _(t: Tables):
    known = t.accounts().filter(F.col("inactive") == "N").select(F.col("full_name").alias("name"))
    return snapshots.existing(t.servers().select("id", "name"), known, "name")


@query("f14_recent_actions")
def _(t: Tables):
    return error_counts.recent_actions(t.test_results(), t.test_actions(), as_of=AS_OF,
                                       lookback=(60, "minute"))


@query("s1_passes_by_id_desc")
def _(t: Tables):
    return t.test_passes().orderBy(F.col("test_pass_id").desc())


@query("s2_actions_by_test_and_start")
def _(t: Tables):
    return t.test_actions().select("test_id", "time_started", "function_name").orderBy(
        F.col("test_id").desc(), F.col("time_started").asc(), "function_name")


@query("s4_last_builds_of_job")
def _(t: Tables):
    of_job = t.build_details().filter(F.col("name") == "job-3").select("id", "end_date", "result")
    return ranks.top_rows(of_job, [F.col("end_date").desc(), F.col("id").desc()], 3)


@query("s5_row_at_offset")
def _(t: Tables):
    return ranks.row_at_offset(t.test_actions(), "wait_for_active_status", 53)


@query("errors_ignoring_case")
def _(t: Tables):
    actions = t.test_actions().filter(text.same_text(F.col("error_type"), "PING TIMEOUT  "))
    return actions.select("test_id", "function_name", "error_type", "error_text")


# -- joins ---------------------------------------------------------------------------------

@query("j1_tests_with_pass")
def _(t: Tables):
    return failures.tests_with_pass(t.test_passes(), t.test_results(), as_of=AS_OF,
                                    lookback=(90, "day"))


@query("j4_tests_and_actions")
def _(t: Tables):
    return error_counts.tests_and_actions(t.test_results(), t.test_actions())


@query("j7_identities")
def _(t: Tables):
    return identity.identities(t.account_external_ids(), t.accounts())


@query("j7_identity_rows")
def _(t: Tables):
    return identity.identity_rows(t.repeated_external_ids(), t.accounts())


@query("x7_trusted_lines")
def _(t: Tables):
    return identity.trusted_lines(t.account_external_ids(), t.accounts())


@query("j8_first_match")
def _(t: Tables):
    return snapshots.first_match(t.servers(), ["srv-12", "0001", "Customer#00000010", "absent"])


@query("j8_first_match_of_table")
def _(t: Tables):
    # Pieces of every part's key as needles, of one to five characters.
    text = F.concat(F.lit("#00"), F.col("p_partkey").cast("string"))
    needles = t.raw("part").select(F.substring(
        text, F.lit(1) + F.col("p_partkey") % 4, F.lit(1) + F.col("p_partkey") % 5).alias("needle"))
    return snapshots.first_match_of(t.servers(), needles)


@query("j9_add_if_absent")
def _(t: Tables):
    customer = t.raw("customer").select(F.col("c_name").alias("name"), "c_custkey",
                                        "c_mktsegment")
    known = customer.filter(F.col("c_custkey") % 3 != 0).select(
        "name", F.lit("known").alias("origin"))
    new = customer.filter(F.col("c_mktsegment") == "BUILDING").select(
        "name", F.lit("new").alias("origin"))
    return snapshots.add_if_absent(new, known, "name")


# -- failure rates -------------------------------------------------------------------------

for _key, _params in reports.FAILURE_RATES.items():
    query(f"failure_rate_{_key}")(lambda t, p=_params: failures.failure_rate(
        t.test_passes(), t.test_results(), as_of=AS_OF, **p))


@query("a2_failure_rate_by_env")
def _(t: Tables):
    return failures.failure_rate_by_env(t.test_passes(), t.test_results(), as_of=AS_OF,
                                        windows=(1, 7, 14, 30, 90, 360))


@query("wp5_failure_rate_moving_avg")
def _(t: Tables):
    return failures.failure_rate_moving_avg(t.test_passes(), t.test_results(), as_of=AS_OF,
                                            period=30, days=10)


@query("wp5_failure_rate_moving_avg_env")
def _(t: Tables):
    return failures.failure_rate_moving_avg(t.test_passes(), t.test_results(), as_of=AS_OF,
                                            period=10, days=7, environ="ASIA")


@query("wp5_failure_rate_moving_avg_360d")
def _(t: Tables):
    return failures.failure_rate_moving_avg(t.test_passes(), t.test_results(), as_of=AS_OF,
                                            period=90, days=360)


# -- latency -------------------------------------------------------------------------------

for _environ in reports.LATENCY_ENVIRONMENTS:
    query(f"a3a_latency_zone_{_environ.lower().replace(' ', '_')}")(
        lambda t, e=_environ: latency.latency_by(
            t.test_passes(), t.test_results(), keys=("environ_name", "zone"),
            order=("concurrency_count", "zone"), as_of=AS_OF, lookback=(90, "day"), environ=e,
            loose=("cloud_account_username",)))


@query("a3b_latency_region_zone")
def _(t: Tables):
    return latency.latency_by(
        t.test_passes(), t.test_results(), keys=("region", "zone"),
        order=("environ_name", "zone", "concurrency_count"), as_of=AS_OF, lookback=(20, "day"),
        loose=("environ_name", "cloud_account_username"), error_counts=True)


for _days in [10, 20]:
    query(f"a3c_latency_region_{_days}d")(lambda t, d=_days: latency.latency_by(
        t.test_passes(), t.test_results(), keys=("region",),
        order=("environ_name", "concurrency_count"), as_of=AS_OF, lookback=(d, "day"),
        loose=("environ_name", "cloud_account_username"), error_counts=True))


@query("a3d_latency_by_concurrency")
def _(t: Tables):
    return latency.latency_by_concurrency(t.test_results())


# -- error counts --------------------------------------------------------------------------

def _log(t: Tables):
    return t.test_passes(), t.test_results(), t.test_actions()


for _key, (_environ, _days, _excluded) in reports.ERROR_TYPE_COUNTS.items():
    query(_key)(lambda t, e=_environ, d=_days, x=_excluded: error_counts.error_counts(
        *_log(t), keys=("environ_name", "error_type"), order=("environ_name",),
        keep=errors.is_reportable(F.col("error_type"), x), as_of=AS_OF, lookback=(d, "day"),
        environ=e))


@query("a4b_error_types_by_zone")
def _(t: Tables):
    return error_counts.error_counts(
        *_log(t), keys=("region", "zone", "error_type"), loose=("environ_name", "error_text"),
        as_of=AS_OF, lookback=(20, "day"), environ="ASIA")


@query("a4c_error_types_all")
def _(t: Tables):
    return error_counts.error_counts(
        *_log(t), keys=("environ_name", "error_type"), loose=("error_text",))


for _label, _lookback in [("7d", (7, "day")), ("48h", (48, "hour"))]:
    query(f"a4d_errors_by_function_{_label}")(
        lambda t, b=_lookback: error_counts.error_counts(
            *_log(t), keys=("function_name", "error_type"),
            loose=("environ_name", "error_text"), as_of=AS_OF, lookback=b))


@query("a4e_recent_error_detail")
def _(t: Tables):
    return error_counts.recent_error_detail(*_log(t), as_of=AS_OF, lookback=(3, "hour"))


@query("a4e_recent_error_detail_48h")
def _(t: Tables):
    return error_counts.recent_error_detail(*_log(t), as_of=AS_OF, lookback=(48, "hour"))


@query("a4f_function_error_counts")
def _(t: Tables):
    return error_counts.function_error_counts(t.test_actions())


@query("a4g_error_type_histogram")
def _(t: Tables):
    return error_counts.error_type_histogram(t.test_actions())


@query("a4h_error_counts_cross")
def _(t: Tables):
    return error_counts.error_counts_cross(*_log(t))


@query("a4i_error_counts_not_none")
def _(t: Tables):
    return error_counts.error_counts_not_none(t.test_results(), t.test_actions())


for _environ in reports.LATENCY_ENVIRONMENTS:
    query(f"a5_errors_by_call_{_environ.lower().replace(' ', '_')}")(
        lambda t, e=_environ: error_counts.error_counts(
            *_log(t), keys=("concurrency_count", "function_name", "error_type"),
            count_name="error_count", keep=errors.is_reportable(F.col("error_type")),
            as_of=AS_OF, lookback=(90, "day"), environ=e, min_concurrency=2))

for _key, (_environ, _days, _least, _zone) in reports.ERRORS_BY_HOUR.items():
    query(_key)(lambda t, e=_environ, d=_days, c=_least, z=_zone: error_counts.errors_by_bucket(
        *_log(t), bucket=times.HOUR_ISO, as_of=AS_OF, lookback=(d, "day"), environ=e,
        min_concurrency=c, zone=z))

for _environ, _days in [("EUROPE", 7), ("MIDDLE EAST", 7), ("EUROPE", 90)]:
    query(f"a7_unpingable_ips_{_environ.lower().replace(' ', '_')}_{_days}d")(
        lambda t, e=_environ, d=_days: error_counts.unpingable_ips(
            *_log(t), bucket=times.DAY_ISO, as_of=AS_OF, lookback=(d, "day"), environ=e))


# -- counts and rates ----------------------------------------------------------------------

@query("a8a_tests_per_day")
def _(t: Tables):
    return failures.tests_per_bucket(t.test_results(), times.DAY_US_SHORT)


@query("a8b_tests_per_day_env")
def _(t: Tables):
    return failures.tests_per_bucket_env(t.test_passes(), t.test_results(), times.DAY_US_SHORT)


@query("a8c_tests_per_env_name")
def _(t: Tables):
    return failures.tests_per_env_name(t.test_passes(), t.test_results(), as_of=AS_OF,
                                       lookback=(30, "day"))


@query("a9_ssh_duration_stats")
def _(t: Tables):
    return requests.ssh_duration_stats(t.spelled_actions())


@query("a10_avg_time_to_active")
def _(t: Tables):
    return requests.avg_time_of(t.test_actions())


@query("a11_request_count")
def _(t: Tables):
    return requests.request_count(*_log(t), as_of=AS_OF, lookback=(60, "minute"), environ="ASIA")


@query("a12_requests_per_env")
def _(t: Tables):
    return requests.actions_per_env(*_log(t), as_of=AS_OF, lookback=(60, "second"))


@query("a13_request_rate")
def _(t: Tables):
    return requests.request_rate(*_log(t), as_of=AS_OF, minutes=60, environ="ASIA")


@query("a14_distinct_errors")
def _(t: Tables):
    return error_counts.distinct_errors(t.test_actions())


# -- ranks ---------------------------------------------------------------------------------

@query("wp1_percentile_rows")
def _(t: Tables):
    return ranks.percentile_rows(t.test_actions())


@query("wp1_percentile_rows_env")
def _(t: Tables):
    envs = t.test_results().select("test_id", "test_pass_id").join(
        t.test_passes().select("test_pass_id", "environ_name"), "test_pass_id")
    rows = t.test_actions().select("test_id", "function_name", "time_total").join(
        envs.select("test_id", "environ_name"), "test_id")
    return ranks.percentile_rows(rows, keys=("environ_name", "function_name"))


@query("wp1_sketched_percentiles")
def _(t: Tables):
    # The sketches are stored by day and merged; whether each value lies at its rank is counted
    # from the log itself, as the values differ from run to run within their bound.
    path, actions = storage.shared_dir(t.spark), t.test_actions()
    early = F.col("time_started") < F.lit("1998-01-01").cast("timestamp_ntz")
    for part in (actions.filter(early), actions.filter(~early)):
        months = summaries.duration_sketches(part.withColumn(
            "time_started", F.trunc(F.col("time_started").cast("date"), "year")))
        summaries.store_sketches(months, path)
    schema = T.StructType().add("function_name", T.StringType()).add("sketch", T.BinaryType()).add(
        "n", T.LongType()).add("event_date", T.DateType())
    picks = summaries.sketched_percentiles(t.spark.read.schema(schema).parquet(path))
    slower = actions.select("function_name", F.col("time_total").alias("v")).join(
        picks, "function_name").groupBy("function_name", "divisor", "n", "row_offset").agg(
        F.count_if(F.col("v") > F.col("time_total")).alias("above"),
        F.count_if(F.col("v") >= F.col("time_total")).alias("upto"))
    room = F.col("n") * summaries.RANK_ERROR * 2 + 1
    return slower.select("function_name", "divisor", "n", (
        (F.col("above") - room <= F.col("row_offset"))
        & (F.col("row_offset") <= F.col("upto") + room)).cast("int").alias("within_bound"))


@query("wp2_percentile_offsets")
def _(t: Tables):
    return ranks.percentile_offsets(t.test_actions(), "wait_for_active_status")


@query("wp3_failures_in_last_builds")
def _(t: Tables):
    return builds.failures_in_last(t.build_details(), 3)


@query("wp3_sequential_failures")
def _(t: Tables):
    return builds.sequential_failures(t.build_details(), 3, threshold=2)


@query("wp3_job_failures")
def _(t: Tables):
    return builds.job_failures(t.build_details(), "job-3", 3)


@query("wp4_head_failures")
def _(t: Tables):
    return builds.job_failures(t.build_details(), "job-7", 3, failed="FAILED")


@query("wp4_failures_other_spelling")
def _(t: Tables):
    return builds.failures_in_last(t.spelled_builds(), 20, failed="FAILED")


# -- roll-up -------------------------------------------------------------------------------

@query("r1_rollup_test_results")
def _(t: Tables):
    return rollup.rollup_test_results(t.spelled_actions())


@query("r2_milestone_times")
def _(t: Tables):
    return rollup.milestone_times(t.test_results(), t.spelled_actions())


@query("r3_close_passes")
def _(t: Tables):
    return rollup.close_passes(t.test_passes(), t.test_results())


@query("r4_retry_attempts")
def _(t: Tables):
    return rollup.retry_attempts(t.test_actions())


@query("r4_retry_episodes")
def _(t: Tables):
    # All calls of a hundredth of the tests as one call, so that episodes repeat and span chunks.
    calls = t.test_actions().withColumns({"test_id": F.col("test_id") % 100,
                                          "function_name": F.lit("call")})
    return rollup.retry_episodes(calls)


@query("r5_effective_zone")
def _(t: Tables):
    label = F.when(F.col("test_pass_id") % 4 == 0, F.concat(F.col("zone"), F.lit("-v1")))
    return t.test_passes().select(
        "test_pass_id", rollup.effective_zone(F.col("zone"), label).alias("zone"))


@query("r6_io_throughput")
def _(t: Tables):
    return rollup.io_throughput(t.io_samples())


@query("w7_sample_actions")
def _(t: Tables):
    calls = ["boot", "wait_for_active_status", "floating_ip_create",
             "server_attach_floating_ip", "ping_device", "ssh", "server_delete"]
    return rollup.sample_actions(t.test_results(), calls)


# -- scalar expressions --------------------------------------------------------------------

for _mode in ["faithful", "intended"]:
    query(f"x1_classify_error_{_mode}")(
        lambda t, m=_mode: errors.with_error_type(t.error_texts(), mode=m))


@query("x1_classify_error_log")
def _(t: Tables):
    log = t.test_actions().select("test_id", "function_name", "error_text")
    return errors.with_error_type(log)


@query("x2_error_severity")
def _(t: Tables):
    typed = errors.with_error_type(t.error_texts(), mode="intended")
    return errors.with_severity(typed).select("test_id", "step", "error_type", "severity")


for _mode in ["faithful", "intended"]:
    query(f"x3_bad_ip_{_mode}")(lambda t, m=_mode: t.test_actions().select(
        "test_id", "error_text",
        text.extract_bad_ip(F.col("error_text"), m).alias("bad_ip")))


@query("x4_server_addresses")
def _(t: Tables):
    return snapshots.server_addresses(t.servers())


@query("x5_server_states")
def _(t: Tables):
    return snapshots.server_states(t.servers())


@query("x6_command_outcome")
def _(t: Tables):
    code = F.col("return_code")
    return t.probe_log().select(
        "test_id", "step", code,
        text.command_outcome(code, F.col("output"), F.col("expected")).alias("outcome"),
        text.is_publickey_failure(code, F.col("errors")).cast("int").alias("publickey"))


@query("x8_x9_time_labels")
def _(t: Tables):
    start = F.col("time_started")
    labels = {
        "day_us": times.DAY_US, "day_us_short": times.DAY_US_SHORT, "day_iso": times.DAY_ISO,
        "hour_iso": times.HOUR_ISO, "hour_us": times.HOUR_US, "hour12_us": times.HOUR12_US}
    return t.test_results().select(
        "test_id", *[b.label(start).alias(n) for n, b in labels.items()],
        times.HOUR_US.parse(times.HOUR_US.label(start)).alias("hour_start"))


@query("x11_elapsed_seconds")
def _(t: Tables):
    return t.test_results().select("test_id", times.elapsed_seconds(
        F.col("time_started"), F.col("time_end")).alias("seconds"))


@query("x14_humanize_units")
def _(t: Tables):
    value = (F.col("l_partkey") * 1024 * F.col("l_linenumber") * F.col("l_suppkey")).cast("bigint")
    sizes = t.raw("lineitem").select("l_orderkey", "l_linenumber", value.alias("size"))
    return sizes.select("l_orderkey", "l_linenumber", "size",
                        humanize_units(F.col("size")).alias("label"))


@query("x16_normalize_no_error")
def _(t: Tables):
    spelled = F.when(F.col("test_id") % 3 == 0, F.lit("None")).otherwise(F.col("error_type"))
    rows = t.test_actions().select("test_id", spelled.alias("spelled"))
    return rows.groupBy(
        "spelled", errors.normalize_no_error(F.col("spelled")).alias("error_type")
    ).agg(F.count("*").alias("n"))


# -- series --------------------------------------------------------------------------------

def _daily(t: Tables, days: int = 90) -> DataFrame:
    return failures.failure_rate(
        t.test_passes(), t.test_results(), bucket=times.DAY_ISO, keys=("environ_name", "zone"),
        as_of=AS_OF, lookback=(days, "day"))


for _environ, _zones in reports.ZONES.items():
    query(f"p1_series_by_zone_{_environ.lower().replace(' ', '_')}")(
        lambda t, e=_environ, z=tuple(_zones): series.series_wide(
            series.series_rows(_daily(t), times.DAY_ISO, key="zone", labels=list(z), environ=e),
            list(z)))


def _env_series(t: Tables) -> DataFrame:
    report = failures.failure_rate(
        t.test_passes(), t.test_results(), as_of=AS_OF, **reports.FAILURE_RATES["a1s_day_env_360d"])
    return series.series_rows(report, times.DAY_ISO, key="environ_name",
                              labels=reports.ENVIRONMENTS)


@query("p1_series_by_zone_hourly")
def _(t: Tables):
    report = failures.failure_rate(
        t.test_passes(), t.test_results(), as_of=AS_OF,
        **reports.FAILURE_RATES["a1d_hour_zone_30d"])
    return series.series_rows(report, times.HOUR_ISO, key="zone", labels=reports.ZONES["ASIA"],
                              environ="ASIA")


@query("p2_series_by_env")
def _(t: Tables):
    return series.series_wide(_env_series(t), reports.ENVIRONMENTS)


@query("p3_zero_filled_series")
def _(t: Tables):
    days, _ = reports.FAILURE_RATES["a1s_day_env_360d"]["lookback"]
    return series.zero_filled(_env_series(t), AS_OF, days=days + 1, ahead=3)


@query("u4_series_labels")
def _(t: Tables):
    return series.labels_of(_daily(t), "zone")


@query("io6_series_output")
def _(t: Tables):
    path = storage.shared_dir(t.spark)
    storage.write_series(_env_series(t), path)
    schema = T.StructType().add("point", T.TimestampNTZType()).add(
        "pct", T.IntegerType()).add("series", T.StringType())
    return t.spark.read.schema(schema).parquet(path)


# -- snapshots -----------------------------------------------------------------------------

@query("u1_orphaned_ips")
def _(t: Tables):
    ips = t.floating_ips()
    ignored = ips.filter(F.col("id") % 10 == 0).select("ip")
    return snapshots.orphaned_ips(
        ips.filter(F.col("snapshot") == 1), ips.filter(F.col("snapshot") == 2), ignored
    ).select("id", "ip", "instance_id")


@query("u2_except_ignore_list")
def _(t: Tables):
    ips = t.floating_ips()
    ignored = ips.filter(F.col("id") % 7 == 0).select("ip")
    return snapshots.except_keys(ips, ignored, "ip").select("snapshot", "id", "ip", "instance_id")


@query("u3_snapshot_delta")
def _(t: Tables):
    usage = t.usage()
    return snapshots.snapshot_delta(usage.filter(F.col("snapshot") == 1),
                                    usage.filter(F.col("snapshot") == 2))


# -- definitions ---------------------------------------------------------------------------

@query("io7_definitions")
def _(t: Tables):
    return readers.parse_definitions(t.definition_lines())


@query("io8_benchmark_runs")
def _(t: Tables):
    return readers.expand_runs(readers.parse_definitions(t.definition_lines()))


# -- writes and maintenance ----------------------------------------------------------------

@query("w1_append_results")
def _(t: Tables):
    root = storage.shared_dir(t.spark)
    results = t.test_results()
    few = F.col("concurrency_count") <= 4
    storage.append(results.filter(few), root, "test_results")
    storage.append(results.filter(~few), root, "test_results")
    return readers.read_table(t.spark, root, "test_results")


@query("w2_append_open_passes")
def _(t: Tables):
    root = storage.shared_dir(t.spark)
    opened = t.test_passes().withColumns({
        "time_end": F.lit(None).cast("timestamp_ntz"), "time_total": F.lit(None).cast("double")})
    storage.append(opened, root, "test_passes")
    return readers.read_table(t.spark, root, "test_passes")


@query("w3_upsert_pass_end")
def _(t: Tables):
    return maintenance.upsert_pass_end(t.test_passes(), t.milestones_log())


@query("w4_scrub_errors")
def _(t: Tables):
    scrubbed = maintenance.scrub(t.test_actions(), maintenance.ERROR_SCRUBS)
    return scrubbed.select("test_id", "function_name", "time_started", "error_type",
                           "error_text")


@query("w4_scrub_every_rule")
def _(t: Tables):
    return maintenance.scrub(t.scrub_texts(), maintenance.ERROR_SCRUBS)


@query("w4_scrub_environments")
def _(t: Tables):
    passes = t.test_passes().withColumn("environ_name", F.when(
        F.col("region") == "region-4", F.lit("")).otherwise(F.col("environ_name")))
    return maintenance.scrub_environments(
        passes, {"region-1": "AMERICA-2"}, blank="ASIA"
    ).select("test_pass_id", "region", "environ_name")


@query("w4_scrub_hard_flag")
def _(t: Tables):
    noisy = t.test_results().withColumn("hard_errors_exist", F.lit(1))
    return maintenance.scrub_hard_flag(noisy).select(
        "test_id", "hard_error_count", "hard_errors_exist")


@query("w5_assign_ids")
def _(t: Tables):
    results = t.test_results()
    return ranks.assign_ids(results.select("time_started", "test_id"), id_name="result_id",
                            time="time_started", order=["time_started", "test_id"],
                            existing=results.select(F.col("test_id").alias("result_id")))


@query("w5_ledger_ids")
def _(t: Tables):
    ids = ledger.IdLedger(t.spark, storage.shared_dir(t.spark))
    rows = t.test_results().select("time_started", "test_id")
    appends = [rows.filter(F.col("test_id") % 2 == part) for part in (1, 0)]
    first, second = (ledger.with_new_ids(df, ids, id_name="result_id", time="time_started",
                                         order=["time_started", "test_id"]) for df in appends)
    return first.union(second)


@query("w6_orphan_check")
def _(t: Tables):
    passes = t.test_passes().filter(F.col("test_pass_id") % 3 != 0)
    results = t.test_results().filter(F.col("test_id") % 5 != 0)
    details = t.build_details()
    nodes = t.build_node().filter(F.col("url") != "node-4")
    return maintenance.orphan_counts([
        ("results-passes", t.test_results(), "test_pass_id", passes, "test_pass_id"),
        ("actions-results", t.test_actions(), "test_id", results, "test_id"),
        ("details-node", details, "node_url", nodes, "url"),
        ("params-details", t.build_params(), "build_details_id",
         details.filter(F.col("result") != "FAILURE"), "id"),
    ])


@query("w6_orphan_check_bitmaps")
def _(t: Tables):
    passes = t.test_passes().filter(F.col("test_pass_id") % 3 != 0)
    results = t.test_results().filter(F.col("test_id") % 5 != 0)
    # Bitmaps of two appends each.
    halves = lambda df, key: summaries.key_bitmaps(df.filter(F.col(key) % 2 == 0), key).union(
        summaries.key_bitmaps(df.filter(F.col(key) % 2 != 0), key))
    return summaries.orphan_counts_by_bitmap([
        ("results-passes", t.test_results(), "test_pass_id", halves(passes, "test_pass_id")),
        ("actions-results", t.test_actions(), "test_id", halves(results, "test_id"))])


for _index, _name in enumerate(["passes", "results", "actions"]):
    query(f"w6_cascade_delete_{_name}")(lambda t, i=_index: maintenance.cascade_delete(
        *_log(t), F.col("zone").isin("NATION_2", "NATION_3"))[i])


@query("w3_stored_upsert")
def _(t: Tables):
    tables = versions.VersionedTables(t.spark, storage.shared_dir(t.spark), grain="year")
    tables.append(test_passes=t.test_passes())
    tables.upsert_pass_ends(t.milestones_log())
    return tables.read("test_passes")


@query("w4_stored_scrub")
def _(t: Tables):
    tables = versions.VersionedTables(t.spark, storage.shared_dir(t.spark), grain="year")
    tables.append(test_actions=t.test_actions())
    tables.scrub("test_actions", maintenance.ERROR_SCRUBS)
    return tables.read("test_actions").select(
        "test_id", "function_name", "time_started", "error_type", "error_text")


@query("w6_stored_cascade")
def _(t: Tables):
    tables = versions.VersionedTables(t.spark, storage.shared_dir(t.spark), grain="year")
    passes, results, actions = _log(t)
    tables.append(test_passes=passes, test_results=results, test_actions=actions)
    tables.cascade_delete(F.col("zone").isin("NATION_2", "NATION_3"))
    return tables.read("test_actions")


# -- streams -------------------------------------------------------------------------------

def _tests_env(t: Tables) -> DataFrame:
    return t.test_results().select("test_id", "test_pass_id").join(
        t.test_passes().select("test_pass_id", "environ_name"), "test_pass_id"
    ).select("test_id", "environ_name")


def _in_files(df: DataFrame, run: sinks.StreamRun) -> DataFrame:
    """The rows as a stream of several files in no order, one per batch."""
    path = f"{run.root}/in"
    df.repartition(3).write.parquet(path)
    return sinks.file_stream(df.sparkSession, path, schema=df.schema, files_per_trigger=1)


@query("t1_stream_request_rate")
def _(t: Tables):
    run = sinks.StreamRun.new(t.spark)
    log = _in_files(t.test_actions().select("test_id", "time_started"), run)
    rates.run_request_counts(log, _tests_env(t), run, window="1 hour", slide="30 minutes")
    return rates.request_rates(t.spark, run, 3600)


@query("t2_stream_failure_rate")
def _(t: Tables):
    run = sinks.StreamRun.new(t.spark)
    columns = ["test_pass_id", "time_started", "hard_errors_exist"]
    rates.run_failure_counts(_in_files(t.test_results().select(*columns), run), t.test_passes(), run)
    return rates.failure_rates(t.spark, run)


@query("t1_late_tests")
def _(t: Tables):
    run = sinks.StreamRun.new(t.spark)
    log = _in_files(t.test_actions().select("test_id", "time_started"), run)
    tests = _tests_env(t)
    # While the stream runs only every third test is stored; the others come after their actions.
    rates.run_request_counts(log, tests.filter("test_id % 3 = 0"), run, window="1 hour",
                             slide="30 minutes")
    return rates.request_rates(t.spark, run, 3600, tests=tests)


@query("t1_watermarked_request_rate")
def _(t: Tables):
    run, tests = sinks.StreamRun.new(t.spark), _tests_env(t)
    log = t.test_actions().select("test_id", "time_started")
    path = f"{run.root}/in"
    # The actions of every eleventh test come a batch later, when most windows are closed.
    for early in (True, False):
        log.filter((F.col("test_id") % 11 != 0) == F.lit(early)).write.mode("append").parquet(path)
        windows.run_window_counts(sinks.file_stream(t.spark, path, schema=log.schema), run,
                                  window="1 hour", slide="30 minutes", delay="1 day")
    return windows.final_request_rates(t.spark, run, tests, 3600)


@query("t2_late_passes")
def _(t: Tables):
    run = sinks.StreamRun.new(t.spark)
    columns = ["test_pass_id", "time_started", "hard_errors_exist"]
    passes = t.test_passes()
    rates.run_failure_counts(_in_files(t.test_results().select(*columns), run),
                             passes.filter("test_pass_id % 3 = 0"), run)
    return rates.failure_rates(t.spark, run, passes=passes)


class _StreamedEvents(Tables):
    """Tables whose events arrive as a stream."""

    def raw(self, name: str) -> DataFrame:
        if name == "events":
            return sinks.file_stream(self.spark, self.sf_dir, "events.parquet")
        return super().raw(name)


@query("t3_stream_sequential_failures")
def _(t: Tables):
    arriving = _StreamedEvents(t.spark, t.sf_dir).build_details()
    run = sinks.StreamRun.new(t.spark)
    alerts.run_sequential_failures(arriving, run, 3)
    schema = arriving.select(*alerts.BUILD_COLUMNS).schema
    return alerts.current_failures(t.spark, run, schema, 3)


@query("t3_keyed_sequential_failures")
def _(t: Tables):
    arriving = _StreamedEvents(t.spark, t.sf_dir).build_details()
    run = sinks.StreamRun.new(t.spark)
    sinks.run_updates(keyed.sequential_failure_updates(arriving, 3), run, keyed.STATE)
    return sinks.latest_rows(t.spark, run, keyed.FAILURES, ["name"])


@query("t4_timed_orphaned_ips")
def _(t: Tables):
    run, events = sinks.StreamRun.new(t.spark), t.address_events()
    path = f"{run.root}/in"
    events.write.parquet(path)
    sinks.run_appends(keyed.orphaned_ip_timers(
        sinks.file_stream(t.spark, path, schema=events.schema)), run, keyed.STATE)
    return t.spark.read.schema(keyed.ORPHANED).parquet(run.data)


@query("t4_stream_orphaned_ips")
def _(t: Tables):
    run, events = sinks.StreamRun.new(t.spark), t.address_events()
    path = f"{run.root}/in"
    events.write.parquet(path)
    alerts.end_of_input(events, wait_seconds=120).write.mode("append").parquet(path)
    arriving = sinks.file_stream(t.spark, path, schema=events.schema)
    orphaned = alerts.orphaned_ip_stream(arriving, wait_seconds=120)
    sinks.run_appends(orphaned, run)
    return t.spark.read.schema(orphaned.schema).parquet(run.data)


@query("t4_orphaned_ips_batch")
def _(t: Tables):
    return alerts.orphaned_ips_batch(t.address_events(), wait_seconds=7200)
