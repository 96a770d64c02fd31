"""Streams over several files against the batch results over the same rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultline.operators.builds import failures_in_last
from faultline.sources.derived import Tables
from faultline.streaming import alerts, keyed, rates, sinks

BASE = dt.datetime(2001, 6, 1, 12)


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return Tables(spark, sf_dir)


def write_files(df, path, order, n):
    """Rows as ``n`` files, each holding one slice of the order, in separate appends."""
    ranked = df.withColumn("_slice", F.expr(f"ntile({n}) over (order by {order})"))
    for i in range(1, n + 1):
        (ranked.filter(F.col("_slice") == i).drop("_slice").coalesce(1)
         .write.mode("append").parquet(path))


def test_failure_rate_over_several_batches(spark, tables, tmp_path):
    """Files in no order of time, and a run that is resumed with more of them."""
    results = tables.test_results().persist()
    path, run = str(tmp_path / "in"), sinks.StreamRun(str(tmp_path / "run"))
    passes = tables.test_passes().select("test_pass_id", "environ_name", "zone")

    def process():
        stream = sinks.file_stream(spark, path, files_per_trigger=1)
        rates.run_failure_counts(stream, tables.test_passes(), run)
        return rows_of(rates.failure_rates(spark, run))

    def expected(part):
        return rows_of(part.join(passes, "test_pass_id").groupBy(
            F.date_trunc("hour", "time_started").cast("timestamp_ntz").alias("window_start"),
            "environ_name", "zone",
        ).agg(F.count("*").alias("total_tests"), F.sum("hard_errors_exist").alias("total_failures"),
              F.avg("hard_errors_exist").alias("failure_rate")))

    early = results.filter("test_id % 3 > 0")
    write_files(early, path, "test_id % 7, test_id", 3)
    assert process() == expected(early)
    write_files(results.filter("test_id % 3 = 0"), path, "test_id", 2)
    assert process() == expected(results)
    assert max(int(f.stem) for f in (tmp_path / "run" / "manifest").glob("*.json")) >= 3
    results.unpersist()


def test_requests_count_however_late(spark, tables, tmp_path):
    """Four files, one per batch: each action counts once per window that covers it."""
    log = tables.test_actions().select("test_id", "time_started").persist()
    tests = tables.test_results().select("test_id", F.lit("E").alias("environ_name"))
    write_files(log, str(tmp_path / "in"), "test_id", 4)
    stream = sinks.file_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    run = sinks.StreamRun(str(tmp_path / "run"))
    rates.run_request_counts(stream, tests, run, window="1 hour", slide="1 hour")
    rows = rates.request_rates(spark, run, 3600)
    known = log.join(tests, "test_id").count()
    assert rows.agg(F.sum("requests")).first()[0] == known
    assert rows.filter("abs(rps - requests / 3600D) > 1e-12").count() == 0
    log.unpersist()


def test_sequential_failures_across_batches_and_restart(spark, tables, tmp_path):
    builds = tables.build_details().select(*alerts.BUILD_COLUMNS).persist()
    path = str(tmp_path / "in")
    run = sinks.StreamRun(str(tmp_path / "run"))
    write_files(builds.filter("end_date < timestamp_ntz'2024-01-15'"), path, "end_date", 2)

    def process():
        stream = sinks.file_stream(spark, path, files_per_trigger=1)
        alerts.run_sequential_failures(stream, run, 3)
        return rows_of(alerts.current_failures(spark, run, builds.schema, 3))

    early = builds.filter("end_date < timestamp_ntz'2024-01-15'")
    assert process() == rows_of(failures_in_last(early, 3))
    write_files(builds.filter("end_date >= timestamp_ntz'2024-01-15'"), path, "end_date", 2)
    assert process() == rows_of(failures_in_last(builds, 3))
    stored = spark.read.parquet(run.data)
    assert stored.select("turn").distinct().count() == stored.select("batch_id").distinct().count() == 2
    builds.unpersist()


@pytest.mark.parametrize("wait", [120, 7200])
def test_orphaned_ips_equal_the_batch(spark, tables, tmp_path, wait):
    events = tables.address_events().persist()
    path = str(tmp_path / "in")
    write_files(events, path, "event_time", 3)
    alerts.end_of_input(events, wait_seconds=wait).write.mode("append").parquet(path)
    stream = alerts.orphaned_ip_stream(
        sinks.file_stream(spark, path, files_per_trigger=1), wait_seconds=wait)
    run = sinks.StreamRun(str(tmp_path / "run"))
    sinks.run_appends(stream, run)
    got = spark.read.schema(stream.schema).parquet(run.data)
    want = alerts.orphaned_ips_batch(events, wait_seconds=wait)
    assert rows_of(got) == rows_of(want)
    # Brute force over the same events.
    plain = [tuple(r) for r in events.select("ip", "event_time", "kind").collect()]
    attach = {}
    for ip, at, kind in plain:
        if kind == "attach":
            attach.setdefault(ip, []).append(at)
    limit = dt.timedelta(seconds=wait)
    brute = sorted(((at, ip) for ip, at, kind in plain if kind == "detach"
                    and not any(at < a <= at + limit for a in attach.get(ip, []))), key=repr)
    assert rows_of(got) == brute
    events.unpersist()


# -- attributes that come later, compaction, keyed state ------------------------------------------

def test_attributes_stored_after_the_facts_still_count(spark, tables, tmp_path, monkeypatch):
    """Tests are stored in three steps while the stream runs; some only after it."""
    monkeypatch.setattr(rates, "COMPACT", 3)
    log = tables.test_actions().select("test_id", "time_started").cache()
    tests = tables.test_results().select("test_id", (F.col("test_id") % 3).cast("string")
                                         .alias("environ_name")).cache()
    write_files(log, str(tmp_path / "in"), "test_id % 5, test_id", 8)
    run, calls = sinks.StreamRun(str(tmp_path / "run")), []

    def stored_by_now():
        calls.append(1)
        return tests.filter(F.col("test_id") % 10 < len(calls))

    stream = sinks.file_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    rates.run_request_counts(stream, stored_by_now, run, window="1 hour", slide="1 hour")
    assert len(calls) == 8
    known = log.join(tests, "test_id")
    late = known.filter("test_id % 10 >= 8").count()
    assert late > 0
    waiting = rates.waiting_counts(spark, run, "test_id", ["requests"])
    unknown = log.join(tests.select("test_id"), "test_id", "left_anti").count()
    assert waiting.agg(F.sum("requests")).first()[0] == late + unknown
    total = lambda df: df.agg(F.sum("requests")).first()[0]
    assert total(rates.request_rates(spark, run, 3600)) == known.count() - late
    rows = rates.request_rates(spark, run, 3600, tests=tests)
    want = known.groupBy(F.window("time_started", "1 hour").alias("w"), "environ_name").agg(
        F.count("*").alias("requests")).select("w.start", "environ_name", "requests")
    assert rows_of(rows.select("environ_name", "requests", F.col("window_start").alias("start"))
                   ) == rows_of(want.withColumn("start", F.col("start").cast("timestamp_ntz")))
    # Folders: at most the compacted list, the waiting counts and those of the manifest before.
    assert len(list((tmp_path / "run" / "data").iterdir())) <= 2 * (3 + 2)
    assert len(list((tmp_path / "run" / "manifest").glob("*.json"))) == 2


def test_a_repeated_batch_counts_once(spark, tables, tmp_path):
    """The commit of the last batch is lost: the batch runs again and gives the same rates."""
    results = tables.test_results().select("test_pass_id", "time_started", "hard_errors_exist")
    write_files(results, str(tmp_path / "in"), "time_started", 3)
    run = sinks.StreamRun(str(tmp_path / "run"))

    def process():
        stream = sinks.file_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
        rates.run_failure_counts(stream, tables.test_passes(), run)
        return rows_of(rates.failure_rates(spark, run))

    first = process()
    commits = tmp_path / "run" / "checkpoint" / "commits"
    for name in ("2", ".2.crc"):
        (commits / name).unlink(missing_ok=True)
    assert process() == first


@pytest.mark.parametrize("files", [1, 4])
def test_keyed_failures_equal_the_batch_and_survive_a_restart(spark, tables, tmp_path, files):
    builds = tables.build_details().cache()
    path, run = str(tmp_path / "in"), sinks.StreamRun(str(tmp_path / "run"))

    def process():
        stream = sinks.file_stream(spark, path, schema=builds.schema, files_per_trigger=1)
        sinks.run_updates(keyed.sequential_failure_updates(stream, 3), run)
        return rows_of(sinks.latest_rows(spark, run, keyed.FAILURES, ["name"]))

    # The newest come first, so older ones must not push them out.
    write_files(builds.filter("end_date >= timestamp_ntz'2024-01-15'"), path, "end_date desc", files)
    assert process() == rows_of(failures_in_last(
        builds.filter("end_date >= timestamp_ntz'2024-01-15'"), 3))
    write_files(builds.filter("end_date < timestamp_ntz'2024-01-15'"), path, "end_date", files)
    assert process() == rows_of(failures_in_last(builds, 3))


def test_state_holds_no_more_than_the_last_builds():
    """Whatever the history, a job's state is n rows."""
    import pandas as pd

    class Kept:
        rows = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

    processor = keyed.LastBuilds(3)
    processor.kept = Kept()
    for at in range(100):
        part = pd.DataFrame({"at": range(at * 50, at * 50 + 50), "id": [str(i) for i in range(50)],
                             "failed": [i % 2 == 0 for i in range(50)]})
        list(processor.handleInputRows(("job",), iter([part]), None))
        assert len(processor.kept.rows) == 3
    assert [r[0] for r in processor.kept.rows] == [4999, 4998, 4997]


@pytest.mark.parametrize("wait,swap", [(120, False), (7200, True)])
def test_timed_orphans_equal_the_batch_for_any_order_within_the_delay(
        spark, tables, tmp_path, wait, swap):
    events = tables.address_events().cache()
    ranked = events.withColumn("_slice", F.expr("ntile(8) over (order by event_time)")).cache()
    path = str(tmp_path / "in")
    for i in [2, 1, 4, 3, 6, 5, 8, 7] if swap else range(1, 9):
        (ranked.filter(F.col("_slice") == i).drop("_slice").coalesce(1)
         .write.mode("append").parquet(path))
    stream = sinks.file_stream(spark, path, schema=events.schema, files_per_trigger=1)
    run = sinks.StreamRun(str(tmp_path / "run"))
    first, last = events.agg(F.min("event_time"), F.max("event_time")).first()
    delay = (last - first) / 3 if swap else dt.timedelta(minutes=10)
    seconds = int(delay.total_seconds())
    sinks.run_appends(keyed.orphaned_ip_timers(
        stream, wait_seconds=wait, delay=f"{seconds} seconds"), run)
    got = spark.read.schema(keyed.ORPHANED).parquet(run.data)
    due = last - dt.timedelta(seconds=seconds + wait)
    want = alerts.orphaned_ips_batch(events, wait_seconds=wait).filter(F.col("detached_at") < F.lit(due))
    assert want.count() > 0
    assert rows_of(got) == rows_of(want)


def test_state_processors_travel_with_their_code(tmp_path):
    """A worker that knows no faultline can load them."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    path = tmp_path / "processors"
    path.write_bytes(cloudpickle.dumps([keyed.LastBuilds(3), keyed.Unattached(120)]))
    bare = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = ("import pickle, sys; p = pickle.load(open('processors', 'rb')); "
            "assert p[1].wait == 120_000_000 and 'faultline' not in sys.modules")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=bare, check=True)


def test_keyed_streams_run_in_a_session_with_the_default_store(spark, tmp_path):
    at, provider = BASE, "spark.sql.streaming.stateStore.providerClass"
    builds = spark.createDataFrame([("a", str(i), at + dt.timedelta(hours=i), r) for i, r in enumerate(
        ["FAILURE", "FAILURE", "SUCCESS", "FAILURE"])], "name string, id string, end_date timestamp_ntz, result string")
    events = spark.createDataFrame([("x", at, "detach"), ("y", at, "detach"), (
        "y", at + dt.timedelta(seconds=9), "attach"), ("z", at + dt.timedelta(days=1), "detach")],
        "ip string, event_time timestamp_ntz, kind string")
    builds.write.parquet(str(tmp_path / "builds"))
    events.write.parquet(str(tmp_path / "events"))
    runs = [sinks.StreamRun(str(tmp_path / name)) for name in ("run", "timed")]
    before, default = spark.conf.get(provider), (
        "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    spark.conf.set(provider, default)
    try:
        sinks.run_updates(keyed.sequential_failure_updates(sinks.file_stream(
            spark, str(tmp_path / "builds"), schema=builds.schema)), runs[0], keyed.STATE)
        sinks.run_appends(keyed.orphaned_ip_timers(sinks.file_stream(
            spark, str(tmp_path / "events"), schema=events.schema)), runs[1], keyed.STATE)
        assert spark.conf.get(provider) == default
    finally:
        spark.conf.set(provider, before)
    assert rows_of(sinks.latest_rows(spark, runs[0], keyed.FAILURES, ["name"])) == [(2, "a")]
    assert rows_of(spark.read.schema(keyed.ORPHANED).parquet(runs[1].data)) == [(at, "x")]


def test_a_batch_is_counted_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    """One file with one row group and one busy test: no task gets more than its share of rows."""
    monkeypatch.setattr(rates, "TASK_ROWS", 50)
    rows = [(1 if i % 4 else i, BASE + dt.timedelta(minutes=i % 3)) for i in range(1000)]
    log = spark.createDataFrame(rows, "test_id bigint, time_started timestamp_ntz").coalesce(1)
    log.write.parquet(str(tmp_path / "in"))
    sizes, name = [], "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    real, before = rates.small_tasks, spark.conf.get(name, None)

    def watched(batch, columns):
        with real(batch, columns) as spread:
            sizes.extend(r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect())
        assert batch.sparkSession.conf.get(name, None) == before
        return real(batch, columns)

    monkeypatch.setattr(rates, "small_tasks", watched)
    tests = spark.createDataFrame([(1, "E")], "test_id bigint, environ_name string")
    run = sinks.StreamRun(str(tmp_path / "run"))
    rates.run_request_counts(sinks.file_stream(spark, str(tmp_path / "in")), tests, run,
                             window="1 hour", slide="30 minutes")
    assert len(sizes) > 10 and max(sizes) <= 100 and sum(sizes) == 1000
    found = [r[0] for r in rates.request_rates(spark, run, 3600).select("requests").collect()]
    assert found == [750, 750]


def test_keyed_streams_of_odd_rows_equal_the_batch(spark, tmp_path):
    """No name, id, end, address, time or kind, and equal rows."""
    at, day = BASE, dt.timedelta(days=1)
    ends = [None, at, at + day, at + day, None, at - day]
    builds = spark.createDataFrame(
        [(name, None if i == 2 else str(i), ends[i], "FAILURE" if i % 2 else None)
         for name in ("a", None) for i in range(6)] + [("b", None, None, "FAILURE")] * 2,
        "name string, id string, end_date timestamp_ntz, result string")
    events = spark.createDataFrame(
        [(ip, at, "detach") for ip in ("x", "y", "y", None)]
        + [("x", at + dt.timedelta(seconds=9), "attach"), (None, at + dt.timedelta(seconds=9), "attach"),
           ("x", None, "detach"), ("z", at, None), ("z", None, None), ("w", at + day, "detach")],
        "ip string, event_time timestamp_ntz, kind string")
    builds.write.parquet(str(tmp_path / "builds"))
    events.write.parquet(str(tmp_path / "events"))
    runs = [sinks.StreamRun(str(tmp_path / name)) for name in ("run", "timed")]
    sinks.run_updates(keyed.sequential_failure_updates(sinks.file_stream(
        spark, str(tmp_path / "builds"), schema=builds.schema)), runs[0], keyed.STATE)
    sinks.run_appends(keyed.orphaned_ip_timers(sinks.file_stream(
        spark, str(tmp_path / "events"), schema=events.schema)), runs[1], keyed.STATE)
    found = sinks.latest_rows(spark, runs[0], keyed.FAILURES, ["name"])
    assert rows_of(found) == rows_of(failures_in_last(builds, 3))
    got = spark.read.schema(keyed.ORPHANED).parquet(runs[1].data)
    want = alerts.orphaned_ips_batch(events).filter(F.col("detached_at") < F.lit(at + day))
    assert rows_of(got) == rows_of(want) and want.count() == 3
