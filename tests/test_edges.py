"""Operators on hand-made tables, against brute force where a number is computed."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from faultline.functions.times import DAY_ISO, DAY_US
from faultline.operators import (
    builds, error_counts, failures, latency, maintenance, ranks, rollup, series, snapshots,
)

AS_OF = "2001-07-01 00:00:00"
NOW = dt.datetime(2001, 7, 1)


def passes_of(spark, rows):
    return spark.createDataFrame(
        rows, "test_pass_id long, environ_name string, zone string, time_started timestamp_ntz")


def results_of(spark, rows):
    return spark.createDataFrame(
        rows, "test_id long, test_pass_id long, time_started timestamp_ntz, hard_errors_exist int")


def test_failure_rate_excludes_the_boundary_and_uses_pass_start(spark):
    passes = passes_of(spark, [
        (1, "E", "z", NOW - dt.timedelta(days=7)),
        (2, "E", "z", NOW - dt.timedelta(days=7) + dt.timedelta(seconds=1)),
    ])
    old = NOW - dt.timedelta(days=2)
    results = results_of(spark, [(1, 1, NOW, 1), (2, 2, old, 1), (3, 2, old, 0), (4, 9, old, 1)])
    got = failures.failure_rate(passes, results, bucket=DAY_ISO, keys=("environ_name", "zone"),
                                as_of=AS_OF, lookback=(7, "day")).collect()
    assert [tuple(r) for r in got] == [("2001-06-29", "E", "z", 2, 1, 0.5)]


def test_us_day_labels_sort_as_text_over_the_year_end(spark):
    passes = passes_of(spark, [(1, "E", "z", dt.datetime(2001, 12, 30))])
    results = results_of(spark, [(1, 1, dt.datetime(2001, 12, 31), 0),
                                 (2, 1, dt.datetime(2002, 1, 1), 0)])
    got = failures.failure_rate(passes, results, bucket=DAY_US, keys=("zone",),
                                as_of="2002-01-03 00:00:00", lookback=(7, "day"), ascending=True).collect()
    assert [r.my_date for r in got] == ["01-01-2002", "12-31-2001"]


def test_moving_average_bounds_and_weights(spark):
    rng = random.Random(5)
    passes, results = [], []
    for i in range(60):
        start = NOW - dt.timedelta(days=rng.randrange(0, 20), hours=rng.choice([0, 0, 5]))
        passes.append((i, rng.choice("EF"), "z", start))
        for _ in range(rng.randrange(1, 6)):
            results.append((len(results), i, start, rng.randrange(2)))
    got = failures.failure_rate_moving_avg(
        passes_of(spark, passes), results_of(spark, results), as_of=AS_OF, period=5, days=7)
    want = {}
    for env in "EF":
        for i in range(7):
            low, high = NOW - dt.timedelta(days=i + 5), NOW - dt.timedelta(days=i)
            inside = {p for p, e, _, s in passes if e == env and low < s < high}
            flags = [h for _, p, _, h in results if p in inside]
            if flags:
                want[env, i] = (len(flags), sum(flags) / len(flags))
    assert {(r.environ_name, r.days_ago): (r.total_tests, r.failure_rate)
            for r in got.collect()} == want


def test_zero_timings_do_not_enter_an_average(spark):
    passes = passes_of(spark, [(1, "E", "z", NOW)])
    results = spark.createDataFrame(
        [(1, 1, 2, 10.0, 0.0, 4.0, 0.0, 0), (2, 1, 2, 0.0, 0.0, 0.0, 6.0, 1)],
        "test_id long, test_pass_id long, concurrency_count int, time_total double, "
        "time_to_active double, time_to_ping double, time_to_ssh double, hard_errors_exist int"
    ).withColumn("time_started", F.lit(NOW).cast("timestamp_ntz"))
    row = latency.latency_by(passes, results, keys=("zone",), order=("zone",), as_of=AS_OF,
                             lookback=(7, "day")).first()
    assert (row.avg_time_total, row.avg_time_to_active, row.avg_time_to_ping,
            row.avg_time_to_ssh, row.pct_error) == (10.0, None, 4.0, 6.0, 0.5)
    plain = latency.latency_by_concurrency(results).first()
    assert (plain.avg_time_total, plain.avg_time_to_active) == (5.0, 0.0)


def test_histogram_keeps_empty_and_missing_types(spark):
    actions = spark.createDataFrame([("",), (None,), ("None",), ("x",), ("x",)],
                                    "error_type string")
    got = {r.error_type: r.errors for r in error_counts.error_type_histogram(actions).collect()}
    assert got == {"": 1, None: 1, "None": 1, "x": 2}


def test_cross_report_counts_every_pass(spark):
    passes = passes_of(spark, [(i, "E", "z", NOW) for i in range(3)])
    results = results_of(spark, [(1, 0, NOW, 0)])
    actions = spark.createDataFrame([(1, "boot", "x"), (1, "ssh", "x"), (7, "ssh", "x")],
                                    "test_id long, function_name string, error_type string")
    row = error_counts.error_counts_cross(passes, results, actions).first()
    assert (row.func_error_count, row.function_name, row.environ_name) == (6, "boot", "E")


def attempts_of(spark, rows):
    return spark.createDataFrame(
        rows, "test_id long, function_name string, time_started timestamp_ntz, "
              "time_end timestamp_ntz, error_text string")


def test_retry_gaps(spark):
    at = lambda s: NOW + dt.timedelta(seconds=s)
    got = rollup.retry_attempts(attempts_of(spark, [
        (1, "boot", at(0), at(2), "x"), (1, "boot", at(7), at(9), "x"),
        (1, "boot", at(19), at(20), ""), (1, "ssh", at(30), at(31), "")]))
    rows = [tuple(r)[1:] for r in got.orderBy("function_name", "attempt").collect()]
    assert [(f, n, g, e) for f, _, n, g, e in rows] == [
        ("boot", 1, None, None), ("boot", 2, 5.0, 5.0), ("boot", 3, 10.0, 10.0),
        ("ssh", 1, None, None)]


@pytest.mark.parametrize("grain", ["minute", "hour", "day"])
def test_retry_numbers_of_a_hot_test_equal_brute_force(spark, grain):
    """One test owns a third of the rows, spread over many chunks; unknown tests count too."""
    rng = random.Random(11)
    rows = []
    for _ in range(1500):
        test = rng.choice([1, 1, 1, None, None, *range(2, 8)])
        start = NOW + dt.timedelta(seconds=rng.randrange(200_000))
        rows.append((test, rng.choice(["boot", "ssh"]), start,
                     start + dt.timedelta(seconds=rng.randrange(60)), rng.choice(["", "x"])))
    groups = defaultdict(list)
    for row in rows:
        groups[row[:2]].append(row)
    want = Counter()
    for (test, function), members in groups.items():
        members.sort(key=lambda r: r[2:])
        for n, row in enumerate(members, 1):
            gap = (row[2] - members[n - 2][3]).total_seconds() if n > 1 else None
            want[test, function, row[2], n, gap] += 1
    got = rollup.retry_attempts(attempts_of(spark, rows), grain=grain).collect()
    assert Counter((r.test_id, r.function_name, r.time_started, r.attempt, r.gap_seconds)
                   for r in got) == want


def test_percentiles_equal_brute_force(spark):
    rng = random.Random(2)
    sizes = {"hot": 2000, "short": 1, "pair": 2, "mid": 333}
    rows = [(name, round(rng.expovariate(0.05), rng.choice([0, 3])))
            for name, n in sizes.items() for _ in range(n)]
    actions = spark.createDataFrame(rows, "function_name string, time_total double")
    want = {}
    for name in sizes:
        ordered = sorted((v for f, v in rows if f == name), reverse=True)
        for k in (2, 4, 20, 100):
            offset = (2 * len(ordered) + k) // (2 * k)
            if offset < len(ordered):
                want[name, k] = (offset, ordered[offset])
    got = ranks.percentile_rows(actions).collect()
    assert {(r.function_name, r.divisor): (r.row_offset, r.time_total) for r in got} == want
    assert len(got) == len(want)


def builds_of(spark, rows):
    return spark.createDataFrame(
        rows, "id string, name string, end_date timestamp_ntz, result string")


def test_sequential_failures_and_ties(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [("1", "a", at(1), "SUCCESS"), ("2", "a", at(2), "FAILURE"), ("3", "a", at(3), "FAILURE"),
            ("4", "a", at(4), "FAILURE"),
            ("5", "b", at(1), "FAILURE"), ("6", "b", at(2), "FAILURE"),
            ("7", "c", at(1), "FAILURE"), ("8", "c", at(1), "SUCCESS"), ("9", "c", at(2), "FAILURE")]
    df = builds_of(spark, rows)
    assert [r.name for r in builds.sequential_failures(df, 3).collect()] == ["a"]
    assert [r.name for r in builds.sequential_failures(df, 3, threshold=2).collect()] == [
        "a", "b", "c"]
    last_two = {r.name: r.failures for r in builds.failures_in_last(df, 2).collect()}
    assert last_two == {"a": 2, "b": 2, "c": 1}


def test_rollup_counts_hard_and_soft(spark):
    rows = [(1, NOW, NOW + dt.timedelta(seconds=4), "(HTTP 500)"),
            (1, NOW, NOW + dt.timedelta(seconds=8), "(HTTP 429) Rate Limited"),
            (1, NOW, NOW, ""), (2, NOW, NOW, None)]
    actions = spark.createDataFrame(
        rows, "test_id long, time_started timestamp_ntz, time_end timestamp_ntz, error_type string")
    got = {r.test_id: r for r in rollup.rollup_test_results(actions).collect()}
    one, two = got[1], got[2]
    assert (one.action_count, one.hard_error_count, one.soft_error_count, one.hard_errors_exist,
            one.time_total, one.rps) == (3, 1, 1, 1, 8.0, 0.375)
    assert (two.hard_errors_exist, two.time_total, two.rps) == (0, 0.0, None)


def test_throughput_stops_after_the_first_slow_size(spark):
    rows = [("d", 512, 1, 40.0), ("d", 512, 2, 40.0), ("d", 1024, 1, 10.0), ("d", 2048, 1, 90.0),
            ("e", 512, 1, 1.0), ("e", 1024, 1, 99.0)]
    samples = spark.createDataFrame(rows, "device string, blocksize long, thread long, iops double")
    got = {(r.device, r.blocksize): r for r in rollup.io_throughput(samples).collect()}
    assert set(got) == {("d", 512), ("d", 1024), ("e", 512)}
    assert got["d", 512].bandwidth == 40960 and got["d", 512].bits == 327680
    assert got["d", 512].bandwidth_label == " 40.0 Ki" and got["d", 512].bits_label == "327.7 k"


def test_later_scrubs_overwrite_earlier_ones(spark):
    both = "Permission denied (publickey) then Test timed out"
    df = spark.createDataFrame([(both, "old"), ("plain", "old"), (None, "old")],
                               "error_text string, error_type string")
    got = [r.error_type for r in maintenance.scrub(df, maintenance.ERROR_SCRUBS).collect()]
    assert got == ["Test timed out", "old", "old"]


def test_upsert_takes_the_newest_version_and_ignores_unknown_ids(spark):
    schema = "test_pass_id long, time_end timestamp_ntz, time_total double"
    passes = spark.createDataFrame([(1, None, None), (2, NOW, 5.0), (3, NOW, 7.0)], schema)
    updates = spark.createDataFrame(
        [(1, NOW, 1.0, 1), (1, NOW, 2.0, 2), (3, None, None, 1), (9, NOW, 9.0, 1)],
        schema + ", version int")
    got = maintenance.upsert_pass_end(passes, updates).orderBy("test_pass_id").collect()
    assert [tuple(r) for r in got] == [(1, NOW, 2.0), (2, NOW, 5.0), (3, None, None)]


def test_cascade_keeps_rows_without_a_parent(spark):
    passes = passes_of(spark, [(1, "E", "z", NOW), (2, "E", "y", NOW)])
    results = results_of(spark, [(10, 1, NOW, 0), (20, 2, NOW, 0), (30, None, NOW, 0)])
    actions = spark.createDataFrame([(10,), (20,), (30,), (None,)], "test_id long")
    kept = maintenance.cascade_delete(passes, results, actions, F.col("zone") == "z")
    assert [{r[0] for r in t.collect()} for t in kept] == [{2}, {20, 30}, {20, 30, None}]
    bad = maintenance.orphans(results, "test_pass_id", passes.filter("zone = 'y'"), "test_pass_id")
    assert {r.test_id for r in bad.collect()} == {10}


def test_ids_continue_in_natural_order(spark):
    rng = random.Random(4)
    rows = [(NOW + dt.timedelta(minutes=rng.randrange(5000)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, k long").repartition(7)
    got = ranks.assign_ids(df, id_name="id", time="t", order=["t", "k"],
                           existing=spark.createDataFrame([(7,), (50,)], "id long")).collect()
    assert [(r.t, r.k) for r in sorted(got, key=lambda r: r.id)] == sorted(rows)
    assert sorted(r.id for r in got) == list(range(51, 451))


def test_snapshot_selection(spark):
    schema = "id long, ip string, instance_id long"
    first = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", 3)], schema)
    second = spark.createDataFrame([(1, "a", None), (2, "b", 2), (3, "c", None), (4, "d", None)],
                                   schema)
    nothing = spark.createDataFrame([], "ip string")
    assert [r.ip for r in snapshots.orphaned_ips(first, second, nothing).collect()] == ["a"]
    empty = spark.createDataFrame([], schema)
    assert snapshots.orphaned_ips(empty, second, nothing).count() == 0
    ignored = spark.createDataFrame([("a",)], "ip string")
    assert snapshots.orphaned_ips(first, second, ignored).count() == 0


def test_snapshot_delta_reports_missing_sides(spark):
    before = spark.createDataFrame([("a", 1), ("b", 5), ("gone", 2)], "name string, value long")
    after = spark.createDataFrame([("a", 2), ("b", 5), ("new", 1)], "name string, value long")
    got = {r.name: (r.delta, r.as_expected)
           for r in snapshots.snapshot_delta(before, after).collect()}
    assert got == {"a": (1, 1), "b": (0, 0), "gone": (None, 0), "new": (None, 0)}


def test_add_if_absent_adds_each_new_key_once(spark):
    known = spark.createDataFrame([("a", "old")], "name string, key string")
    new = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "name string, key string")
    got = {tuple(r) for r in snapshots.add_if_absent(new, known, "name").collect()}
    assert got == {("a", "old"), ("b", "y")}


def test_pattern_is_anchored_as_a_whole(spark):
    servers = spark.createDataFrame([("ab",), ("xab",), ("cd",), ("xcd",)], "name string")
    got = snapshots.servers_with_pattern(servers, "ab|cd", ["cd"]).collect()
    assert [r.name for r in got] == ["ab"]


def test_zero_fill_covers_every_day(spark):
    rows = spark.createDataFrame([("s", NOW, 5)], "series string, point timestamp_ntz, pct int")
    got = series.zero_filled(rows, AS_OF, days=10).collect()
    assert len(got) == 10 and sum(r.pct for r in got) == 5


# -- needles and moving averages -----------------------------------------------------------------

def test_needles_of_every_length_equal_brute_force(spark):
    from faultline.operators.snapshots import first_match, first_match_of

    servers = [("srv-1", "abcabc"), ("srv-2", "zabc"), (None, "ab"), ("é😀x", None), (None, None),
               ("a", ""), ("bcd", "a")] + [(f"srv-{i}", f"name{i % 7}") for i in range(50)]
    images = spark.createDataFrame(servers, "id string, name string")
    needles = ["", "a", "b", "ab", "abc", "cab", "bca", "abcabc", "srv-1", "srv-49", "é", "😀", "é😀",
               "é😀x", "e4", "name", "nobody", "zz", "q", "zabcd", "-1", "v-1"]
    table = spark.createDataFrame([(n,) for n in [*needles, None, "a"]], "needle string")
    plain = {}
    for needle in needles:
        hits = [(n, i) for i, n in servers if needle in (n or "\0") or needle in (i or "\0")]
        hits = [h for h in hits if h != (None, None)]
        if hits:
            plain[needle] = min(hits, key=lambda h: tuple((v is not None, v or "") for v in h))
    found = {r.needle: (r.name, r.id) for r in first_match_of(images, table).collect()}
    assert found == plain
    listed = {r.needle: (r.name, r.id) for r in first_match(images, [n for n in needles if n]).collect()}
    assert {k: v for k, v in found.items() if k} == listed


def test_many_needles_make_no_nested_loop(spark):
    from faultline.operators.snapshots import first_match_of

    images = spark.range(20_000).select(F.concat(F.lit("srv-"), "id").alias("id"),
                                        F.concat(F.lit("Customer#"), "id").alias("name"))
    needles = spark.range(100_000).select(F.concat(F.lit("r#"), "id").alias("needle"))
    found = first_match_of(images, needles)
    plan = found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert found.count() == 20_000


def test_moving_average_counts_each_day_once(spark):
    from faultline.operators.failures import failure_rate_moving_avg

    as_of, day = dt.datetime(2001, 7, 1), dt.timedelta(days=1)
    starts = [as_of - k * day + d for k in range(0, 14)
              for d in (-dt.timedelta(seconds=1), dt.timedelta(0), dt.timedelta(microseconds=1))]
    starts = [s for s in starts if s <= as_of]
    passes = spark.createDataFrame([(i, "E", "z", s) for i, s in enumerate(starts)],
                                   "test_pass_id long, environ_name string, zone string, "
                                   "time_started timestamp_ntz")
    results = spark.createDataFrame([(i, s, i % 2) for i, s in enumerate(starts)],
                                    "test_pass_id long, time_started timestamp_ntz, "
                                    "hard_errors_exist int")
    found = failure_rate_moving_avg(passes, results, as_of=as_of, period=4, days=6).collect()
    plain = {}
    for i in range(6):
        # The report looks back from the reference time, beginning excluded.
        inside = [n for n, s in enumerate(starts) if as_of - (i + 4) * day < s < as_of - i * day
                  and s > as_of - 9 * day]
        if inside:
            plain[i] = (len(inside), sum(n % 2 for n in inside) / len(inside))
    assert {r.days_ago: (r.total_tests, r.failure_rate) for r in found} == plain


def test_lookup_spreads_its_pieces_over_tasks_by_the_rows(spark, monkeypatch):
    import re

    from faultline.operators import snapshots

    monkeypatch.setattr(snapshots, "INDEX_ROWS", 10)
    rows = [(f"name-{i % 40:03d}", f"{i % 40}") for i in range(80)] + [(None, "x1"), ("y", None)]
    words = ["name", "e-0", "03", "9", "x1", "y", "-01", "absent", ""]
    found = snapshots.first_match_of(
        spark.createDataFrame(rows, "name string, id string"),
        spark.createDataFrame([(w,) for w in words], "needle string"))
    dealt = re.findall(r"RepartitionByExpression \[name#\d+, id#\d+\], (\d+)",
                       found._jdf.queryExecution().toString())
    assert dealt and set(dealt) == {"9"}
    order = lambda r: [(v is not None, v or "") for v in r]
    want = {w: min(hits, key=order) for w in words
            if (hits := [r for r in rows if any(v is not None and w in v for v in r)])}
    assert {r.needle: (r.name, r.id) for r in found.collect()} == want
