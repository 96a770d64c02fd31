"""Quantile sketches and key bitmaps against exact ranks and anti joins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import maintenance, ranks, summaries
from faultline.sources.derived import AS_OF, Tables


@pytest.mark.parametrize("spread", [1, 60])
def test_ranks_of_merged_sketches_are_within_their_bound(spark, tmp_path, spread):
    path = str(tmp_path / "sketches")
    start = F.timestamp_add("DAY", (F.col("id") % spread).cast("int"),
                            F.lit("2001-05-01").cast("timestamp_ntz"))
    call = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 4))
    log = spark.range(60_000).select(
        call.alias("function_name"), start.alias("time_started"),
        (F.pmod(F.xxhash64("id"), F.lit(50_000)) / 7).alias("time_total"))
    third = F.pmod(F.xxhash64("time_total"), F.lit(3))
    for part in range(3):
        summaries.store_sketches(summaries.duration_sketches(log.filter(third == part)), path)
    found = summaries.sketched_percentiles(spark.read.parquet(path)).collect()
    exact = {(r.function_name, r.divisor): r.row_offset for r in ranks.percentile_rows(log).collect()}
    assert {(r.function_name, r.divisor): r.row_offset for r in found} == exact
    values = {}
    for r in log.select("function_name", "time_total").collect():
        values.setdefault(r.function_name, []).append(r.time_total)
    for r in found:
        mine = values[r.function_name]
        room = 2 * summaries.RANK_ERROR * len(mine) + 1
        above = sum(v > r.time_total for v in mine)
        upto = sum(v >= r.time_total for v in mine)
        assert above - room <= r.row_offset <= upto + room


def test_a_look_back_reads_its_days_alone(spark, sf_dir, tmp_path):
    path = str(tmp_path / "sketches")
    log = Tables(spark, sf_dir).test_actions().filter("time_started > timestamp_ntz'2001-06-01'")
    summaries.store_sketches(summaries.duration_sketches(log), path)
    found = summaries.sketched_percentiles(spark.read.parquet(path), as_of=AS_OF, lookback=(7, "day"))
    recent = log.filter("cast(time_started as date) between '2001-06-26' and '2001-07-03'")
    counts = {r.function_name: r["count"] for r in recent.groupBy("function_name").count().collect()}
    assert {r.function_name: r.n for r in found.collect()} == counts
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_empty_and_missing_values(spark):
    schema = "function_name string, time_started timestamp_ntz, time_total double"
    none = spark.createDataFrame([], schema)
    assert summaries.sketched_percentiles(summaries.duration_sketches(none)).count() == 0
    one = spark.createDataFrame([("a", dt.datetime(2001, 1, 1), None), (None, dt.datetime(2001, 1, 1), 3.0),
                                 (None, None, 3.0)], schema)
    rows = summaries.sketched_percentiles(summaries.duration_sketches(one)).collect()
    assert {(r.function_name, r.n, r.time_total) for r in rows} == {(None, 2, 3.0)}


def test_bitmaps_find_the_orphans_of_an_anti_join(spark):
    rng = random.Random(3)
    parents = [rng.choice([-70_000, 0, 5, 32_767, 32_768, 10**12]) + rng.randint(0, 300)
               for _ in range(500)]
    children = [p + rng.randint(0, 3) for p in parents] * 2 + [parents[0]] * 1000 + [None] * 5
    parent = spark.createDataFrame([(p,) for p in parents] + [(None,)], "k long")
    child = spark.createDataFrame([(c,) for c in children], "k long")
    bitmaps = summaries.key_bitmaps(parent.filter("k % 2 = 0"), "k").union(
        summaries.key_bitmaps(parent.filter("k % 2 <> 0"), "k"))
    found = {r.k: r.n for r in summaries.unknown_keys(child, "k", bitmaps).collect()}
    known = set(parents)
    plain = {}
    for c in children:
        if c is not None and c not in known:
            plain[c] = plain.get(c, 0) + 1
    assert found == plain
    both = [summaries.orphan_counts_by_bitmap([("r", child, "k", bitmaps)]),
            maintenance.orphan_counts([("r", child, "k", parent, "k")])]
    assert both[0].collect() == both[1].collect()
    empty = summaries.key_bitmaps(parent.limit(0), "k")
    assert summaries.unknown_keys(child, "k", empty).agg(F.sum("n")).first()[0] == len(children) - 5
