"""Stored tables that change, and retry episodes, against plain versions."""

import datetime as dt
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from faultline.operators import maintenance, rollup
from faultline.sources.derived import Tables
from faultline.sources.versions import VersionedTables

RECENT = "time_started > timestamp_ntz'2001-06-20'"


def rows_of(df):
    return Counter(map(str, df.select(*sorted(df.columns)).collect()))


def files_of(root, table):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/{table}") for f in names
            if f.endswith(".parquet")}


@pytest.fixture(scope="module")
def recent(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    found = {n: getattr(tables, n)().filter(RECENT).cache()
             for n in ("test_passes", "test_results", "test_actions")}
    return found


@pytest.fixture
def stored(spark, recent, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "db"))
    tables.append(**recent)
    return tables


def test_a_cascade_rewrites_the_touched_days_alone(stored, recent):
    gone = recent["test_results"].filter("test_pass_id is not null").first()["test_pass_id"]
    before = {t: files_of(stored.root, t) for t in recent}
    old = stored.state()[1]
    want = maintenance.cascade_delete(*recent.values(), F.col("test_pass_id") == gone)
    assert stored.cascade_delete(F.col("test_pass_id") == gone) == 2
    new = stored.state()[1]
    for table, kept in zip(recent, want):
        assert rows_of(stored.read(table)) == rows_of(kept.select(*stored.read(table).columns))
        assert before[table] <= files_of(stored.root, table)
        added = {f.split("event_date=")[1].split("/")[0]
                 for f in files_of(stored.root, table) - before[table]}
        changed = {d for d in old[table] if new[table].get(d) != old[table][d]}
        assert added <= changed and len(changed) < len(old[table])
        rows = recent[table]
        if table == "test_actions":
            tests = recent["test_results"].filter(F.col("test_pass_id") == gone)
            mine = rows.join(tests, "test_id", "left_semi")
        else:
            mine = rows.filter(F.col("test_pass_id") == gone)
        assert changed == {str(r[0]) for r in mine.select(F.col("time_started").cast("date")).collect()}


def test_a_crash_before_the_manifest_changes_nothing(stored, recent, monkeypatch):
    before = {t: rows_of(stored.read(t)) for t in recent}

    def crash(*args, **options):
        raise OSError("lost")

    monkeypatch.setattr(stored.manifests, "write", crash)
    with pytest.raises(OSError):
        stored.cascade_delete(F.lit(True))
    assert {t: rows_of(stored.read(t)) for t in recent} == before
    monkeypatch.undo()
    stored.cascade_delete(F.lit(True))
    assert stored.read("test_passes").count() == 0


def test_of_two_writers_one_is_refused(spark, stored, recent):
    other = VersionedTables(spark, stored.root)
    old = other.state
    seen = old()
    stored.append(test_passes=recent["test_passes"].limit(1))
    other.state = lambda: seen
    with pytest.raises(FileExistsError):
        other.append(test_passes=recent["test_passes"].limit(2))
    other.state = old
    assert other.read("test_passes").count() == recent["test_passes"].count() + 1


def test_upsert_scrub_and_vacuum(stored, recent):
    updates = recent["test_passes"].filter("test_pass_id % 3 = 0").select(
        "test_pass_id", F.lit(dt.datetime(2002, 1, 1)).cast("timestamp_ntz").alias("time_end"),
        F.lit(5.0).alias("time_total"), F.lit(1).alias("version"))
    stored.upsert_pass_ends(updates)
    want = maintenance.upsert_pass_end(recent["test_passes"], updates)
    assert rows_of(stored.read("test_passes")) == rows_of(
        want.select(*stored.read("test_passes").columns))
    stored.scrub("test_actions", maintenance.ERROR_SCRUBS)
    want = maintenance.scrub(recent["test_actions"], maintenance.ERROR_SCRUBS)
    assert rows_of(stored.read("test_actions")) == rows_of(
        want.select(*stored.read("test_actions").columns))
    version = stored.state()[0]
    assert stored.scrub("test_actions", maintenance.ERROR_SCRUBS) == version
    live = {t: rows_of(stored.read(t)) for t in recent}
    sizes = sum(len(files_of(stored.root, t)) for t in recent)
    stored.vacuum(keep=1)
    assert {t: rows_of(stored.read(t)) for t in recent} == live
    assert sum(len(files_of(stored.root, t)) for t in recent) < sizes


def test_empty_tables_and_nothing_to_change(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "db"))
    assert tables.read("test_actions").count() == 0
    assert tables.cascade_delete(F.lit(True)) == 0
    assert tables.scrub("test_actions", maintenance.ERROR_SCRUBS) == 0


# -- retry episodes --------------------------------------------------------------------------

def plain_episodes(rows, tries=5):
    of = defaultdict(list)
    for r in rows:
        of[r.test_id, r.function_name].append(r)
    out = []
    for key, mine in of.items():
        place, before = 0, None
        for r in sorted(mine, key=lambda r: (r.time_started, r.time_end, r.error_type is not None,
                                             r.error_type or "")):
            place = place % tries + 1
            gap = (r.time_started - before).total_seconds() if place > 1 else None
            out.append((*key, r.time_started, r.error_type, place, gap,
                        5.0 * 2 ** (place - 2) if place > 1 else None))
            before = r.time_end
            if r.error_type in (None, "", "None"):
                place = 0
    return Counter(out)


@pytest.mark.parametrize("modulus,grain", [(7, "hour"), (3, "day"), (1, "minute")])
def test_episodes_of_hot_tests_equal_brute_force(spark, recent, modulus, grain):
    calls = recent["test_actions"].withColumns(
        {"test_id": F.when(F.col("test_id") % 11 > 0, F.col("test_id") % modulus),
         "function_name": F.lit("call"),
         "error_type": F.when(F.col("test_id") % 5 == 0, F.lit("None")).otherwise(
             F.when(F.col("time_total") > 6, F.lit("Timeout")).otherwise(F.col("error_type")))})
    found = rollup.retry_episodes(calls, grain=grain).collect()
    got = Counter((r.test_id, r.function_name, r.time_started, r.error_type, r.attempt,
                   r.gap_seconds, r.expected_gap) for r in found)
    assert got == plain_episodes(calls.collect())
    assert max(r.expected_gap or 0 for r in found) <= 40
