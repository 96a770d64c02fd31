"""Windows closed by a watermark, and id ranges over several appends."""

import datetime as dt
import os
import threading

import pytest

from faultline.sources.files import Folder
from faultline.sources.ledger import IdLedger, with_new_ids
from faultline.streaming import sinks, windows

BASE = dt.datetime(2001, 6, 1, 12)
SCHEMA = "test_id long, time_started timestamp_ntz"


def plain(batches, size=60, slide=30, delay=120):
    """(window start, requests, late) per closed window, row by row."""
    passed, open_, closed, late = None, {}, {}, {}
    for batch in batches:
        times = [t for _, t in batch if t is not None]
        for t in times:
            first = int((t - BASE).total_seconds()) // slide * slide
            for start in range(first - size + slide, first + 1, slide):
                end = BASE + dt.timedelta(seconds=start + size)
                into = late if passed and end <= passed else open_
                into[start] = into.get(start, 0) + 1
        if times:
            mark = max(times) - dt.timedelta(seconds=delay)
            passed = max(passed or mark, mark)
            for start in [s for s in open_ if BASE + dt.timedelta(seconds=s + size) <= passed]:
                closed[start] = open_.pop(start)
    return sorted((BASE + dt.timedelta(seconds=s), closed.get(s, 0), late.get(s, 0))
                  for s in {*closed, *late}), open_


@pytest.fixture(scope="module")
def batches():
    """Twenty-four files whose rows come up to five minutes after later ones."""
    out = []
    for n in range(24):
        seconds = [n * 40 + (i * 37) % 90 - (300 if (i + n) % 9 == 0 else 0) for i in range(20)]
        out.append([(i % 3, BASE + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)]
                   + [(1, None)] * (n == 3))
    return out


def test_closed_and_late_windows_match_plain(spark, tmp_path, batches):
    path, run = str(tmp_path / "in"), sinks.StreamRun(str(tmp_path / "run"))
    tests = spark.createDataFrame([(i, "E") for i in range(3)], "test_id long, environ_name string")

    def process():
        windows.run_window_counts(sinks.file_stream(spark, path, files_per_trigger=1), run,
                                  window="60 seconds", slide="30 seconds", delay="2 minutes")
        rows = windows.final_request_rates(spark, run, tests).collect()
        assert all(abs(r.rps - r.requests / 60) < 1e-12 for r in rows)
        return sorted((r.window_start, r.requests, r.late_requests) for r in rows)

    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        if n in (9, 23):
            wanted, still_open = plain(batches[:n + 1])
            assert process() == wanted
    assert sum(late for _, _, late in wanted) > 20 and still_open
    state = windows.window_state(spark, run)
    # Every pair of row and window is in exactly one place.
    stored = sum(windows._read(spark, run, f).selectExpr("sum(requests)").first()[0]
                 for f in (state["closed"], state["late"], [state["open"]]))
    assert stored == 2 * sum(t is not None for b in batches for _, t in b)
    # Folders are merged, and what no manifest names is gone.
    assert len(state["closed"]) < 2 * windows.COMPACT
    assert len(Folder(spark, f"{run.root}/manifest").folders(run.data)) < 4 * windows.COMPACT


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, batches):
    """The last manifest and the commit of its batch are lost, as in a crash before they were
    written: the batch begins anew at the manifest before."""
    path, run = str(tmp_path / "in"), sinks.StreamRun(str(tmp_path / "run"))
    tests = spark.createDataFrame([(i, "E") for i in range(3)], "test_id long, environ_name string")

    def process():
        windows.run_window_counts(sinks.file_stream(spark, path, files_per_trigger=1), run,
                                  window="60 seconds", slide="30 seconds", delay="2 minutes")
        return sorted(map(tuple, windows.final_request_rates(spark, run, tests).collect()))

    for batch in batches[:4]:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    wanted = process()
    Folder(spark, f"{run.root}/manifest").remove(3)
    for name in ("3", ".3.crc"):
        (tmp_path / "run" / "checkpoint" / "commits" / name).unlink()
    assert process() == wanted


def test_an_empty_run_has_no_windows(spark, tmp_path):
    run = sinks.StreamRun(str(tmp_path / "run"))
    tests = spark.createDataFrame([], "test_id long, environ_name string")
    assert windows.final_request_rates(spark, run, tests).count() == 0


def test_ranges_of_appends_at_one_time_are_apart(spark, tmp_path):
    ledger, taken = IdLedger(spark, str(tmp_path / "ledger")), []
    tries = [threading.Thread(target=lambda n=n: taken.append((ledger.reserve(n), n)))
             for n in range(1, 9)]
    for t in tries:
        t.start()
    for t in tries:
        t.join()
    ids = sorted(i for first, n in taken for i in range(first, first + n))
    assert ids == list(range(1, 37))


def test_a_number_taken_at_the_last_moment_is_refused(spark, tmp_path, monkeypatch):
    """Another writer takes the number after the look whether it is free."""
    one, other = (IdLedger(spark, str(tmp_path / "ledger")).files for _ in range(2))

    class Late:
        def __getattr__(self, name):
            return getattr(other._fs, name)

        def exists(self, path):
            found = other._fs.exists(path)
            if path.getName() == "0.json":
                other.write(0, {"first": 1, "count": 5})
            return found
    monkeypatch.setattr(one, "_fs", Late())
    with pytest.raises(FileExistsError):
        one.write(0, {"first": 1, "count": 2})
    assert other.read(0) == {"first": 1, "count": 5} and other.numbers() == [0]
    assert not [f for f in os.listdir(tmp_path / "ledger") if f.endswith(".draft")]


def test_only_the_newest_ranges_are_kept(spark, tmp_path):
    ledger = IdLedger(spark, str(tmp_path / "ledger"))
    assert [ledger.reserve(2) for _ in range(105)] == list(range(1, 211, 2))
    assert len(ledger.files.numbers()) <= IdLedger.KEPT + 1


def test_new_ids_continue_without_reading_stored_rows(spark, tmp_path):
    ledger = IdLedger(spark, str(tmp_path / "ledger"))
    ids = {}
    for part in (0, 1, 2):
        rows = spark.range(part, 60, 3).selectExpr(
            "id", "timestamp_ntz'2001-06-01 00:00:00' + make_dt_interval(id * 3) AS t")
        df = with_new_ids(rows, ledger, id_name="n", time="t", order=["t", "id"])
        ids |= {r.id: r.n for r in df.collect()}
    none = with_new_ids(rows.limit(0), ledger, id_name="n", time="t", order=["t", "id"])
    assert none.count() == 0 and ledger.reserve(1) == 61
    assert ids == {i: 1 + 20 * (i % 3) + i // 3 for i in range(60)}
