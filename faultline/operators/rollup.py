"""Roll-up of the action log into test and pass facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.errors import is_success, with_severity
from faultline.functions.numbers import humanize_units
from faultline.functions.times import elapsed_seconds, hour_start, minute_start
from faultline.operators.ranks import number_in_order

# The call that reaches each milestone of a test.
MILESTONES = {
    "active": "wait_for_active_status",
    "ping": "ping_device",
    "ssh": "ssh",
    "deleted": "server_delete",
}


# Parts of the log that are numbered on their own.
CHUNKS = {"minute": minute_start, "hour": hour_start, "day": lambda ts: ts.cast("date")}


def rollup_test_results(actions: DataFrame) -> DataFrame:
    """Per test: action and error counts, elapsed time and requests per second."""
    severity = F.col("severity")
    per_test = with_severity(actions).groupBy("test_id").agg(
        F.count("*").alias("action_count"),
        F.count_if(severity == "hard").alias("hard_error_count"),
        F.count_if(severity == "soft").alias("soft_error_count"),
        F.min("time_started").alias("time_started"),
        F.max("time_end").alias("time_end"),
    )
    total = elapsed_seconds(F.col("time_started"), F.col("time_end"))
    return per_test.select(
        "*",
        (F.col("hard_error_count") > 0).cast("int").alias("hard_errors_exist"),
        total.alias("time_total"),
    ).withColumn("rps", F.round(F.col("action_count") / F.nullif("time_total", F.lit(0.0)), 3))


def milestone_times(results: DataFrame, actions: DataFrame) -> DataFrame:
    """Seconds from test start to each milestone, 0 when it was not reached, and flags."""
    reached = actions.filter(
        is_success(F.col("error_type")) & F.col("function_name").isin(*MILESTONES.values()))
    last = reached.groupBy("test_id").agg(*[
        F.max(F.when(F.col("function_name") == call, F.col("time_end"))).alias(f"{name}_at")
        for name, call in MILESTONES.items()])
    joined = results.select("test_id", "time_started").join(last, "test_id", "left")
    times = {f"time_to_{name}": F.coalesce(
        elapsed_seconds(F.col("time_started"), F.col(f"{name}_at")), F.lit(0.0))
        for name in MILESTONES}
    flags = {f"is_{label}": F.col(f"{name}_at").isNotNull().cast("int")
             for name, label in [("active", "active"), ("ping", "pingable"), ("ssh", "sshable")]}
    return joined.select("test_id", *[c.alias(n) for n, c in {**times, **flags}.items()])


def close_passes(passes: DataFrame, results: DataFrame) -> DataFrame:
    """End and total seconds of each pass from its tests; one closing record per pass."""
    ends = results.groupBy("test_pass_id").agg(F.max("time_end").alias("time_end"))
    joined = passes.select("test_pass_id", "time_started").join(ends, "test_pass_id")
    return joined.select("test_pass_id", "time_end", elapsed_seconds(
        F.col("time_started"), F.col("time_end")).alias("time_total"))


def retry_attempts(actions: DataFrame, *, delay: int = 5, back_off: int = 2,
                   grain: str = "hour") -> DataFrame:
    """Attempt number of every action within its test and function, the gap to the attempt
    before and the gap the retry policy asks for. Attempts that start and end together are
    alike here, so nothing else need be sorted."""
    order = ["time_started", "time_end"]
    rows = actions.select("test_id", "function_name", *order)
    numbered = number_in_order(
        rows, group=["test_id", "function_name"], order=order, carry="time_end",
        chunk=CHUNKS[grain](F.col("time_started")))
    gap = elapsed_seconds(F.col("previous"), F.col("time_started"))
    expected = F.when(F.col("row_no") > 1,
                      F.lit(float(delay)) * F.pow(F.lit(back_off), F.col("row_no") - 2))
    return numbered.select("test_id", "function_name", "time_started",
                           F.col("row_no").cast("bigint").alias("attempt"),
                           gap.alias("gap_seconds"), expected.alias("expected_gap"))


def retry_episodes(actions: DataFrame, *, tries: int = 5, delay: int = 5, back_off: int = 2,
                   grain: str = "hour") -> DataFrame:
    """Attempts as the retry policy makes them: numbered anew after a success and after the last of
    ``tries``, with the gap to the attempt before and the gap the policy asks for.

    Islands between successes are numbered inside time chunks of a test and function; a chunk's
    first island goes on from the failures that ended the chunks before it, which come as one
    summary row per chunk. So no busy test is sorted in one task.
    """
    order = ["time_started", "time_end", F.col("error_type").asc_nulls_first()]
    group = ["test_id", "function_name"]
    rows = actions.select(*group, "time_started", "time_end", "error_type").withColumns({
        "_ok": is_success(F.col("error_type")).cast("int"),
        # Never NULL, so rows without a test or call have a key as well.
        "_key": F.struct(*group), "_chunk": CHUNKS[grain](F.col("time_started"))})
    local = Window.partitionBy("_key", "_chunk").orderBy(*order)
    rows = rows.withColumn("_island", F.coalesce(
        F.sum("_ok").over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    island = Window.partitionBy("_key", "_chunk", "_island").orderBy(*order)
    rows = rows.withColumns({"_n": F.row_number().over(island),
                             "_prev": F.lag("time_end").over(island)})

    # What a chunk leaves to the next: the attempts since its last success and the last one's end.
    chunks = rows.groupBy("_key", "_chunk").agg(
        F.max("_ok").alias("_any"),
        F.max(F.struct("_island", "_n", "_ok", "time_end")).alias("_end"))
    left = F.when(F.col("_end._ok") == 1, 0).otherwise(F.col("_end._n"))
    across = Window.partitionBy("_key").orderBy("_chunk")
    runs = chunks.withColumn("_run", F.sum("_any").over(
        across.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_left", left)
    so_far = F.sum("_left").over(Window.partitionBy("_key", "_run").orderBy("_chunk")
                                 .rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("_open", so_far)
    carried = runs.select("_key", "_chunk", F.lag("_open").over(across).alias("_carry"),
                          F.lag("_end.time_end").over(across).alias("_before"))

    joined = rows.join(carried.filter("_carry > 0"), ["_key", "_chunk"], "left")
    first = F.col("_island") == 0
    place = F.col("_n") + F.when(first, F.coalesce("_carry", F.lit(0))).otherwise(0)
    attempt = (place - 1) % tries + 1
    previous = F.when(first & (F.col("_n") == 1), F.col("_before")).otherwise(F.col("_prev"))
    later = F.col("attempt") > 1
    return joined.withColumns({"attempt": attempt.cast("bigint"), "_previous": previous}).select(
        *group, "time_started", "time_end", "error_type", "attempt",
        F.when(later, elapsed_seconds(F.col("_previous"), F.col("time_started")))
        .alias("gap_seconds"),
        F.when(later, F.lit(float(delay)) * F.pow(F.lit(back_off), F.col("attempt") - 2))
        .alias("expected_gap"))


def effective_zone(zone: Column, label: Column) -> Column:
    """A label overrides the zone when given."""
    return F.coalesce(label, zone)


def io_throughput(samples: DataFrame, num_threads: int = 32) -> DataFrame:
    """Throughput per device and block size, up to and including the first size whose summed
    rate no longer exceeds the number of threads."""
    per_size = samples.groupBy("device", "blocksize").agg(F.sum("iops").alias("iops"))
    smaller = Window.partitionBy("device").orderBy("blocksize").rowsBetween(
        Window.unboundedPreceding, -1)
    going = F.min((F.col("iops") > num_threads).cast("int")).over(smaller)
    kept = per_size.withColumn("going", F.coalesce(going, F.lit(1))).filter(F.col("going") == 1)
    bandwidth = F.floor(F.col("blocksize") * F.col("iops")).cast("bigint")
    with_bits = kept.withColumn("bandwidth", bandwidth).withColumn("bits", F.col("bandwidth") * 8)
    return with_bits.select(
        "device", "blocksize", "iops", "bandwidth", "bits",
        humanize_units(F.col("blocksize")).alias("block_label"),
        humanize_units(F.col("bandwidth"), 1).alias("bandwidth_label"),
        humanize_units(F.col("bits"), 1, si=True).alias("bits_label"),
    )


def sample_actions(results: DataFrame, calls: list[str]) -> DataFrame:
    """Sample action rows for given tests: the calls in order, one to ten seconds each by a
    fixed rule instead of a random number, so that a rerun writes the same rows."""
    steps = results.select(
        "test_id", "time_started",
        F.posexplode(F.array(*[F.lit(c) for c in calls])).alias("step", "function_name"))
    seconds = ((F.col("test_id") * 31 + F.col("step") * 17) % 10 + 1).cast("int")
    return steps.select(
        "test_id", "step", "function_name", "time_started",
        F.timestamp_add("SECOND", seconds, F.col("time_started")).alias("time_end"),
        F.lit(3.0).alias("time_total"))
