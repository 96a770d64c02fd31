"""Request and failure rates over event-time windows of a stream.

Every batch is first counted per test or pass and window, so a busy one is a few rows per task,
and then joined with the attributes as they are stored at that moment. Counts whose test or pass is
not stored yet wait, by key, and are tried again with every batch and on reading; so rows count
however late they or their attributes arrive, and in however many files.

A batch writes its joined counts once, split by whether the key is known, sums the known ones and
adds them to the list of folders that make up the result; when the list grows long, it is summed
into one folder. Its last step is a numbered manifest: the list and the folder of waiting counts. A
batch that runs again begins at the manifest before it. Folders that neither the newest manifest nor
the one before it names are removed, so their number stays bounded over any number of batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.numbers import ratio
from faultline.sources.files import Folder
from faultline.streaming.sinks import StreamRun, settings_of

# So many folders of counts are summed into one.
COMPACT = 10
# Rows of a batch that one task counts, and bytes of counts that one task reads.
TASK_ROWS = 500_000
TASK_BYTES = "16MB"
# Attributes change while a stream runs: a function reads them anew for every batch.
Attributes = DataFrame | Callable[[], DataFrame]


def _now(attributes: Attributes, columns: list[str]) -> DataFrame:
    return (attributes if isinstance(attributes, DataFrame) else attributes()).select(*columns)


@contextmanager
def small_tasks(batch: DataFrame, columns: list[str]) -> Iterator[DataFrame]:
    """The columns of a batch, spread evenly over tasks of ``TASK_ROWS`` rows; meanwhile its session
    has shuffles and scans of tasks alike."""
    spark, tasks = batch.sparkSession, -(-batch.count() // TASK_ROWS)
    key = "spark.sql.shuffle.partitions"
    # Some counts a row, and those that wait from earlier batches; small ones are merged.
    with settings_of(spark, {key: str(max(int(spark.conf.get(key)), 4 * tasks)),
                             "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES,
                             "spark.sql.files.maxPartitionBytes": TASK_BYTES}):
        rows = batch.select(*columns)
        yield rows.repartition(tasks, F.monotonically_increasing_id()) if tasks > 1 else rows


def _counts_schema(keys: list[str], sums: list[str]) -> str:
    return ", ".join(["window_start timestamp_ntz", *[f"{k} string" for k in keys],
                      *[f"{s} bigint" for s in sums]])


def _waiting_schema(key: str, sums: list[str]) -> str:
    return ", ".join([f"{key} bigint", "window_start timestamp_ntz", *[f"{s} bigint" for s in sums]])


def _sum(df: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(s).alias(s) for s in sums])


def _joined(counts: DataFrame, attributes: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """Counts with their attributes; ``known`` tells whether the key is stored."""
    marked = attributes.withColumn("known", F.lit(1))
    return counts.join(marked, key, "left").withColumn("known", F.coalesce("known", F.lit(0)))


def _run_counts(stream: DataFrame, attributes: Attributes, run: StreamRun, *, key: str,
                window, sums: dict, keys: list[str], measures: tuple[str, ...] = ()) -> None:
    names = list(sums)

    def store(batch: DataFrame, batch_id: int) -> None:
        with small_tasks(batch, [key, "time_started", *measures]) as rows:
            count(rows, batch_id)

    def count(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        manifests = Folder(spark, f"{run.root}/manifest")
        earlier = [n for n in manifests.numbers() if n < batch_id]
        state = manifests.read(earlier[-1]) if earlier else {"counts": [], "waiting": None}
        counted = batch.groupBy(key, F.window("time_started", *window).alias("w")).agg(
            *[c.alias(name) for name, c in sums.items()]).select(
            key, F.col("w.start").cast("timestamp_ntz").alias("window_start"), *names)
        if state["waiting"]:
            counted = counted.unionByName(spark.read.schema(_waiting_schema(key, names)).parquet(
                f"{run.data}/{state['waiting']}"))
        joined = _joined(_sum(counted, [key, "window_start"], names),
                         _now(attributes, [key, *keys]), key, keys)
        folder = f"batch-{batch_id}"
        # Written once, so a row is in exactly one of the two parts even if attributes change now.
        (joined.write.mode("overwrite").partitionBy("known").parquet(f"{run.data}/{folder}"))
        parts = manifests.folders(f"{run.data}/{folder}")
        counts, live = _counts_schema(keys, names), list(state["counts"])
        if "known=1" in parts:
            live.append(f"counts-{batch_id}")
            fresh = _sum(spark.read.schema(counts).parquet(f"{run.data}/{folder}/known=1"),
                         ["window_start", *keys], names)
            if len(live) > COMPACT:
                old = [f"{run.data}/{f}" for f in live[:-1]]
                fresh = _sum(fresh.unionByName(spark.read.schema(counts).parquet(*old)),
                             ["window_start", *keys], names)
                live = live[-1:]
            fresh.write.mode("overwrite").parquet(f"{run.data}/counts-{batch_id}")
        waiting = f"{folder}/known=0" if "known=0" in parts else None
        manifests.write(batch_id, {"counts": live, "waiting": waiting}, replace=True)
        sweep(manifests, run, _folders)

    (stream.writeStream.foreachBatch(store).option("checkpointLocation", run.checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def _folders(state: dict) -> set[str]:
    waiting = {state["waiting"].split("/")[0]} if state["waiting"] else set()
    return waiting.union(state["counts"])


def sweep(manifests: Folder, run: StreamRun, folders: Callable[[dict], set[str]]) -> None:
    """Remove what the two newest manifests do not name; ``folders`` tells what one names."""
    numbers = manifests.numbers()
    used: set[str] = set()
    for number in numbers[-2:]:
        used |= folders(manifests.read(number))
    for number in numbers[:-2]:
        manifests.remove(number)
    for folder in manifests.folders(run.data):
        if folder not in used:
            manifests.delete_folder(f"{run.data}/{folder}")


def _summed(spark: SparkSession, run: StreamRun, key: str, keys: list[str], sums: list[str],
            attributes: Attributes | None) -> DataFrame:
    manifests = Folder(spark, f"{run.root}/manifest")
    numbers = manifests.numbers()
    state = manifests.read(numbers[-1]) if numbers else {"counts": [], "waiting": None}
    counts = _counts_schema(keys, sums)
    stored = (spark.read.schema(counts).parquet(*[f"{run.data}/{f}" for f in state["counts"]])
              if state["counts"] else spark.createDataFrame([], counts))
    if attributes is not None and state["waiting"]:
        waiting = spark.read.schema(_waiting_schema(key, sums)).parquet(
            f"{run.data}/{state['waiting']}")
        found = waiting.join(_now(attributes, [key, *keys]), key)
        stored = stored.unionByName(found.select("window_start", *keys, *sums))
    return _sum(stored, ["window_start", *keys], sums)


def waiting_counts(spark: SparkSession, run: StreamRun, key: str, sums: list[str]) -> DataFrame:
    """Counts whose test or pass was not stored when the newest batch ran."""
    manifests = Folder(spark, f"{run.root}/manifest")
    numbers = manifests.numbers()
    waiting = manifests.read(numbers[-1])["waiting"] if numbers else None
    schema = _waiting_schema(key, sums)
    return (spark.read.schema(schema).parquet(f"{run.data}/{waiting}") if waiting
            else spark.createDataFrame([], schema))


def run_request_counts(actions: DataFrame, tests: Attributes, run: StreamRun, *,
                       window: str = "60 seconds", slide: str = "10 seconds") -> None:
    """Store the requests per environment and sliding window; ``tests`` has test_id and
    environ_name."""
    _run_counts(actions, tests, run, key="test_id", window=(window, slide),
                sums={"requests": F.count("*")}, keys=["environ_name"])


def request_rates(spark: SparkSession, run: StreamRun, seconds: int = 60,
                  tests: Attributes | None = None) -> DataFrame:
    """Requests and requests per second per environment and window of ``seconds``; with ``tests``
    also those whose test has been stored since the newest batch."""
    counted = _summed(spark, run, "test_id", ["environ_name"], ["requests"], tests)
    return counted.withColumn("rps", F.col("requests") / F.lit(seconds))


def run_failure_counts(results: DataFrame, passes: Attributes, run: StreamRun, *,
                       window: str = "1 hour") -> None:
    """Store tests and failures per environment, zone and tumbling window of the test start."""
    _run_counts(results, passes, run, key="test_pass_id", window=(window,),
                keys=["environ_name", "zone"], measures=("hard_errors_exist",), sums={
                    "total_tests": F.count("*"), "total_failures": F.sum("hard_errors_exist")})


def failure_rates(spark: SparkSession, run: StreamRun, passes: Attributes | None = None
                  ) -> DataFrame:
    """Tests, failures and failure rate per environment, zone and window; with ``passes`` also of
    tests whose pass has been stored since the newest batch."""
    counted = _summed(spark, run, "test_pass_id", ["environ_name", "zone"],
                      ["total_tests", "total_failures"], passes)
    return counted.withColumn("failure_rate", ratio(F.col("total_failures"), F.col("total_tests")))
