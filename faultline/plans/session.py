"""Session settings for a cluster and for local runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution chooses join strategies from measured sizes, splits skewed partitions and
# merges small ones. RocksDB keeps stream state off the heap. The web page stays off.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_settings(executor_cores: int, input_bytes: int) -> dict[str, str]:
    """Settings sized to the input: shuffle partitions of about 200 MB of it, at least two
    waves of tasks; adaptive execution merges what turns out small."""
    partitions = max(2 * executor_cores, -(-input_bytes // (200 * 1024**2)))
    return {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
        "spark.sql.files.maxPartitionBytes": "256MB",
        # Recent passes cut down the scan of the tests through a Bloom filter of bounded size,
        # so their full history is not shuffled for a report over a few days.
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
    }


def local_session(cores: str = "8", name: str = "faultline", **settings: str) -> SparkSession:
    """A session on this machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    options = {**SETTINGS, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
               **settings}
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
