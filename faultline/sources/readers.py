"""Table readers: parquet, catalog tables and JDBC, plus the text-definition source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str, days=(None, None),
               dated: bool = False) -> DataFrame:
    """A stored table with its declared schema; a missing path raises.

    The date partition is a column of the scan, so ``days`` prunes folders before any file is
    opened: (first day, last day), either may be None. ``dated`` keeps the date column, by which
    the reports prune days themselves.
    """
    first, last = days
    table = spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")
    if first is not None:
        table = table.filter(F.col("event_date") >= F.lit(first).cast("date"))
    if last is not None:
        table = table.filter(F.col("event_date") <= F.lit(last).cast("date"))
    names = TABLES[name].fieldNames()
    return table.select(*names, *(["event_date"] if dated else []))


def read_jdbc(spark: SparkSession, url: str, name: str, *, partition_column: str, lower, upper,
              partitions: int, properties: dict[str, str]) -> DataFrame:
    """A database table read by many tasks, split on a numeric or date column."""
    options = {
        "url": url, "dbtable": name, "partitionColumn": partition_column,
        "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions),
    }
    return spark.read.format("jdbc").options(**options, **properties).load()


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    return parse_definitions(spark.read.text(path))


# Fields of each definition type after the type itself.
DEFINITION_FIELDS = {
    "sysbench": ["ro_rw", "table_size", "tables_count", "threads", "run_seconds", "hosts",
                 "name_prefix"],
    "tpcc-mysql": ["warehouses", "threads", "run_seconds", "hosts", "name_prefix"],
}
# Fields a type does not carry read 0.
DEFINITION_DEFAULTS = {
    "sysbench": {"warehouses": "0"},
    "tpcc-mysql": {"table_size": "0", "tables_count": "0"},
}


def parse_definitions(lines: DataFrame) -> DataFrame:
    """Benchmark definitions from text lines.

    Comment and blank lines are dropped, short rows give NULL for the missing fields, and a
    row of an unknown type keeps its type with every field NULL.
    """
    parts = F.split(F.trim("value"), r"\s+")
    kind = F.get(parts, F.lit(0))

    def field(name: str):
        chain = None
        for type_name, names in DEFINITION_FIELDS.items():
            if name in names:
                value = F.get(parts, F.lit(1 + names.index(name)))
            else:
                value = F.lit(DEFINITION_DEFAULTS[type_name].get(name))
            chain = (F.when(kind == type_name, value) if chain is None
                     else chain.when(kind == type_name, value))
        return chain.alias(name)

    names = ["ro_rw", "table_size", "tables_count", "warehouses", "threads", "run_seconds",
             "hosts", "name_prefix"]
    kept = lines.filter(~F.col("value").rlike("^#|^$"))
    return kept.select(kind.alias("benchmark_type"), *[field(n) for n in names])


def expand_runs(definitions: DataFrame) -> DataFrame:
    """One row per thread count and host, with the composed run name."""
    known = definitions.filter(F.col("benchmark_type").isin(*DEFINITION_FIELDS))
    per_thread = known.withColumn("thread", F.explode(F.split("threads", "@")))
    per_run = per_thread.withColumn("db_host", F.explode(F.split("hosts", "@")))
    blank = {c: F.coalesce(c, F.lit("")) for c in
             ["name_prefix", "db_host", "ro_rw", "thread", "table_size", "tables_count",
              "run_seconds", "warehouses"]}
    sysbench = F.format_string(
        "%s_sysbench_%s_%s_th%s_ts%s_tc%s_time%s",
        *[blank[c] for c in ["name_prefix", "db_host", "ro_rw", "thread", "table_size",
                             "tables_count", "run_seconds"]])
    tpcc = F.format_string(
        "%s_tpcc_%s_w%s_th%s_time%s",
        *[blank[c] for c in ["name_prefix", "db_host", "warehouses", "thread", "run_seconds"]])
    name = F.when(F.col("benchmark_type") == "sysbench", sysbench).otherwise(tpcc)
    return per_run.select("benchmark_type", "db_host", "thread", "run_seconds",
                          name.alias("benchmark_name"))
