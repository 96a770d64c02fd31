"""Files laid out by several columns at once, so that a lookup by any of them opens few row groups.

Each column is cut into ranges of equally many rows; the numbers of a row's ranges are interleaved
bit by bit and rows are stored in that order. A row group then spans a short range of every column,
and the scan skips by the minima and maxima in the file footers. Parquet filters of Spark do not
reach times without zone, so these get a whole-number column of microseconds beside them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.times import micros

MICROS = "_us"
EPOCH = dt.datetime(1970, 1, 1)


def rank_among(value: Column, cuts: list[int]) -> Column:
    """How many of the rising ``cuts`` are at most the value, by halving; NULL counts as 0.

    There are 2^b - 1 cuts; none at all gives 0.
    """
    if not cuts:
        return F.lit(0)
    marks = F.array(*[F.lit(c).cast("bigint") for c in cuts])
    steps, half = [], (len(cuts) + 1) // 2
    while half:
        steps.append(F.lit(half))
        half //= 2
    return F.aggregate(F.array(*steps), F.lit(0), lambda found, step: F.when(
        value >= F.get(marks, found + step - 1), found + step).otherwise(found))


def interleaved(ranks: list[Column], bits: int) -> Column:
    """The bits of the ranks in turn, highest first, as one number."""
    key = F.lit(0).cast("bigint")
    for j, rank in enumerate(ranks):
        for i in range(bits):
            bit = F.shiftright(rank, i).bitwiseAND(F.lit(1)).cast("bigint")
            key = key.bitwiseOR(F.shiftleft(bit, i * len(ranks) + len(ranks) - 1 - j))
    return key


def append_clustered(df: DataFrame, path: str, columns: list[str], bits: int = 8,
                     rows_per_file: int = 1 << 22) -> None:
    """Append rows as files clustered by ``columns``, whole numbers or times without zone.

    One pass counts the rows and finds 2^bits - 1 cuts a column (approximate percentiles, so a value
    held by a third of the rows takes a third of the ranges and is divided by the other columns);
    one range exchange writes. Rows equal in all columns stay together. Every append is clustered
    by itself; an empty one writes no rows.
    """
    times = [c for c, kind in df.dtypes if c in columns and kind == "timestamp_ntz"]
    df = df.withColumns({c + MICROS: micros(F.col(c)) for c in times})
    stored = [c + MICROS if c in times else c for c in columns]
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(F.count("*").alias("_rows"), *[
        F.percentile_approx(F.col(c).cast("bigint"), shares).alias(c) for c in stored]).first()
    files = max(1, -(-found["_rows"] // rows_per_file))
    ranked = df.withColumns({f"_rank_{c}": rank_among(F.col(c), found[c]) for c in stored})
    keyed = ranked.withColumn("_key", interleaved([F.col(f"_rank_{c}") for c in stored], bits))
    (keyed.repartitionByRange(files, "_key", *stored).sortWithinPartitions("_key", *stored)
     .drop("_key", *[f"_rank_{c}" for c in stored]).write.mode("append").parquet(path))


def read_clustered(spark: SparkSession, path: str, **ranges) -> DataFrame:
    """Rows whose columns lie within ``ranges``: ``column=(first, last)``, both ends included,
    None for no bound. Bounds of times are datetimes or ISO texts."""
    table = spark.read.parquet(path)
    for name, bounds in ranges.items():
        stored = name + MICROS if name + MICROS in table.columns else name
        first, last = (_stored(b) if stored != name else b for b in bounds)
        if first is not None:
            table = table.filter(F.col(stored) >= F.lit(first))
        if last is not None:
            table = table.filter(F.col(stored) <= F.lit(last))
    return table.drop(*[c for c in table.columns if c.endswith(MICROS)
                        and c.removesuffix(MICROS) in table.columns])


def _stored(bound: dt.datetime | str | None) -> int | None:
    if isinstance(bound, str):
        bound = dt.datetime.fromisoformat(bound)
    return None if bound is None else (bound - EPOCH) // dt.timedelta(microseconds=1)
