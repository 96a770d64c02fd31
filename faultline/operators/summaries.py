"""Small mergeable summaries of stored days: quantile sketches and key bitmaps.

Both are made once where rows are appended and merged on reading, so a report over any look-back
and a check of new rows scan no old log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.numbers import half_up_div
from faultline.functions.times import instant, interval

SKETCH_SIZE = 800
# With 99 % confidence a sketch of this size names a rank within this share of the rows; merging
# keeps the bound (2.296 / size^0.9723, as published for these sketches).
RANK_ERROR = 0.0035


# -- quantiles -----------------------------------------------------------------------------------

def duration_sketches(actions: DataFrame, keys: tuple[str, ...] = ("function_name",),
                      value: str = "time_total", size: int = SKETCH_SIZE) -> DataFrame:
    """One quantile sketch per day and ``keys``; rows without a value are left out. A day that is
    appended to in parts has a row for each, which merging adds up."""
    rows = actions.filter(F.col(value).isNotNull()).withColumn(
        "event_date", F.col("time_started").cast("date"))
    return rows.groupBy("event_date", *keys).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"),
        F.count("*").alias("n"))


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Append sketches below their days."""
    sketches.hint("rebalance", "event_date").write.mode("append").partitionBy(
        "event_date").parquet(path)


def sketched_percentiles(sketches: DataFrame, divisors: tuple[int, ...] = (2, 4, 20, 100),
                         keys: tuple[str, ...] = ("function_name",), as_of=None,
                         lookback: tuple[int, str] | None = None) -> DataFrame:
    """The duration near offset ``round(n / k)`` from the slowest, per group and divisor, of the
    whole days in the look-back. Its true offset is within ``RANK_ERROR`` of the rows."""
    if lookback is not None:
        first = (instant(as_of) - interval(*lookback)).cast("date")
        sketches = sketches.filter(F.col("event_date").between(first, instant(as_of).cast("date")))
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"),
                                         F.sum("n").alias("n"))
    # A k-th of the rows is slower than the one wanted, to half a row.
    at = [F.struct(F.lit(k).alias("divisor"), F.kll_sketch_get_quantile_double(
        "sketch", F.lit(1 - 1 / k)).alias("time_total")) for k in divisors]
    each = merged.select(*keys, "n", F.inline(F.array(*at)))
    offset = half_up_div(F.col("n"), F.col("divisor"))
    # A too short group has no row at the offset.
    return each.withColumn("row_offset", offset).filter("row_offset < n").select(
        *keys, "divisor", "row_offset", "n", "time_total")


# -- keys ----------------------------------------------------------------------------------------

def key_bitmaps(parent: DataFrame, key: str) -> DataFrame:
    """The set of a whole-numbered key as one bitmap per range of 32,768 keys. Appends add rows for
    their own keys; ``merged_bitmaps`` joins them."""
    rows = parent.filter(F.col(key).isNotNull()).select(
        F.bitmap_bucket_number(key).alias("bucket"), F.bitmap_bit_position(key).alias("place"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("keys"))


def merged_bitmaps(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("keys").alias("keys"))


def unknown_keys(child: DataFrame, key: str, bitmaps: DataFrame) -> DataFrame:
    """Keys of child rows that no bitmap holds, with the number of their rows. A key is counted
    where it is read and then tested against the bitmap of its range; no parent row is read."""
    counted = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    placed = counted.withColumns({"bucket": F.bitmap_bucket_number(key),
                                  "place": F.bitmap_bit_position(key).cast("int")})
    byte = F.conv(F.hex(F.substr("keys", F.shiftright("place", 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, F.col("place").bitwiseAND(7))
    return placed.join(merged_bitmaps(bitmaps), "bucket", "left").filter(
        F.coalesce(held, F.lit(0)) == 0).select(key, "n")


def orphan_counts_by_bitmap(checks: list[tuple[str, DataFrame, str, DataFrame]]) -> DataFrame:
    """Orphans per relation: (name, child, key of the child, bitmaps of the parent's keys)."""
    parts = [unknown_keys(child, key, bitmaps)
             .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
             .select(F.lit(name).alias("relation"), "orphans")
             for name, child, key, bitmaps in checks]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
