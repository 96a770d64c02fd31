"""Helpers shared by the text operators: tables, checkpoints, numbering, byte blocks."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_CELL = 5_000
BLOCK_BYTES = 1 << 20
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a session on one machine may go without
    the setting; it then gets a folder below its warehouse."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
        folder = os.path.join(warehouse, f"checkpoints-{uuid.uuid4().hex}")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, so that a lost executor costs no rerun of
    what produced them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files and written tables that nothing refers to any more. It
    finds them when the driver's garbage is collected, which otherwise may not happen during a
    whole query; the disk would hold the files of all its steps at once."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table marked for broadcast if its rows, at ``row_bytes`` each, stay below
    ``BROADCAST_BYTES``; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def number_within(df: DataFrame, group: str, order: list[str], name: str, rows: int) -> DataFrame:
    """``df`` with ``name``: the row's place from 0, without gaps, inside its group.

    Rows are numbered inside hashed cells of about ``ROWS_PER_CELL`` rows and moved up by the
    rows of the cells before, so no group is sorted in one task, however large.
    """
    cells = -(-rows // ROWS_PER_CELL) + 16
    cut_up = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (cut_up.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
              .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
              .drop("_rows"))
    inside = Window.partitionBy(group, "_cell").orderBy(*order)
    return (cut_up.join(starts, [group, "_cell"])
            .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
            .drop("_cell", "_start"))


def finite_vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id and x, floor(scale * c) of every component c as a double, for the vectors that are
    not NULL and hold no NULL or non-finite component. Whole numbers end at 2^52."""
    c = F.col("embedding").cast("array<double>")
    good = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    end = F.lit(float(1 << 52))
    whole = lambda v: F.floor(F.greatest(-end, F.least(v * scale, end)))
    return (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("embedding"))
            .filter(F.col("embedding").isNotNull() & good)
            .select("vec_id", F.transform("embedding", whole).alias("x")))


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays of ``width`` whole numbers as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_blocks(column: pa.Array, limit: int = BLOCK_BYTES
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with their UTF-8 bytes: (first row, end row, bytes, offsets from 0).

    A run holds ``limit`` bytes at most, or one longer text. NULL reads as an empty text.
    """
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield (first, end, data[offsets[first]:offsets[end]],
               offsets[first:end + 1] - offsets[first])
        first = end


# -- words -----------------------------------------------------------------------------------

_U = np.uint64
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_VALUES[ord("A"):ord("Z") + 1] = _VALUES[ord("a"):ord("z") + 1]
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = np.full(max(n, BLOCK_BYTES + 1), _BASE if kind == "up" else _BASE_INVERSE, np.uint64)
        base[0] = 1
        _powers[kind] = np.cumprod(base)
    return _powers[kind][:n]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of bytes that are not ASCII white space."""
    n = len(data)
    spaces = _SPACES[data]
    after_break = np.ones(n + 1, bool)
    after_break[1:] = np.append(spaces[:-1], True) if n else True
    after_break[offsets] = True
    before_break = np.ones(n + 1, bool)
    before_break[:-1] = np.append(spaces[1:], True) if n else True
    before_break[offsets[offsets > 0] - 1] = True
    starts = np.flatnonzero(~spaces & after_break[:n])
    ends = np.flatnonzero(~spaces & before_break[:n]) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z read as a-z."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _power("up", len(data)), out=sums[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts] + length)
