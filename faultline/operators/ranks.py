"""Exact ranks and ordered numbering without a global or unbounded window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.numbers import half_up_div
from faultline.functions.times import minute_start


def percentile_rows(actions: DataFrame, divisors: tuple[int, ...] = (2, 4, 20, 100),
                    keys: tuple[str, ...] = ("function_name",),
                    value: str = "time_total") -> DataFrame:
    """Exact duration at offset ``round(n / k)`` from the slowest, per group and divisor.

    Durations are first counted per value. A cumulative count over whole seconds finds the
    second that holds the wanted rank, and only the values inside that second are ranked. The
    windows therefore run over at most one row per second of the time limit, and over the
    distinct values of one second, however many actions a group has. A group that is too
    short for an offset yields no row.
    """
    counts = actions.groupBy(F.struct(*keys).alias("grp"), F.col(value).alias("v")).agg(
        F.count("*").alias("n"))
    # One struct as join key: it is never NULL, so both uses of the counts share one shuffle.
    counts = counts.withColumn("bin", F.struct("grp", F.floor("v").cast("bigint").alias("sec")))

    bins = counts.groupBy("bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("bin.grp")
    slower = group.orderBy(F.col("bin.sec").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = bins.select(
        "bin", "n", F.coalesce(F.sum("n").over(slower), F.lit(0)).alias("before"),
        F.sum("n").over(group).alias("total"),
    ).withColumn("k", F.explode(F.array(*[F.lit(k) for k in divisors])))
    picks = ranked.withColumn("row_offset", half_up_div(F.col("total"), F.col("k"))).filter(
        (F.col("before") <= F.col("row_offset"))
        & (F.col("row_offset") < F.col("before") + F.col("n"))
    ).select("bin", "k", "row_offset", (F.col("row_offset") - F.col("before")).alias("inside"))

    within = counts.join(picks, "bin")
    w = Window.partitionBy("grp", "k").orderBy(F.col("v").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    found = within.withColumn("skipped", F.coalesce(F.sum("n").over(w), F.lit(0))).filter(
        (F.col("skipped") <= F.col("inside"))
        & (F.col("inside") < F.col("skipped") + F.col("n")))
    return found.select(*[F.col(f"grp.{c}").alias(c) for c in keys],
                        F.col("k").alias("divisor"), "row_offset", F.col("v").alias(value))


def percentile_offsets(actions: DataFrame, function: str,
                       divisors: tuple[int, ...] = (2, 4, 20, 100)) -> DataFrame:
    """The row offsets alone, as one row: ``round(count / k)`` for each divisor."""
    n = F.count("*")
    return actions.filter(F.col("function_name") == function).agg(
        n.alias("calls"),
        *[half_up_div(n, F.lit(k)).alias(f"offset_{k}") for k in divisors])


def row_at_offset(actions: DataFrame, function: str, offset: int) -> DataFrame:
    """The duration at a fixed offset from the slowest."""
    return (actions.filter(F.col("function_name") == function).select("time_total")
            .orderBy(F.col("time_total").desc()).offset(offset).limit(1))


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of an order."""
    return df.orderBy(*order).limit(n)


def number_in_order(df: DataFrame, *, group: list[str], chunk: Column, order: list[str],
                    carry: str | None = None) -> DataFrame:
    """Add ``row_no`` per group in ``order`` and, if asked, ``previous``: the ``carry`` value
    of the row before.

    ``chunk`` must not decrease along the order. Rows are numbered inside (group, chunk), so a
    group that owns a large part of the rows is spread over its chunks; choose chunks that fit
    a task. Only groups that span chunks need more: their chunk totals give each later chunk
    its offset and the last row before it.
    """
    # Group columns may be NULL; a filled value and a flag join where NULL would not.
    keyed, keys = df, []
    for i, column in enumerate(group):
        kind = df.schema[column].dataType
        filler = F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind)
        keyed = keyed.withColumns({f"_null{i}": F.col(column).isNull(),
                                   f"_key{i}": F.coalesce(F.col(column), filler)})
        keys += [f"_null{i}", f"_key{i}"]
    keyed = keyed.withColumn("_chunk", chunk).drop(*group)
    inside = [*keys, "_chunk"]

    local = Window.partitionBy(*inside).orderBy(*order)
    rows = keyed.withColumn("_n", F.row_number().over(local))
    if carry:
        rows = rows.withColumn("_prev", F.lag(carry).over(local))
        last = rows.withColumn("_next", F.lead(F.lit(1)).over(local)).filter("_next IS NULL")
        chunks = last.select(*inside, F.col("_n").alias("_size"), F.col(carry).alias("_last"))
    else:
        chunks = keyed.groupBy(*inside).agg(F.count("*").alias("_size"))

    across = Window.partitionBy(*keys).orderBy("_chunk")
    before = F.sum("_size").over(across.rowsBetween(Window.unboundedPreceding, -1))
    heads = [before.alias("_before")]
    if carry:
        heads.append(F.lag("_last").over(across).alias("_carried"))
    later = chunks.select(*inside, *heads).filter("_before IS NOT NULL")

    joined = rows.join(later, inside, "left")
    added = [(F.col("_n") + F.coalesce("_before", F.lit(0))).alias("row_no")]
    if carry:
        added.append(F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_prev"))
                     .alias("previous"))
    restored = {c: F.when(~F.col(f"_null{i}"), F.col(f"_key{i}")) for i, c in enumerate(group)}
    return joined.select(*[restored.get(c, F.col(c)).alias(c) for c in df.columns], *added)


def assign_ids(df: DataFrame, *, id_name: str, time: str, order: list[str],
               existing: DataFrame | None = None, start: int = 0) -> DataFrame:
    """Dense ids in natural-key order, which begins with ``time``, continuing after the largest
    id of ``existing`` or else after ``start``.

    Rows are numbered inside a minute, minutes get their offset inside a month, and the months
    are so few that their totals travel as one array: no window runs over the whole table.
    """
    month = F.coalesce(F.trunc(F.col(time).cast("date"), "month"), F.lit("0001-01-01").cast("date"))
    keyed = df.withColumns({"_month": month, "_minute": F.coalesce(
        minute_start(F.col(time)), F.lit("0001-01-01").cast("timestamp_ntz"))})
    totals = keyed.groupBy("_month", "_minute").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy("_month").orderBy("_minute").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select("_month", "_minute",
                            F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    months = totals.groupBy("_month").agg(F.sum("_size").alias("_size")).agg(
        F.collect_list(F.struct("_month", "_size"))).scalar()
    begin = F.lit(start).cast("bigint") if existing is None else F.coalesce(
        existing.agg(F.max(id_name).cast("bigint")).scalar(), F.lit(0))
    inside = Window.partitionBy("_month", "_minute").orderBy(*order)
    numbered = (keyed.join(offsets, ["_month", "_minute"])
                .withColumn("_n", F.row_number().over(inside))
                .withColumns({"_months": months, "_start": begin}))
    before = F.aggregate(F.filter("_months", lambda m: m["_month"] < F.col("_month")),
                         F.lit(0).cast("bigint"), lambda n, m: n + m["_size"])
    return numbered.select((F.col("_start") + before + F.col("_before") + F.col("_n"))
                           .cast("bigint").alias(id_name), *df.columns)
