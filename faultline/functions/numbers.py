"""Averages without zeros, integer percents, unit suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (factor, suffix), largest first.
IEC_UNITS = [
    (2**50, "Pi"), (2**40, "Ti"), (2**30, "Gi"), (2**20, "Mi"), (2**10, "Ki"), (1, "  "),
]
SI_UNITS = [
    (10**15, "P"), (10**12, "T"), (10**9, "G"), (10**6, "M"), (10**3, "k"), (1, " "),
]


def nullif_zero(value: Column) -> Column:
    """0 stands for "never reached" and must not enter an average."""
    return F.nullif(value, F.lit(0))


def ratio(total: Column, count: Column) -> Column:
    """``total / count`` as double, NULL when nothing was counted."""
    return total.cast("double") / F.nullif(count, F.lit(0))


def int_percent(rate: Column) -> Column:
    """Truncated percent of a rate kept to four digits: 0.29 is 29, not 28."""
    return (rate.cast("decimal(14,4)") * 100).cast("int")


def half_up_div(n: Column, k: Column) -> Column:
    """``round(n / k)`` for whole numbers, exact."""
    return F.floor((n * 2 + k) / (k * 2)).cast("bigint")


def humanize_units(value: Column, precision: int = 0, si: bool = False) -> Column:
    """Value over the largest factor that fits, with its suffix."""
    units = SI_UNITS if si else IEC_UNITS

    def render(factor: int, suffix: str) -> Column:
        if precision == 0:
            return F.format_string(f"%3d {suffix}", F.floor(value / factor).cast("bigint"))
        scaled = F.bround(value.cast("double") / factor, precision)
        return F.format_string(f"%{4 + precision}.{precision}f {suffix}", scaled)

    chain = None
    for factor, suffix in units[:-1]:
        hit = value >= factor
        chain = (F.when(hit, render(factor, suffix)) if chain is None
                 else chain.when(hit, render(factor, suffix)))
    return chain.otherwise(render(*units[-1]))
