"""Integer helpers that stay inside bigint and never trip ANSI overflow."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


def long(x) -> Column:
    return F.lit(x).cast("long") if not isinstance(x, Column) else x.cast("long")


def truncate(value: Column) -> Column:
    """Toward zero, as long."""
    return value.cast("long")


def saturate(value: Column) -> Column:
    """Half-even rounding, clamped to 32 bits before the cast; null (ln 0) counts as minus infinity."""
    v = F.coalesce(F.rint(value), F.lit(float("-inf")))
    return F.least(F.greatest(v, F.lit(float(INT_MIN))), F.lit(float(INT_MAX))).cast("long")


def zigzag(value: Column) -> Column:
    """32-bit zigzag of a signed value, as an unsigned number in a long."""
    v = value.cast("long")
    return F.when(v >= 0, v * 2).otherwise(v * -2 - 1)


def unzigzag(value: Column) -> Column:
    v = value.cast("long")
    return F.when(v % 2 == 0, F.shiftright(v, 1)).otherwise(-F.shiftright(v, 1) - 1)


def interpolate(x: Column, stops: list[tuple[float, float]], base: float = 1.0) -> Column:
    """Value between ``stops`` (input, output): linear, or exponential with a ``base`` other than 1.

    Inputs outside the stops take the nearest output; null stays null.
    """
    if not stops or any(a[0] >= b[0] for a, b in zip(stops, stops[1:])):
        raise ValueError("stops must ascend")
    out = F.when(x <= stops[0][0], F.lit(float(stops[0][1])))
    for (x0, y0), (x1, y1) in zip(stops, stops[1:]):
        part = (x - x0) / (x1 - x0) if base == 1 else (F.pow(F.lit(float(base)), x - x0) - 1) / (base ** (x1 - x0) - 1)
        out = out.when(x <= x1, F.lit(float(y0)) + part * (y1 - y0))
    return out.when(x > stops[-1][0], F.lit(float(stops[-1][1])))
