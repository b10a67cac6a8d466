"""Hilbert keys as native folds: order at most 30, so a key fits a bigint."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .projection import LINEAR

ORDERS = {"lowest": 4, "low": 10, "medium": 16, "high": 19, "highest": 30}
DEFAULT_ORDER = 19


def check_order(order: int) -> int:
    if not 1 <= order <= 30:
        raise ValueError("order must be 1 to 30")
    return order


def _bits(order: int, ascending: bool) -> Column:
    return F.sequence(F.lit(0), F.lit(order - 1)) if ascending else F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1))


def encode(x: Column, y: Column, order: int = DEFAULT_ORDER) -> Column:
    """Cell -> key: from the highest bit down, add the quadrant, then turn the lower bits."""
    top = (1 << check_order(order)) - 1
    zero = F.lit(0).cast("long")
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), zero.alias("d"))

    def step(s, i):
        side = F.expr("cast(1 as bigint)")
        rx = F.call_function("shiftright", s["x"], i).bitwiseAND(side)
        ry = F.call_function("shiftright", s["y"], i).bitwiseAND(side)
        quadrant = (rx * 3).bitwiseXOR(ry)
        d = s["d"] * 4 + quadrant
        flip = (ry == 0) & (rx == 1)
        fx = F.when(flip, F.lit(top) - s["x"]).otherwise(s["x"])
        fy = F.when(flip, F.lit(top) - s["y"]).otherwise(s["y"])
        swap = ry == 0
        return F.struct(F.when(swap, fy).otherwise(fx).alias("x"), F.when(swap, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(_bits(order, False), start, step, lambda s: s["d"])


def decode(hid: Column, order: int = DEFAULT_ORDER) -> Column:
    """Key -> struct<x, y>."""
    check_order(order)
    zero = F.lit(0).cast("long")
    one = F.expr("cast(1 as bigint)")
    start = F.struct(zero.alias("x"), zero.alias("y"), hid.cast("long").alias("d"))

    def step(s, i):
        side = F.call_function("shiftleft", one, i)
        rx = F.shiftright(s["d"], 1).bitwiseAND(one)
        ry = s["d"].bitwiseAND(one).bitwiseXOR(rx)
        flip = (ry == 0) & (rx == 1)
        fx = F.when(flip, side - 1 - s["x"]).otherwise(s["x"])
        fy = F.when(flip, side - 1 - s["y"]).otherwise(s["y"])
        swap = ry == 0
        nx = F.when(swap, fy).otherwise(fx) + rx * side
        ny = F.when(swap, fx).otherwise(fy) + ry * side
        return F.struct(nx.alias("x"), ny.alias("y"), F.shiftright(s["d"], 2).alias("d"))

    return F.aggregate(_bits(order, True), start, step, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))


def key_of(lon: Column, lat: Column, order: int = DEFAULT_ORDER, projection=LINEAR) -> Column:
    return encode(*projection.to_grid(lon, lat, check_order(order)), order)


def parent(hid: Column, levels: int) -> Column:
    """The key of the cell ``levels`` orders up."""
    return F.shiftright(hid, 2 * levels)


def encode_value(x: int, y: int, order: int) -> int:
    d, top = 0, (1 << check_order(order)) - 1
    for i in range(order - 1, -1, -1):
        rx, ry = x >> i & 1, y >> i & 1
        d = d * 4 + ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = top - x, top - y
            x, y = y, x
    return d


def decode_value(d: int, order: int) -> tuple[int, int]:
    x = y = 0
    for i in range(check_order(order)):
        rx = d >> 1 & 1
        ry = d & 1 ^ rx
        if not ry:
            if rx:
                x, y = (1 << i) - 1 - x, (1 << i) - 1 - y
            x, y = y, x
        x, y, d = x + (rx << i), y + (ry << i), d >> 2
    return x, y
