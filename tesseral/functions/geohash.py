"""Geohash strings by closed form: floor the two axes to cells, interleave their bits."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
#: Zoom below which a precision holds.
PRECISION_BELOW = ((4, 1), (7, 2), (9, 3), (12, 4), (14, 5), (17, 6))


def _sides(precision: int) -> tuple[int, int]:
    """Bits of longitude and latitude."""
    bits = 5 * precision
    return (bits + 1) // 2, bits // 2


def check_precision(precision: int) -> int:
    if not 1 <= precision <= 12:
        raise ValueError("precision must be 1 to 12")
    return precision


def cells(lon: Column, lat: Column, precision: int) -> tuple[Column, Column]:
    """Cell column (from the west) and row (from the south); the far edges belong to the last cell."""
    lb, hb = _sides(check_precision(precision))
    cut = lambda v, bits: F.greatest(F.least(F.floor(v), F.lit((1 << bits) - 1)), F.lit(0)).cast("long")
    return cut((lon + 180.0) / 360.0 * float(1 << lb), lb), cut((lat + 90.0) / 180.0 * float(1 << hb), hb)


def name(column: Column, row: Column, precision: int) -> Column:
    """The string of a cell: each letter takes five bits, longitude first."""
    lb, hb = _sides(check_precision(precision))
    letters = []
    for i in range(precision):
        value = F.lit(0).cast("long")
        for j in range(5):
            k = 5 * i + j
            axis, bits = (column, lb) if k % 2 == 0 else (row, hb)
            value = value * 2 + F.shiftright(axis, bits - 1 - k // 2).bitwiseAND(F.expr("cast(1 as bigint)"))
        letters.append(F.substring(F.lit(ALPHABET), value.cast("int") + 1, F.lit(1)))
    return F.concat(*letters)


def encode(lon: Column, lat: Column, precision: int) -> Column:
    return name(*cells(lon, lat, precision), precision)


def decode(text: Column) -> Column:
    """struct<south, north, west, east>; a character outside the alphabet is an error."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("a"), zero.alias("b"), zero.alias("k"))

    def letter(s, c):
        at = F.instr(F.lit(ALPHABET), c).cast("long") - 1
        v = F.when((at < 0) | (F.length(c) != 1), F.raise_error(F.lit("not a geohash")).cast("long")).otherwise(at)
        bit = lambda i: F.shiftright(v, i).bitwiseAND(F.expr("cast(1 as bigint)"))
        odd, even = bit(4) * 4 + bit(2) * 2 + bit(0), bit(3) * 2 + bit(1)
        lon_first = s["k"] % 2 == 0
        return F.struct(F.when(lon_first, s["a"] * 8 + odd).otherwise(s["a"] * 4 + even).alias("a"), F.when(lon_first, s["b"] * 4 + even).otherwise(s["b"] * 8 + odd).alias("b"), (s["k"] + 1).alias("k"))

    def done(s):
        lon_cells = F.pow(F.lit(2.0), F.floor((s["k"] * 5 + 1) / 2))
        lat_cells = F.pow(F.lit(2.0), F.floor(s["k"] * 5 / 2))
        return F.struct((s["b"] / lat_cells * 180.0 - 90.0).alias("south"), ((s["b"] + 1) / lat_cells * 180.0 - 90.0).alias("north"), (s["a"] / lon_cells * 360.0 - 180.0).alias("west"), ((s["a"] + 1) / lon_cells * 360.0 - 180.0).alias("east"))

    return F.aggregate(F.split(text, "(?!^)(?!$)"), start, letter, done)


def precision_for(zoom: Column) -> Column:
    out = F
    for below, p in PRECISION_BELOW:
        out = out.when(zoom < below, F.lit(p))
    return out.otherwise(F.lit(7))


def precision_value(zoom: int) -> int:
    return next((p for below, p in PRECISION_BELOW if zoom < below), 7)


def covering(south: Column, north: Column, west: Column, east: Column, precision: int) -> Column:
    """Cells from the one of the south-west corner to those that touch the far borders, row by row from the south."""
    check_precision(precision)
    c1, r1 = cells(west, south, precision)
    c2, r2 = cells(east, north, precision)
    rows = F.transform(F.sequence(r1, r2), lambda r: F.transform(F.sequence(c1, c2), lambda c: name(c, r, precision)))
    return F.flatten(rows)
