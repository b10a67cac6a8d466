"""Coordinate transforms between longitude/latitude, curve grids and map tiles."""
from __future__ import annotations

import math
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import saturate

#: Latitude at which a Web-Mercator world is square.
MAX_LATITUDE = 85.05112877980659
EXTENT = 4096
BUFFER = 0.05


class Projection(Protocol):
    """A grid of 2^order cells a side; implementations give columns and plain Python values."""

    def to_grid(self, lon: Column, lat: Column, order: int) -> tuple[Column, Column]: ...

    def to_position(self, x: Column, y: Column, order: int) -> tuple[Column, Column]: ...

    def point(self, lon: float, lat: float, order: int) -> tuple[int, int]: ...


def wrap_longitude(lon: Column) -> Column:
    """Into [-180, 180] by truncated remainder; values inside stay as they are."""
    r = lon % F.lit(360.0)
    turned = F.when(r > 180, r - 360).when(r < -180, r + 360).otherwise(r)
    return F.when((lon >= -180) & (lon <= 180), lon).otherwise(turned)


def wrap_longitude_value(lon: float) -> float:
    if -180 <= lon <= 180:
        return lon
    r = math.fmod(lon, 360.0)
    return r - 360 if r > 180 else r + 360 if r < -180 else r


class Linear:
    """Equal steps of longitude and latitude; a cell is named by its lower left corner."""

    def to_grid(self, lon, lat, order):
        n = float((1 << order) - 1)
        return ((F.lit(180.0) + wrap_longitude(lon)) * n / 360.0).cast("long"), ((F.lit(90.0) + lat) * n / 180.0).cast("long")

    def to_position(self, x, y, order):
        n = (1 << order) - 1
        clamp = lambda v: F.greatest(F.least(v.cast("double"), F.lit(float(n))), F.lit(0.0))
        return clamp(x) / (n / 360.0) - 180.0, clamp(y) / (n / 180.0) - 90.0

    def point(self, lon, lat, order):
        n = (1 << order) - 1
        return int((180.0 + wrap_longitude_value(lon)) * n / 360.0), int((90.0 + lat) * n / 180.0)

    def position(self, x: int, y: int, order: int) -> tuple[float, float]:
        n = (1 << order) - 1
        return min(max(x, 0), n) / (n / 360.0) - 180.0, min(max(y, 0), n) / (n / 180.0) - 90.0


class WebMercator:
    """Square tiles of the spherical Mercator world, y counted from the south; positions are cell centres."""

    def to_grid(self, lon, lat, order):
        n = float(1 << order)
        bad = lon.isNull() | lat.isNull() | F.isnan(lon) | F.isnan(lat)
        phi = F.radians(F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE)))
        column = F.floor((wrap_longitude(lon) + 180.0) / 360.0 * n)
        row = F.floor((F.lit(1.0) - F.log(F.tan(phi) + F.lit(1.0) / F.cos(phi)) / math.pi) / 2.0 * n)
        clamp = lambda v: F.when(bad, F.raise_error(F.lit("coordinate is not a number")).cast("long")).otherwise(F.greatest(F.least(v, F.lit((1 << order) - 1)), F.lit(0)).cast("long"))
        return clamp(column), F.lit((1 << order) - 1) - clamp(row)

    def to_position(self, x, y, order):
        n = float(1 << order)
        v = F.lit(1.0) - (F.lit((1 << order) - 1) - y + 0.5) / n * 2.0
        return (x + 0.5) / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(v * math.pi)))

    def point(self, lon, lat, order):
        n, top = float(1 << order), (1 << order) - 1
        phi = math.radians(max(min(lat, MAX_LATITUDE), -MAX_LATITUDE))
        x = math.floor((wrap_longitude_value(lon) + 180.0) / 360.0 * n)
        y = math.floor((1.0 - math.log(math.tan(phi) + 1.0 / math.cos(phi)) / math.pi) / 2.0 * n)
        return max(min(x, top), 0), top - max(min(y, top), 0)


LINEAR, MERCATOR = Linear(), WebMercator()


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """XYZ column and row (row 0 in the north) of the tile that holds a point."""
    x, y = MERCATOR.to_grid(lon, lat, zoom)
    return x, F.lit((1 << zoom) - 1) - y


def _edge(y: Column, side: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - F.lit(2.0) * y / side))))


def tile_bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    """north, south, east, west of a tile in degrees."""
    side = F.pow(F.lit(2.0), z.cast("double"))
    return {"north": _edge(y, side), "south": _edge(y + 1, side), "east": (x + 1) / side * 360.0 - 180.0, "west": x / side * 360.0 - 180.0}


def pixel(lon: Column, lat: Column, z: Column, x: Column, y: Column, extent: int = EXTENT) -> tuple[Column, Column]:
    """Unrounded position inside tile z/x/y; the south pole has a null row (minus infinity)."""
    side = F.pow(F.lit(2.0), z.cast("double"))
    px = ((lon + 180.0) / 360.0 * side - x) * float(extent)
    merc = F.log(F.tan(F.radians(lat) / 2.0 + math.pi / 4))
    return px, ((F.lit(1.0) - merc / math.pi) / 2.0 * side - y) * float(extent)


def rounded_pixel(px: Column, py: Column) -> tuple[Column, Column]:
    return saturate(px), saturate(py)


def in_buffer(px: Column, py: Column, extent: int = EXTENT, buffer: float = BUFFER) -> Column:
    """Inside the tile or its buffer, borders included; not-a-number and null are outside."""
    lo, hi = -buffer * extent, extent + buffer * extent
    return F.coalesce(px.between(lo, hi) & py.between(lo, hi), F.lit(False))
