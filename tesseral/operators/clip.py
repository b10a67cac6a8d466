"""Clipping and command encoding of whole columns of lines and rings, in numpy over flat vertex arrays.

A batch is one array of vertices with offsets of parts and features; no step loops over vertices.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import INT_MAX, INT_MIN
from ..functions.projection import BUFFER, EXTENT
from .geometry import SNAP

PARTS = "array<array<struct<x:int,y:int>>>"


def rounded(v: np.ndarray) -> np.ndarray:
    """Half-even, saturated to 32 bits; not-a-number is the smallest."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isnan(v), INT_MIN, np.clip(np.rint(v), INT_MIN, INT_MAX)).astype(np.int64)


def project(lon, lat, z, x, y, extent: int = EXTENT) -> tuple[np.ndarray, np.ndarray]:
    """Unrounded pixels of positions in their tiles."""
    side = np.exp2(np.asarray(z, float))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.tan(math.pi / 4 + np.radians(lat) / 2)
        m = np.where(t > 0, np.log(np.where(t > 0, t, 1.0)), -np.inf)
    return ((lon + 180.0) / 360.0 * side - x) * extent, ((1.0 - m / math.pi) / 2.0 * side - y) * extent


def _bounds(extent: int, buffer: float) -> tuple[float, float]:
    return -buffer * extent, extent + buffer * extent


def _snapped(v: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Cuts that miss a border by rounding are on it: else a corner can be cut for ever."""
    v = np.where(np.abs(v - lo) < SNAP, lo, v)
    return np.where(np.abs(v - hi) < SNAP, hi, v)


def _offsets(count: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(count)))


def clip_lines(px: np.ndarray, py: np.ndarray, off: np.ndarray, extent: int = EXTENT, buffer: float = BUFFER):
    """(x, y, part offsets, line offsets over parts): the visible parts of lines on rounded vertices.

    A part ends at a segment that is not visible and where a segment does not begin at its last vertex;
    steps of length zero add no vertex; parts of fewer than two vertices vanish.
    """
    lo, hi = _bounds(extent, buffer)
    n = np.diff(off)
    line = np.repeat(np.arange(len(n)), np.maximum(n - 1, 0))
    i = np.arange(len(line)) + np.repeat(off[:-1] - _offsets(np.maximum(n - 1, 0))[:-1], np.maximum(n - 1, 0))
    x0, y0, x1, y1 = (a.astype(float) for a in (px[i], py[i], px[i + 1], py[i + 1]))
    code = lambda x, y: (x < lo).astype(np.int8) | (x > hi).astype(np.int8) << 1 | (y < lo).astype(np.int8) << 2 | (y > hi).astype(np.int8) << 3
    c0, c1 = code(x0, y0), code(x1, y1)
    p = np.flatnonzero(((c0 | c1) != 0) & ((c0 & c1) == 0))
    while len(p):
        first = c0[p] != 0
        c = np.where(first, c0[p], c1[p])
        rows = (c & 12) != 0
        edge = np.where(rows, np.where(c & 8, hi, lo), np.where(c & 2, hi, lo))
        dx, dy = x1[p] - x0[p], y1[p] - y0[p]
        with np.errstate(divide="ignore", invalid="ignore"):
            x, y = np.where(rows, x0[p] + dx * (edge - y0[p]) / dy, edge), np.where(rows, edge, y0[p] + dy * (edge - x0[p]) / dx)
        x, y = (_snapped(v, lo, hi) for v in (x, y))
        new = code(x, y)
        a, b = p[first], p[~first]
        x0[a], y0[a], c0[a] = x[first], y[first], new[first]
        x1[b], y1[b], c1[b] = x[~first], y[~first], new[~first]
        p = p[((c0[p] | c1[p]) != 0) & ((c0[p] & c1[p]) == 0)]
    seen = (c0 | c1) == 0
    ax, ay, bx, by = map(rounded, (x0, y0, x1, y1))
    follows = np.zeros(len(line), bool)
    follows[1:] = seen[1:] & seen[:-1] & (line[1:] == line[:-1]) & (bx[:-1] == ax[1:]) & (by[:-1] == ay[1:])
    begins, steps = seen & ~follows, seen & ((ax != bx) | (ay != by))
    at = _offsets(begins.astype(np.int64) + steps)
    x, y = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
    a, b = np.flatnonzero(begins), np.flatnonzero(steps)
    x[at[a]], y[at[a]] = ax[a], ay[a]
    x[at[b] + begins[b]], y[at[b] + begins[b]] = bx[b], by[b]
    size = np.diff(np.append(at[a], at[-1]))
    keep = size >= 2
    stay = np.repeat(keep, size)
    return x[stay], y[stay], _offsets(size[keep]), _offsets(np.bincount(line[a][keep], minlength=len(n)))


def clip_rings(px: np.ndarray, py: np.ndarray, off: np.ndarray, extent: int = EXTENT, buffer: float = BUFFER):
    """(x, y, ring offsets): rings on rounded vertices cut by the left, right, lower and upper half plane in
    doubles and rounded once at the end; equal neighbours become one; under three vertices none stay."""
    lo, hi = _bounds(extent, buffer)
    p, n = [px.astype(float), py.astype(float)], np.diff(off)
    for axis, edge, low in ((0, lo, True), (0, hi, False), (1, lo, True), (1, hi, False)):
        if not len(p[0]):
            break
        off = _offsets(n)
        ring = np.repeat(np.arange(len(n)), n)
        before = np.arange(len(ring)) - 1
        full = n > 0
        before[off[:-1][full]] = off[1:][full] - 1
        v, w = p[axis], p[1 - axis]
        inside = v >= edge if low else v <= edge
        cut = np.flatnonzero(inside != inside[before])
        at = _offsets(inside + (inside != inside[before]).astype(np.int64))
        t = (edge - v[before[cut]]) / (v[cut] - v[before[cut]])
        new_v, new_w = np.empty(at[-1]), np.empty(at[-1])
        new_v[at[cut]], new_w[at[cut]] = edge, w[before[cut]] + t * (w[cut] - w[before[cut]])
        own = at[1:][inside] - 1
        new_v[own], new_w[own] = v[inside], w[inside]
        p[axis], p[1 - axis] = new_v, new_w
        n = np.bincount(ring, np.diff(at), len(n)).astype(np.int64)
    x, y = rounded(p[0]), rounded(p[1])
    ring, off = np.repeat(np.arange(len(n)), n), _offsets(n)
    keep = np.ones(len(x), bool)
    keep[1:] = (ring[1:] != ring[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    x, y, ring = x[keep], y[keep], ring[keep]
    n = np.bincount(ring, minlength=len(n))
    off = _offsets(n)
    wide = np.flatnonzero(n > 1)
    closed = wide[(x[off[wide]] == x[off[wide + 1] - 1]) & (y[off[wide]] == y[off[wide + 1] - 1])]
    keep = np.ones(len(x), bool)
    keep[off[closed + 1] - 1] = False
    n[closed] -= 1
    keep &= np.repeat(n >= 3, np.diff(off))
    return x[keep], y[keep], _offsets(np.where(n >= 3, n, 0))


def orient_rings(x: np.ndarray, y: np.ndarray, off: np.ndarray, hole: np.ndarray):
    """(x, y, offsets): positive area outside, negative for holes; rings without area are empty."""
    n = np.diff(off)
    full = np.flatnonzero(n)
    after = np.arange(len(x)) + 1
    after[off[1:][full] - 1] = off[:-1][full]
    area = np.zeros(len(n))
    if len(full):
        area[full] = np.add.reduceat(x.astype(float) * y[after] - x[after].astype(float) * y, off[:-1][full])
    ring = np.repeat(np.arange(len(n)), n)
    turn = ((area < 0) != hole)[ring]
    at = np.arange(len(x))
    at = np.where(turn, off[:-1][ring] + off[1:][ring] - 1 - at, at)[area[ring] != 0]
    return x[at], y[at], _offsets(np.where(area != 0, n, 0))


def whole_polygons(x: np.ndarray, y: np.ndarray, off: np.ndarray, polygon: np.ndarray):
    """(x, y, ring offsets, polygon offsets over rings) without empty rings: a polygon whose first ring is
    empty is gone, an empty hole only itself.  ``polygon``: offsets over rings."""
    n, of = np.diff(off), np.repeat(np.arange(len(polygon) - 1), np.diff(polygon))
    good = np.zeros(len(polygon) - 1, bool)
    some = np.diff(polygon) > 0
    good[some] = n[polygon[:-1][some]] > 0
    keep = (n > 0) & good[of]
    stay = np.repeat(keep, n)
    return x[stay], y[stay], _offsets(n[keep]), _offsets(np.bincount(of[keep], minlength=len(good)))


def commands(x: np.ndarray, y: np.ndarray, part: np.ndarray, feature: np.ndarray, closed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(command integers, offsets by feature); the cursor runs on through the parts of a feature."""
    n = np.diff(part)
    size = 2 * n + (3 if closed else 2)
    at = _offsets(size)
    first = np.zeros(len(x), bool)
    first[part[feature[:-1][np.diff(feature) > 0]]] = True
    step = lambda v: np.where(first, v, v - np.concatenate(([0], v[:-1])))
    zig = lambda v: ((v << 1) ^ (v >> 63)) & 0xFFFFFFFF
    out = np.empty(at[-1], np.int64)
    of = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(x)) - part[:-1][of]
    place = at[:-1][of] + 1 + 2 * j + (j > 0)
    out[place], out[place + 1] = zig(step(x)), zig(step(y))
    out[at[:-1]], out[at[:-1] + 3] = 9, 2 | (n - 1) << 3
    if closed:
        out[at[1:] - 1] = 15
    return out, at[feature]


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values and offsets of a list array; a null list is empty."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), _offsets(n.astype(np.int64))


def _number(a: pa.Array, kind) -> np.ndarray:
    return a.cast(kind).to_numpy(zero_copy_only=False)


def _lines(lons, lats, z, x, y, extent, buffer):
    lon, off = _flat(lons)
    lat, same = _flat(lats)
    if (off != same).any():
        raise ValueError("a line needs as many longitudes as latitudes")
    of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    tile = [_number(c, pa.int64())[of] for c in (z, x, y)]
    px, py = project(_number(lon, pa.float64()), _number(lat, pa.float64()), *tile, extent)
    return clip_lines(rounded(px), rounded(py), off, extent, buffer)


def _polygons(rings, z, x, y, extent, buffer):
    ring, polygon = _flat(rings)
    point, off = _flat(ring)
    lon, lat = (_number(point.field(i), pa.float64()) for i in range(2))
    n = np.diff(off)
    few = np.repeat(n >= 3, n)
    of = np.repeat(np.repeat(np.arange(len(polygon) - 1), np.diff(polygon)), n)[few]
    tile = [_number(c, pa.int64())[of] for c in (z, x, y)]
    px, py = project(lon[few], lat[few], *tile, extent)
    hole = np.ones(len(n), bool)
    hole[polygon[:-1][np.diff(polygon) > 0]] = False
    cut = clip_rings(rounded(px), rounded(py), _offsets(np.where(n >= 3, n, 0)), extent, buffer)
    return whole_polygons(*orient_rings(*cut, hole), polygon)


def _as_parts(x, y, part, feature) -> pa.Array:
    points = pa.StructArray.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32())], names=["x", "y"])
    return pa.ListArray.from_arrays(pa.array(feature, pa.int32()), pa.ListArray.from_arrays(pa.array(part, pa.int32()), points))


def _as_commands(x, y, part, feature, closed: bool) -> pa.Array:
    values, off = commands(x, y, part, feature, closed)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values))


def line_parts(lons: Column, lats: Column, z: Column, x: Column, y: Column, extent: int = EXTENT, buffer: float = BUFFER) -> Column:
    """Visible parts of array columns of positions in a tile, as PARTS."""
    run = F.arrow_udf(lambda a, b, k, i, j: _as_parts(*_lines(a, b, k, i, j, extent, buffer)), PARTS)
    return run(lons, lats, z, x, y)


def polygon_parts(rings: Column, z: Column, x: Column, y: Column, extent: int = EXTENT, buffer: float = BUFFER) -> Column:
    """Clipped, oriented rings of polygons (array of rings of structs lng, lat; holes follow the exterior), as PARTS."""
    run = F.arrow_udf(lambda r, k, i, j: _as_parts(*_polygons(r, k, i, j, extent, buffer)), PARTS)
    return run(rings, z, x, y)


def line_commands(lons: Column, lats: Column, z: Column, x: Column, y: Column, extent: int = EXTENT, buffer: float = BUFFER) -> Column:
    """Command integers of what a tile shows of a line, all its parts as one geometry; empty if nothing."""
    run = F.arrow_udf(lambda a, b, k, i, j: _as_commands(*_lines(a, b, k, i, j, extent, buffer), False), "array<bigint>")
    return run(lons, lats, z, x, y)


def polygon_commands(rings: Column, z: Column, x: Column, y: Column, extent: int = EXTENT, buffer: float = BUFFER) -> Column:
    """Command integers of what a tile shows of a polygon with its holes; empty if nothing."""
    run = F.arrow_udf(lambda r, k, i, j: _as_commands(*_polygons(r, k, i, j, extent, buffer), True), "array<bigint>")
    return run(rings, z, x, y)
