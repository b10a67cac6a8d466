"""Grid boxes to key ranges: a descent through the curve's quadrants, on the driver or in a UDTF."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql.functions import udtf

from ..functions.curve import check_order, decode_value, encode_value
from ..functions.geodesy import radius_boxes
from ..functions.projection import LINEAR, wrap_longitude_value

MAX_RANGES = 128


@dataclass(frozen=True)
class Box:
    """Cells x0..x1, y0..y1, all inclusive."""

    x0: int
    y0: int
    x1: int
    y1: int


def grid_box(min_lon: float, max_lon: float, min_lat: float, max_lat: float, order: int, projection=LINEAR) -> Box:
    """The cells of a box whose longitudes lie within the world."""
    (x0, y0), (x1, y1) = projection.point(min_lon, min_lat, order), projection.point(max_lon, max_lat, order)
    return Box(min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1))


def wrapped(box: Box, order: int) -> list[Box]:
    """Boxes inside the world: columns past an end come in at the other, rows are clipped."""
    n = 1 << check_order(order)
    y0, y1 = max(box.y0, 0), min(box.y1, n - 1)
    if y0 > y1 or box.x0 > box.x1:
        return []
    if box.x1 - box.x0 + 1 >= n:
        return [Box(0, y0, n - 1, y1)]
    a, b = box.x0 % n, box.x1 % n
    return [Box(a, y0, b, y1)] if a <= b else [Box(a, y0, n - 1, y1), Box(0, y0, b, y1)]


def _turns() -> list[list[tuple[int, int, int, int]]]:
    """For each turn of a block (1 mirrored, 2 axes swapped, 3 both): digit, column, row and turn of its quadrants, last first."""
    out: list[list[tuple[int, int, int, int]]] = []
    for turn in range(4):
        row = []
        for q in (3, 2, 1, 0):
            rx = q >> 1
            ry = q & 1 ^ rx
            x, y = (1 - rx, 1 - ry) if turn & 1 else (rx, ry)
            row.append((q, *((y, x) if turn & 2 else (x, y)), turn if ry else turn ^ (2 | rx)))
        out.append(row)
    return out


TURNS = _turns()


def _cover(box: Box, order: int) -> list[list[int]]:
    """Ranges of exactly the box's cells, in key order: whole quadrants are taken, others descended."""
    out: list[list[int]] = []
    bx0, by0, bx1, by1 = box.x0, box.y0, box.x1, box.y1
    # (first key, bits left, lower corner, turn of the curve in the block)
    stack = [(0, order, 0, 0, 0)]
    while stack:
        first, bits, x, y, turn = stack.pop()
        side = 1 << bits
        if x > bx1 or y > by1 or x + side <= bx0 or y + side <= by0:
            continue
        if bits == 0 or (x >= bx0 and y >= by0 and x + side - 1 <= bx1 and y + side - 1 <= by1):
            last = first + side * side - 1
            if out and out[-1][1] + 1 == first:
                out[-1][1] = last
            else:
                out.append([first, last])
            continue
        bits -= 1
        side >>= 1
        for q, dx, dy, t in TURNS[turn]:
            stack.append((first + (q << 2 * bits), bits, x + dx * side, y + dy * side, t))
    return out


def compact(ranges: list[list[int]], most: int = MAX_RANGES) -> list[list[int]]:
    """At most ``most`` ranges: the smallest gaps are closed, the earlier one first on a tie."""
    if most <= 0 or len(ranges) <= most:
        return [list(r) for r in ranges]
    gaps = sorted(range(1, len(ranges)), key=lambda i: (-(ranges[i][0] - ranges[i - 1][1]), -i))
    keep = set(gaps[: most - 1])
    out = [list(ranges[0])]
    for i in range(1, len(ranges)):
        if i in keep:
            out.append(list(ranges[i]))
        else:
            out[-1][1] = ranges[i][1]
    return out


def box_ranges(box: Box, order: int, most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """Sorted inclusive key ranges that hold every cell of a (possibly wrapping) box."""
    found = sorted(r for b in wrapped(box, order) for r in _cover(_coarse(b, order, most), order))
    merged: list[list[int]] = []
    for lo, hi in found:
        if merged and lo <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return [(a, b) for a, b in compact(merged, most)]


def _coarse(box: Box, order: int, most: int) -> Box:
    """Very large boxes are rounded out to coarser cells first, so the descent stays small."""
    if most <= 0:
        return box
    span = max(box.x1 - box.x0, box.y1 - box.y0) + 1
    k = max(0, span.bit_length() - 9)
    side = 1 << k
    return Box(box.x0 & -side, box.y0 & -side, box.x1 | (side - 1), box.y1 | (side - 1))


def radius_ranges(lon: float, lat: float, metres: float, order: int, projection=LINEAR, most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """Key ranges that hold every point within ``metres``."""
    found = sorted(r for b in radius_boxes(lon, lat, metres) for r in box_ranges(grid_box(*b, order, projection), order, most))
    merged: list[list[int]] = []
    for lo, hi in found:
        if merged and lo <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return [(a, b) for a, b in compact(merged, most)]


def neighbour_box(key: int, neighbour: int, order: int) -> Box:
    """Search box around ``key``: half width is the cell distance to ``neighbour``, rounded up."""
    (x, y), (u, v) = decode_value(key, order), decode_value(neighbour, order)
    r = math.ceil(math.hypot(u - x, v - y))
    return Box(x - r, y - r, x + r, y + r)


def key_of_value(lon: float, lat: float, order: int, projection=LINEAR) -> int:
    return encode_value(*projection.point(wrap_longitude_value(lon), lat, order), order)


@udtf(returnType="lo: bigint, hi: bigint")
class RadiusRanges:
    """Lateral form: the key ranges of each query row (lon, lat, metres, order, most)."""

    def eval(self, lon: float, lat: float, metres: float, order: int, most: int):
        if None not in (lon, lat, metres):
            yield from radius_ranges(lon, lat, metres, order, most=most)
