"""Vector tiles: assignment of points, ids, attribute interning, protobuf bytes and their decoding.

Geometry is encoded row by row before any shuffle.  Framing needs a tile's features together in
their order; a layer is framed by one task, so its size is bounded by what a tile can sensibly hold.
"""
from __future__ import annotations

import math
import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.projection import BUFFER, EXTENT, in_buffer, pixel, rounded_pixel, tile_of
from . import clip
from .geometry import LINE_TYPE, POLYGON_TYPE, point_commands

TILE_BYTES = "z int, x long, y long, data binary, n_features long"


def tile_points(points: DataFrame, zoom: int, extent: int = EXTENT) -> DataFrame:
    """(z, x, y, px, py, commands, all columns of ``points``): each point in all tiles it is drawn in.

    A point belongs to its own tile and, in the buffer ring, to up to three neighbours; candidates
    are the 3 by 3 neighbourhood inside the world, the pixel test decides.  No shuffle.
    """
    if not 0 <= zoom <= 30:
        raise ValueError("zoom must be 0 to 30")
    cx, cy = tile_of(F.col("lon"), F.col("lat"), zoom)
    top = (1 << zoom) - 1
    near = lambda c: F.array_distinct(F.filter(F.array(c - 1, c, c + 1), lambda v: (v >= 0) & (v <= top)))
    out = points.withColumn("x", F.explode(near(cx))).withColumn("y", F.explode(near(cy))).withColumn("z", F.lit(zoom))
    px, py = pixel(F.col("lon"), F.col("lat"), F.col("z"), F.col("x"), F.col("y"), extent)
    out = out.withColumn("_px", px).withColumn("_py", py).where(in_buffer(F.col("_px"), F.col("_py"), extent))
    rx, ry = rounded_pixel(F.col("_px"), F.col("_py"))
    out = out.withColumn("px", rx).withColumn("py", ry).drop("_px", "_py")
    return out.withColumn("commands", point_commands(F.col("px"), F.col("py")))


def tile_shapes(shapes: DataFrame, zoom: int, extent: int = EXTENT) -> DataFrame:
    """(z, x, y, commands, all columns of ``shapes``): each line or polygon in all tiles that show some of it.

    ``shapes`` has type (LINE_TYPE or POLYGON_TYPE) and rings (array of arrays of structs lng, lat; a line
    is one ring, holes follow the exterior).  Candidates are the tiles that the box of the shape and the
    buffer touch, clipping decides.  No shuffle.  A shape without a position is in no tile.
    """
    if not 0 <= zoom <= 30:
        raise ValueError("zoom must be 0 to 30")
    side, top = float(1 << zoom), F.lit((1 << zoom) - 1)
    ends = F.flatten("rings")
    least = lambda f, pick: pick(ends[f])
    column = lambda lng: (lng + 180.0) / 360.0 * side
    # the row of the pole itself is infinite: held within the world before it becomes a whole number
    row = lambda lat: F.coalesce((F.lit(1.0) - F.log(F.tan(F.radians(lat) / 2.0 + math.pi / 4)) / math.pi) / 2.0 * side, F.when(lat < 0, F.lit(side)).otherwise(F.lit(0.0)))
    within = lambda v: F.greatest(F.least(F.floor(F.greatest(F.least(v, F.lit(2 * side)), F.lit(-side))), top), F.lit(0)).cast("long")
    span = lambda a, b: F.explode(F.when(a <= b, F.sequence(a, b)))
    out = shapes.withColumn("z", F.lit(zoom))
    out = out.withColumn("x", span(within(column(least("lng", F.array_min)) - BUFFER), within(column(least("lng", F.array_max)) + BUFFER)))
    out = out.withColumn("y", span(within(row(least("lat", F.array_max)) - BUFFER), within(row(least("lat", F.array_min)) + BUFFER)))
    at = F.col("z"), F.col("x"), F.col("y")
    lngs, lats = (F.col("rings")[0][f] for f in ("lng", "lat"))
    lines = out.where(F.col("type") == LINE_TYPE).withColumn("commands", clip.line_commands(lngs, lats, *at, extent=extent))
    areas = out.where(F.col("type") == POLYGON_TYPE).withColumn("commands", clip.polygon_commands(F.col("rings"), *at, extent=extent))
    return lines.unionByName(areas).where(F.size("commands") > 0)


def feature_ids(features: DataFrame, keys: list[str], order: list[str], explicit: str = "explicit_id") -> DataFrame:
    """Adds ``feature_id``: the explicit id, else 1, 2, 3, ... in order among those without one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    auto = F.count(F.when(F.col(explicit).isNull(), 1)).over(w)
    return features.withColumn("feature_id", F.coalesce(F.col(explicit).cast("long"), auto))


def intern_tags(tags: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, tag_key, tag_value, key_index, value_index): first-seen numbers within each layer.

    ``tags`` has a row for each attribute, in ``order``; null values are skipped.  First positions
    are found with a combining minimum, only the distinct keys and values are numbered.
    """
    at = F.struct(*order)
    live = tags.where(F.col("tag_value").isNotNull())
    number = lambda what: live.groupBy(*keys, what).agg(F.min(at).alias("at")).withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1)
    k = number("tag_key").withColumnRenamed("i", "key_index").drop("at")
    v = number("tag_value").withColumnRenamed("i", "value_index").drop("at")
    pairs = live.select(*keys, "tag_key", "tag_value").distinct()
    return pairs.join(k, [*keys, "tag_key"]).join(v, [*keys, "tag_value"])


def varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, payload: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def value_bytes(kind: str, value) -> bytes:
    """A value message.  Kinds: s string, f float, d double, i signed, u unsigned, b boolean."""
    if kind == "s":
        return field(1, str(value).encode())
    if kind == "f":
        return varint(2 << 3 | 5) + struct.pack("<f", value)
    if kind == "d":
        return varint(3 << 3 | 1) + struct.pack("<d", value)
    if kind == "u":
        return varint(5 << 3) + varint(int(value))
    if kind == "i":
        v = int(value)
        return varint(6 << 3) + varint((v << 1) ^ (v >> 63))
    if kind == "b":
        return varint(7 << 3) + varint(int(bool(value)))
    raise ValueError(f"attribute kind {kind!r} is not supported")


def checked_tile(z: Column, x: Column, y: Column, extent: int = EXTENT) -> Column:
    """True, or an error for a zoom outside 0 to 30 or a column or row outside its world."""
    if extent <= 0:
        raise ValueError("extent must be greater than zero")
    top = F.pow(F.lit(2.0), F.greatest(F.least(z, F.lit(30)), F.lit(0))).cast("long") - 1
    bad = (z < 0) | (z > 30) | (x < 0) | (x > top) | (y < 0) | (y > top)
    return F.when(bad, F.raise_error(F.lit("z must be 0 to 30, x and y 0 to 2^z - 1")).cast("boolean")).otherwise(F.lit(True))


def attribute(df: DataFrame, name: str, key: str | None = None) -> Column:
    """struct<key, kind, value> of a column, by its type: text, numbers, booleans; decimals are doubles, and
    dates and times are text in ISO form with seven digits of a second."""
    kind, c = dict(df.dtypes)[name], df[name]
    fine = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0'"
    kinds = {"string": "s", "boolean": "b", "float": "f", "double": "d", "tinyint": "i", "smallint": "i", "int": "i", "bigint": "i"}
    if kind in kinds:
        kind, value = kinds[kind], c.cast("string")
    elif kind.startswith("decimal"):
        kind, value = "d", c.cast("double").cast("string")
    elif kind in ("date", "timestamp_ntz"):
        kind, value = "s", F.date_format(c.cast("timestamp_ntz"), fine)
    elif kind == "timestamp":
        kind, value = "s", F.date_format(c, fine + "xxx")
    else:
        raise ValueError(f"attribute {name} of type {kind} is not supported")
    return F.struct(F.lit(key or name).alias("key"), F.lit(kind).alias("kind"), value.alias("value"))


class Layer:
    """One layer in the making; values of all kinds share one sequence of indexes."""

    def __init__(self, name: str, extent: int = EXTENT):
        self.name, self.extent, self.features, self.next_id = name, extent, [], 1
        self.keys: dict[str, int] = {}
        self.values: dict[tuple, int] = {}
        self.tables: list[bytes] = []

    def _value(self, kind: str, value) -> int:
        known = (kind, value) if kind not in "fd" else (kind, "nan" if value != value else 0.0 if value == 0 else value)
        if known not in self.values:
            self.values[known] = len(self.tables)
            self.tables.append(value_bytes(kind, value))
        return self.values[known]

    def add(self, geometry_type: int, commands, attributes=(), explicit_id: int | None = None) -> None:
        """``attributes``: (key, kind, value); nulls are skipped.  Values are checked before keys are added."""
        live = [(k, t, v) for k, t, v in attributes if v is not None]
        for _, t, v in live:
            value_bytes(t, v)
        tags = b"".join(varint(self.keys.setdefault(k, len(self.keys))) + varint(self._value(t, v)) for k, t, v in live)
        number = explicit_id
        if number is None:
            number, self.next_id = self.next_id, self.next_id + 1
        body = varint(1 << 3) + varint(number) + (field(2, tags) if tags else b"") + varint(3 << 3) + varint(geometry_type)
        self.features.append(body + field(4, b"".join(map(varint, commands))))

    def build(self) -> bytes:
        body = field(1, self.name.encode()) + b"".join(field(2, f) for f in self.features) + b"".join(field(3, k.encode()) for k in self.keys)
        body += b"".join(field(4, v) for v in self.tables) + varint(5 << 3) + varint(self.extent) + varint(15 << 3) + varint(2)
        return field(3, body)


def build_tile(layers: list[Layer]) -> bytes:
    """Layers in their order; no layers make no bytes, an empty layer is still written."""
    return b"".join(x.build() for x in layers)


def encode_tiles(features: DataFrame, extent: int = EXTENT) -> DataFrame:
    """(z, x, y, data, n_features) from features (z, x, y, layer, pos, type, commands, tags, explicit_id).

    ``tags`` is array<struct<key, kind, value: string>>; layers come in the order of their first
    feature, features in the order of ``pos``.
    """
    to = {"s": str, "f": float, "d": float, "i": int, "u": int, "b": lambda v: v == "true"}

    names = ["z", "x", "y", "layer", "type", "commands", "tags", "explicit_id"]

    def run(batches):
        key, layers, n = None, {}, 0
        done: list[tuple] = []

        def flush():
            out = pa.table([pa.array([r[i] for r in done], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["z", "x", "y", "data", "n_features"])
            done.clear()
            return out.to_batches()

        for b in batches:
            for z, x, y, name, kind, commands, tags, explicit in zip(*(b.column(c).to_pylist() for c in names)):
                if (z, x, y) != key:
                    if key is not None:
                        done.append((*key, build_tile(list(layers.values())), n))
                    key, layers, n = (z, x, y), {}, 0
                layer = layers.get(name) or layers.setdefault(name, Layer(name, extent))
                layer.add(kind, commands, [(t["key"], t["kind"], None if t["value"] is None else to[t["kind"]](t["value"])) for t in tags or ()], explicit)
                n += 1
            if len(done) >= 256:
                yield from flush()
        if key is not None:
            done.append((*key, build_tile(list(layers.values())), n))
            yield from flush()

    # rows arrive tile by tile, so a task holds the layers of one tile and not a frame of its features
    rows = features.select(F.col("z").cast("int"), F.col("x").cast("long"), F.col("y").cast("long"), "layer", F.col("type").cast("int"), "commands", "tags", "explicit_id", "pos")
    return rows.repartition("z", "x", "y").sortWithinPartitions("z", "x", "y", "pos").drop("pos").mapInArrow(run, TILE_BYTES)


def save_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles as a Parquet store, a folder for each zoom and rows sorted by x, y: a tile is one range read."""
    tiles.repartitionByRange("z", "x", "y").sortWithinPartitions("z", "x", "y").write.partitionBy("z").parquet(path)


def load_tiles(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def read_fields(data: bytes):
    """(number, wire type, value) of a message."""
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        wire = key & 7
        if wire == 0:
            v, at = read_varint(data, at)
        elif wire == 2:
            n, at = read_varint(data, at)
            v, at = data[at : at + n], at + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            v, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {wire}")
        yield key >> 3, wire, v


def _packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = read_varint(data, at)
        out.append(v)
    return out


def _value(data: bytes):
    ((number, _, v),) = read_fields(data)
    if number == 1:
        return v.decode()
    if number == 2:
        return struct.unpack("<f", v)[0]
    if number == 3:
        return struct.unpack("<d", v)[0]
    if number == 6:
        return v >> 1 ^ -(v & 1)
    return bool(v) if number == 7 else v


def decode_tile(data: bytes) -> list[dict]:
    """Layers with name, extent, version and features (id, type, commands, tags)."""
    out = []
    for number, _, body in read_fields(data):
        if number != 3:
            continue
        layer = {"name": None, "extent": 4096, "version": 1, "features": []}
        keys, values, raw = [], [], []
        for n, _, v in read_fields(body):
            if n == 1:
                layer["name"] = v.decode()
            elif n == 2:
                raw.append(v)
            elif n == 3:
                keys.append(v.decode())
            elif n == 4:
                values.append(_value(v))
            elif n == 5:
                layer["extent"] = v
            elif n == 15:
                layer["version"] = v
        for f in raw:
            parts = {n: v for n, _, v in read_fields(f)}
            t = _packed(parts.get(2, b""))
            layer["features"].append({"id": parts.get(1, 0), "type": parts.get(3, 0), "commands": _packed(parts.get(4, b"")), "tags": {keys[a]: values[b] for a, b in zip(t[::2], t[1::2])}})
        out.append(layer)
    return out


def _geometry_faults(kind: int, commands: list[int]) -> list[str]:
    """What is wrong with a command sequence, by the format's rules for its geometry type."""
    runs, at = [], 0
    while at < len(commands):
        run = commands[at] & 7, commands[at] >> 3
        runs.append(run)
        at += 1 + (0 if run[0] == 7 else 2 * run[1])
    if at != len(commands):
        return ["parameters are missing"]
    if kind == 1:
        return [] if len(runs) == 1 and runs[0][0] == 1 and runs[0][1] > 0 else ["a point is one MoveTo"]
    if kind == 2:
        ok = runs and len(runs) % 2 == 0 and all(a == (1, 1) and b[0] == 2 and b[1] > 0 for a, b in zip(runs[::2], runs[1::2]))
        return [] if ok else ["a line is MoveTo 1, then LineTo"]
    if kind == 3:
        ok = runs and len(runs) % 3 == 0 and all(a == (1, 1) and b[0] == 2 and b[1] > 1 and c == (7, 1) for a, b, c in zip(runs[::3], runs[1::3], runs[2::3]))
        return [] if ok else ["a ring is MoveTo 1, LineTo 2 or more, ClosePath 1"]
    return ["unknown geometry type"]


def violations(data: bytes) -> list[str]:
    """Rules of the tile format, version 2, that the bytes break; none for a conforming tile."""
    out, names = [], []
    for number, _, body in read_fields(data):
        if number != 3:
            out.append("field outside a layer")
            continue
        fields: dict[int, list] = {}
        for n, _, v in read_fields(body):
            fields.setdefault(n, []).append(v)
        names += fields.get(1, [])
        if len(fields.get(1, [])) != 1 or not fields[1][0]:
            out.append("a layer needs one name")
        if fields.get(15) != [2]:
            out.append("a layer needs version 2")
        keys, values = fields.get(3, []), fields.get(4, [])
        out += [f"repeated {what}" for what, x in (("key", keys), ("value", values)) if len(set(x)) != len(x)]
        ids = []
        for f in fields.get(2, []):
            parts = {n: v for n, _, v in read_fields(f)}
            tags = _packed(parts.get(2, b""))
            ids.append(parts.get(1))
            if len(tags) % 2 or any(k >= len(keys) for k in tags[::2]) or any(v >= len(values) for v in tags[1::2]):
                out.append("tags do not point to keys and values")
            if len(set(tags[::2])) != len(tags[::2]):
                out.append("a feature has a key twice")
            out += _geometry_faults(parts.get(3, 0), _packed(parts.get(4, b"")))
        if len({i for i in ids if i is not None}) != len([i for i in ids if i is not None]):
            out.append("repeated feature id")
    return out + ["repeated layer name"] * (len(set(names)) != len(names))


def conformance(tiles: DataFrame) -> DataFrame:
    """(z, x, y, n_features, violations) of tile bytes."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"z": pdf.z, "x": pdf.x, "y": pdf.y, "n_features": [sum(len(a["features"]) for a in decode_tile(bytes(b))) for b in pdf.data], "violations": [len(violations(bytes(b))) for b in pdf.data]})

    return tiles.select("z", "x", "y", "data").mapInPandas(run, "z int, x long, y long, n_features long, violations long")


def decoded_kinds(tiles: DataFrame) -> DataFrame:
    """(z, x, y, layer, feature_id, type) of all features in tile bytes."""

    def run(batches):
        for pdf in batches:
            rows = [(r.z, r.x, r.y, layer["name"], f["id"], f["type"]) for r in pdf.itertuples(index=False) for layer in decode_tile(bytes(r.data)) for f in layer["features"]]
            yield pd.DataFrame(rows, columns=["z", "x", "y", "layer", "feature_id", "type"])

    return tiles.select("z", "x", "y", "data").mapInPandas(run, "z int, x long, y long, layer string, feature_id long, type int")


def decoded_points(tiles: DataFrame) -> DataFrame:
    """(z, x, y, layer, feature_id, px, py) of the point features in tile bytes."""

    def run(batches):
        from .geometry import decode_commands

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for layer in decode_tile(bytes(r.data)):
                    for f in layer["features"]:
                        for part in decode_commands(f["commands"]):
                            rows.append((r.z, r.x, r.y, layer["name"], f["id"], *part[0]))
            yield pd.DataFrame(rows, columns=["z", "x", "y", "layer", "feature_id", "px", "py"])

    return tiles.select("z", "x", "y", "data").mapInPandas(run, "z int, x long, y long, layer string, feature_id long, px long, py long")
