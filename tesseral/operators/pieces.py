"""Tiles in pieces: lines and polygons to tile bytes, and back, without a task that holds a tile.

A layer's message is its name, features, keys and values one after the other, so its bytes can be cut
between any two of them.  Shapes are dealt by ranges of their order, and each Arrow batch makes one piece
of each tile and layer that it touches; counts of the pieces before give ids and indexes.  The bytes
of all pieces of a layer in their order, behind its head, are what ``tiles.encode_tiles`` makes.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.projection import BUFFER, EXTENT
from . import clip
from .geometry import LINE_TYPE, POLYGON_TYPE
from .tiles import field, value_bytes, varint

#: Vertices, counted once for each tile that they are tried in, of one pass through numpy.
SLICE = 1_000_000
LAYER = ["z", "x", "y", "layer"]
DRAFT = "z int, x long, y long, layer string, piece long, first int, n long, autos long, kinds binary, explicit binary, tag_n binary, tag_k binary, tag_v binary, keys array<binary>, vals array<binary>, cmd binary, cmd_n binary"
PIECES = "z int, x long, y long, layer string, piece long, n_features long, data binary"
_TO = {"s": str, "f": float, "d": float, "i": int, "u": int, "b": lambda v: v == "true"}
_offsets = clip._offsets


def _blob(a, kind) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def varints(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size of each) of unsigned 64-bit numbers."""
    v = v.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = v >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        size += more
    at = _offsets(size)
    out = np.empty(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        i = np.flatnonzero(size > k)
        out[at[i] + k] = (v[i] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F | ((size[i] > k + 1) << 7).astype(np.uint8)
    return out, size


def _sums(v: np.ndarray, count: np.ndarray) -> np.ndarray:
    at = _offsets(count)
    return _offsets(v)[at[1:]] - _offsets(v)[at[:-1]]


def _from(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of every run."""
    return np.arange(int(size.sum())) + np.repeat(start - _offsets(size)[:-1], size)


def _weave(columns: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes) of rows that are the bytes of all columns one after the other."""
    total = sum(size for _, size in columns)
    at = _offsets(total)[:-1]
    out = np.empty(int(total.sum()), np.uint8)
    for data, size in columns:
        out[_from(at, size)] = data
        at = at + size
    return out, total


def _const(n: int, byte: int, where=None) -> tuple[np.ndarray, np.ndarray]:
    size = np.ones(n, np.int64) if where is None else where.astype(np.int64)
    return np.full(int(size.sum()), byte, np.uint8), size


def _numbered(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers in the order of their first place, index of each)."""
    seen, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return seen[order], rank[inverse]


class _Entries:
    """Encoded keys or values of a batch in the order of their first feature; equal numbers of either sign of zero are one."""

    def __init__(self):
        self.at: dict = {}
        self.data: list[bytes] = []

    def index(self, entry, encode) -> int:
        i = self.at.get(entry)
        if i is None:
            data = encode()
            i = self.at[entry] = self.at.setdefault(data, len(self.data))
            if i == len(self.data):
                self.data.append(data)
        return i


def _value(kind: str, text: str) -> bytes:
    v = _TO[kind](text)
    if kind in "fd":
        v = math.nan if v != v else v + 0.0
    return field(4, value_bytes(kind, v))


def _tags(tags: pa.Array):
    """(keys, values, attributes of each feature, their keys, their values); nulls are skipped."""
    keys, values, n, k, v = _Entries(), _Entries(), [], [], []
    for row in tags.to_pylist():
        before = len(k)
        for t in row or ():
            if t["value"] is not None:
                v.append(values.index((t["kind"], t["value"]), lambda t=t: _value(t["kind"], t["value"])))
                k.append(keys.index(t["key"], lambda t=t: field(3, t["key"].encode())))
        n.append(len(k) - before)
    return keys.data, values.data, *(np.array(a, np.int64) for a in (n, k, v))


def _world(lon: np.ndarray, lat: np.ndarray, side: float) -> tuple[np.ndarray, np.ndarray]:
    px, py = clip.project(lon, lat, math.log2(side), 0, 0, 1)
    return px, py


def _clipped(batch: pa.RecordBatch, zoom: int, extent: int):
    """(shape, x, y, commands, commands of each) of what the tiles show of the shapes of a batch, slice by slice."""
    kind = clip._number(batch.column("type"), pa.int64())
    ring, shape = clip._flat(batch.column("rings"))
    point, off = clip._flat(ring)
    lon, lat = (clip._number(point.field(i), pa.float64()) for i in range(2))
    side, top = float(1 << zoom), (1 << zoom) - 1
    wx, wy = _world(lon, lat, side)
    n, rings = np.diff(off), np.diff(shape)
    ends = off[shape]
    vertices = np.diff(ends)
    some = np.flatnonzero((vertices > 0) & ((kind == LINE_TYPE) | (kind == POLYGON_TYPE)))
    if not len(some):
        return

    def ends_of(v):
        # a shape's vertices are one run; a place that is no number counts in neither end
        lows, highs = np.where(np.isnan(v), np.inf, v), np.where(np.isnan(v), -np.inf, v)
        cut = np.stack((ends[:-1][some], ends[1:][some]), 1).ravel()
        return np.minimum.reduceat(np.append(lows, np.inf), cut)[::2], np.maximum.reduceat(np.append(highs, -np.inf), cut)[::2]

    def span(lo, hi):
        held = lambda e: np.clip(np.floor(np.clip(e, -side, 2 * side)), 0, top).astype(np.int64)
        a, b = held(lo - BUFFER), held(hi + BUFFER)
        return a, np.where(lo <= hi, b - a + 1, 0)

    (south, north), (west, east) = ends_of(lat), ends_of(lon)
    # beyond a pole a row is that of the pole, as in ``tiles.tile_shapes``
    row = lambda v: np.where(np.isfinite(r := _world(v, v, side)[1]), r, np.where(v < 0, side, 0.0))
    (x0, nx), (y0, ny) = span(_world(west, west, side)[0], _world(east, east, side)[0]), span(row(north), row(south))
    tries = nx * ny
    at, first = _offsets(tries), 0
    while first < at[-1]:
        # candidates first .. last: a slice ends anywhere, also between two tiles of one shape
        last = min(int(at[-1]), first + SLICE)
        c = np.arange(first, last)
        s = np.searchsorted(at, c, "right") - 1
        keep = max(1, int(np.searchsorted(np.cumsum(vertices[some[s]]), SLICE, "right")))
        c, s = c[:keep], s[:keep]
        first += keep
        j = c - at[s]
        x, y, s = x0[s] + j // ny[s], y0[s] + j % ny[s], some[s]
        for line in (True, False):
            own = np.flatnonzero((kind[s] == LINE_TYPE) == line)
            if len(own):
                yield from _slice(line, s[own], x[own], y[own], shape, rings, off, n, wx, wy, extent)


def _slice(line, s, x, y, shape, rings, off, n, wx, wy, extent):
    if line:
        size = n[shape[s]]
        start = off[shape[s]]
        of = np.repeat(np.arange(len(s)), size)
        i = _from(start, size)
    else:
        r = _from(shape[s], rings[s])
        size = np.where(n[r] >= 3, n[r], 0)
        of = np.repeat(np.repeat(np.arange(len(s)), rings[s]), size)
        i = _from(off[r], size)
    px, py = clip.rounded((wx[i] - x[of]) * extent), clip.rounded((wy[i] - y[of]) * extent)
    if line:
        parts = clip.clip_lines(px, py, _offsets(size), extent)
    else:
        polygon = _offsets(rings[s])
        hole = np.ones(len(r), bool)
        hole[polygon[:-1][rings[s] > 0]] = False
        parts = clip.whole_polygons(*clip.orient_rings(*clip.clip_rings(px, py, _offsets(size), extent), hole), polygon)
    values, at = clip.commands(*parts, not line)
    shown = np.flatnonzero(np.diff(at))
    yield s[shown], x[shown], y[shown], values, np.diff(at)[shown]


def _drafts(zoom: int, extent: int):
    names = [f.split(" ")[0] for f in DRAFT.split(", ")]

    def run(batches):
        base, batch_no = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            piece, batch_no = base + batch_no, batch_no + 1
            rows: list[tuple] = []
            layer_no, layers = {}, b.column("layer").to_pylist()
            layer = np.array([layer_no.setdefault(v, len(layer_no)) for v in layers], np.int64)
            kinds = clip._number(b.column("type"), pa.int64()).astype(np.uint8)
            ids = b.column("explicit_id")
            given = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys, values, tag_n, tag_k, tag_v = _tags(b.column("tags"))
            tag_at = _offsets(tag_n)
            keys, values = pa.array(keys, pa.binary()), pa.array(values, pa.binary())
            for name, number in layer_no.items():
                # what the batch has of each layer, for the search of entries that several pieces have
                of = _from(tag_at[:-1][layer == number], tag_n[layer == number])
                rows.append((-1, 0, 0, name, piece, 0, 0, 0, *[b""] * 5, keys.take(pa.array(np.unique(tag_k[of]))), values.take(pa.array(np.unique(tag_v[of]))), b"", b""))
            parts = list(_clipped(b, zoom, extent))
            if parts:
                s, x, y, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 4))
                data, size = varints(np.concatenate([p[3] for p in parts]))
                size = _sums(size, n)
                start = _offsets(size)[:-1]
                order = np.lexsort((s, layer[s], y, x))
                s, x, y, size, start = s[order], x[order], y[order], size[order], start[order]
                key = np.stack((x, y, layer[s]))
                cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(s)]
                names_of = list(layer_no)
                for a, z in zip(cuts, cuts[1:]):
                    f = s[a:z]
                    t = _from(tag_at[f], tag_n[f])
                    own_k, k = _numbered(tag_k[t])
                    own_v, v = _numbered(tag_v[t])
                    explicit = _blob(np.stack((given[f], ids[f])), np.int64) if given[f].any() else b""
                    rows.append((zoom, int(x[a]), int(y[a]), names_of[layer[f[0]]], piece, int(f[0]), z - a, int((~given[f]).sum()), kinds[f].tobytes(), explicit, _blob(tag_n[f], np.int32), _blob(k, np.int32), _blob(v, np.int32), keys.take(pa.array(own_k)), values.take(pa.array(own_v)), data[_from(start[a:z], size[a:z])].tobytes(), _blob(size[a:z], np.int32)))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5))]
            for i in (13, 14):
                lists = [r[i] for r in rows]
                flat = pa.concat_arrays(lists) if lists else pa.array([], pa.binary())
                columns.append(pa.ListArray.from_arrays(pa.array(_offsets(np.array([len(v) for v in lists], np.int64)), pa.int32()), flat))
            columns += [pa.array([r[i] for r in rows], pa.binary()) for i in (15, 16)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _entries(drafts: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """(own, known) for keys or values: how many each piece is the first to have, and (local place, index) of
    those that an earlier piece of its layer has.

    Only entries that several batches have are followed from tile to tile; the others are where they first occur.
    """
    shared = drafts.where("z < 0").select("layer", F.explode(what).alias("e")).groupBy("layer", "e").agg(F.count("*").alias("batches")).where("batches > 1").select("layer", "e")
    real = drafts.where("z >= 0")
    sizes = real.select(*LAYER, "piece", F.size(what).cast("long").alias("size"))
    if shared.isEmpty():
        seen = None
        lost = sizes.select(*LAYER, "piece", F.lit(0).cast("long").alias("lost"), F.array().cast("array<int>").alias("places")).limit(0)
    else:
        used = real.select(*LAYER, "piece", F.posexplode(what).alias("place", "e")).join(shared, ["layer", "e"])
        least = used.groupBy(*LAYER, "e").agg(F.min(F.struct("piece", "place")).alias("at"))
        seen = used.join(least, [*LAYER, "e"])
        lost = seen.where("piece <> at.piece").groupBy(*LAYER, "piece").agg(F.count("*").alias("lost"), F.array_sort(F.collect_list("place")).alias("places"))
    own = sizes.join(lost, [*LAYER, "piece"], "left").withColumn("own", F.col("size") - F.coalesce("lost", F.lit(0)))
    before = Window.partitionBy(*LAYER).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("base", F.coalesce(F.sum("own").over(before), F.lit(0)))
    if seen is None:
        known = sizes.select(*LAYER, "piece", F.array().cast("array<struct<place:int,i:bigint>>").alias("known")).limit(0)
    else:
        # the index in its first piece: those before it there, without the ones that were known already
        first = seen.where("piece = at.piece").select(*LAYER, "piece", "place", "e").join(own.select(*LAYER, "piece", "base", "places"), [*LAYER, "piece"])
        gone = F.size(F.filter(F.coalesce("places", F.array().cast("array<int>")), lambda p: p < F.col("place")))
        index = first.select(*LAYER, "e", (F.col("base") + F.col("place") - gone).alias("i"))
        known = seen.where("piece <> at.piece").join(index, [*LAYER, "e"]).groupBy(*LAYER, "piece").agg(F.array_sort(F.collect_list(F.struct("place", "i"))).alias("known"))
    return own.select(*LAYER, "piece", "base"), known


def _indexes(n: int, base: int, known) -> tuple[np.ndarray, np.ndarray]:
    """(index of each local entry, whether it is written here)."""
    own = np.ones(n, bool)
    places = np.array([k["place"] for k in known or ()], np.int64)
    own[places] = False
    at = base + np.cumsum(own) - 1
    at[places] = [k["i"] for k in known or ()]
    return at, own


def _final(batches):
    for b in batches:
        rows = []
        for r in b.select(["z", "x", "y", "layer", "piece", "n", "ids", "kinds", "explicit", "tag_n", "tag_k", "tag_v", "cmd", "cmd_n", "base_keys", "known_keys", "base_vals", "known_vals"]).to_pylist():
            i = len(rows)
            keys, vals = b.column("keys")[i].values, b.column("vals")[i].values
            k, own_k = _indexes(len(keys), r["base_keys"], r["known_keys"])
            v, own_v = _indexes(len(vals), r["base_vals"], r["known_vals"])
            n, tag_n = r["n"], np.frombuffer(r["tag_n"], np.int32).astype(np.int64)
            if r["explicit"]:
                given, ids = np.frombuffer(r["explicit"], np.int64).reshape(2, n)
                ids = np.where(given == 1, ids, r["ids"] + np.cumsum(given == 0))
            else:
                ids = r["ids"] + np.arange(1, n + 1)
            pairs = np.stack((k[np.frombuffer(r["tag_k"], np.int32)], v[np.frombuffer(r["tag_v"], np.int32)]), 1).ravel()
            tags, tag_size = varints(pairs)
            tag_size = _sums(tag_size, 2 * tag_n)
            some = tag_n > 0
            cmd, size = np.frombuffer(r["cmd"], np.uint8), np.frombuffer(r["cmd_n"], np.int32).astype(np.int64)
            length, one = varints(tag_size), np.ones(n, np.int64)
            length = length[0][np.repeat(some, length[1])], np.where(some, length[1], 0)
            body = _weave([_const(n, 1 << 3), varints(ids), _const(n, 2 << 3 | 2, some), length, (tags, tag_size), _const(n, 3 << 3), (np.frombuffer(r["kinds"], np.uint8), one), _const(n, 4 << 3 | 2), varints(size), (cmd, size)])
            data = _weave([_const(n, 2 << 3 | 2), varints(body[1]), body])[0].tobytes()
            data += b"".join(e for e in keys.filter(pa.array(own_k)).to_pylist()) + b"".join(vals.filter(pa.array(own_v)).to_pylist())
            rows.append((r["z"], r["x"], r["y"], r["layer"], r["piece"], n, data))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["z", "x", "y", "layer", "piece", "n_features", "data"])


def write_pieces(spark, shapes: DataFrame, zoom: int, path: str, extent: int = EXTENT) -> DataFrame:
    """PIECES of ``shapes`` (layer, pos, type, rings, tags, explicit_id as in ``tiles``) at one zoom, stored under ``path``.

    Features of a tile come in the order of ``pos``.  Keys and values of a layer stand behind the features
    that first have them, which the format allows.
    """
    if not 0 <= zoom <= 30:
        raise ValueError("zoom must be 0 to 30")
    rows = shapes.select("layer", "pos", "type", "rings", "tags", F.col("explicit_id").cast("long").alias("explicit_id"))
    dealt = rows.repartitionByRange("pos").sortWithinPartitions("pos").drop("pos")
    dealt.mapInArrow(_drafts(zoom, extent), DRAFT).write.parquet(f"{path}/drafts")
    drafts = spark.read.parquet(f"{path}/drafts")
    before = Window.partitionBy(*LAYER).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    facts = drafts.where("z >= 0").select(*LAYER, "piece", F.coalesce(F.sum("autos").over(before), F.lit(0)).alias("ids"))
    for what in ("keys", "vals"):
        own, known = _entries(drafts, what)
        facts = facts.join(own.withColumnRenamed("base", f"base_{what}"), [*LAYER, "piece"]).join(known.withColumnRenamed("known", f"known_{what}"), [*LAYER, "piece"], "left")
    full = drafts.where("z >= 0").join(facts, [*LAYER, "piece"])
    full.mapInArrow(_final, PIECES).write.parquet(f"{path}/pieces")
    return spark.read.parquet(f"{path}/pieces")


def heads(spark, path: str, extent: int = EXTENT) -> DataFrame:
    """(z, x, y, layer, place, head, tail): what stands before and after the pieces of each layer; ``place`` orders the layers of a tile."""
    tail = varint(5 << 3) + varint(extent) + varint(15 << 3) + varint(2)
    firsts = spark.read.parquet(f"{path}/drafts").where("z >= 0").groupBy(*LAYER).agg(F.min(F.struct("piece", "first")).alias("place"))
    sizes = spark.read.parquet(f"{path}/pieces").groupBy(*LAYER).agg(F.sum(F.length("data")).alias("size"))

    @F.pandas_udf("binary")
    def head(name: pd.Series, size: pd.Series) -> pd.Series:
        named = [field(1, n.encode()) for n in name]
        return pd.Series([varint(3 << 3 | 2) + varint(len(n) + int(s) + len(tail)) + n for n, s in zip(named, size)])

    return firsts.join(sizes, LAYER).select(*LAYER, "place", head("layer", "size").alias("head"), F.lit(tail).alias("tail"))


# --- reading


def _read_varints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, places behind them) of the varints at ``at``."""
    v, at, live = np.zeros(len(at), np.uint64), at.copy(), np.arange(len(at))
    for k in range(10):
        b = data[at[live]]
        v[live] |= (b & 0x7F).astype(np.uint64) << np.uint64(7 * k)
        at[live] += 1
        live = live[b > 0x7F]
        if not len(live):
            return v, at
    raise ValueError("a varint is too long")


def _fields(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tag byte, place, start, end) of the length-delimited fields that a piece consists of."""
    places, tags, starts, ends, at, n = [], [], [], [], 0, len(data)
    while at < n:
        b, size = at + 1, 0
        shift = 0
        while True:
            c = data[b]
            b += 1
            size |= (c & 0x7F) << shift
            if c < 0x80:
                break
            shift += 7
        tags.append(data[at])
        places.append(at)
        starts.append(b)
        at = b + size
        ends.append(at)
    if at != n:
        raise ValueError("a piece ends inside a field")
    return tuple(np.array(a, np.int64) for a in (tags, places, starts, ends))


class Piece:
    """Features, keys and values of a piece as columns: ids, kinds, runs of tags and commands."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        tag, place, start, end = _fields(data)
        if not np.isin(tag, (18, 26, 34)).all():
            raise ValueError("a piece has features, keys and values only")
        self.entries = [[data[a:b] for a, b in zip(place[tag == t].tolist(), end[tag == t].tolist())] for t in (26, 34)]
        at, stop = start[tag == 18], end[tag == 18]
        n = len(at)
        self.n, self.ids, self.has_id, self.kinds = n, np.zeros(n, np.uint64), np.zeros(n, bool), np.zeros(n, np.int64)
        runs = {2: [np.zeros(n, np.int64), np.zeros(n, np.int64)], 4: [np.zeros(n, np.int64), np.zeros(n, np.int64)]}
        live = np.flatnonzero(at < stop)
        while len(live):
            key, p = _read_varints(raw, at[live])
            v, p = _read_varints(raw, p)
            number, wire = (key >> np.uint64(3)).astype(np.int64), key & np.uint64(7)
            if not np.isin(wire, (0, 2)).all():
                raise ValueError("wire type of a feature")
            i = live[number == 1]
            self.ids[i], self.has_id[i] = v[number == 1], True
            self.kinds[live[number == 3]] = v[number == 3].astype(np.int64)
            for k, (a, size) in runs.items():
                a[live[number == k]], size[live[number == k]] = p[number == k], v[number == k].astype(np.int64)
            at[live] = p + np.where(wire == 2, v.astype(np.int64), 0)
            live = live[at[live] < stop[live]]
        self.tags, self.commands = (self._packed(raw, *runs[k]) for k in (2, 4))

    @staticmethod
    def _packed(raw, start, size):
        """(numbers, how many each feature has)."""
        b = raw[_from(start, size)]
        last = b < 0x80
        at = _offsets(size)
        count = _offsets(last.astype(np.int64))
        begins = np.flatnonzero(np.concatenate(([True], last[:-1]))) if len(b) else np.zeros(0, np.int64)
        return (_read_varints(b, begins)[0] if len(b) else np.zeros(0, np.uint64)), count[at[1:]] - count[at[:-1]]

    def faults(self, n_keys: int, n_values: int) -> int:
        """Rules that its features break, by themselves."""
        v, n = self.tags
        at = _offsets(n)
        of = np.repeat(np.arange(self.n), n)
        odd = (np.arange(len(v)) - at[:-1][of]) % 2 == 1
        wild = np.zeros(self.n, bool)
        wild[of[v >= np.where(odd, n_values, n_keys).astype(np.uint64)]] = True
        key_of, key = of[~odd], v[~odd]
        order = np.lexsort((key, key_of))
        same = (key_of[order][1:] == key_of[order][:-1]) & (key[order][1:] == key[order][:-1])
        twice = np.unique(key_of[order][1:][same])
        return int((wild | (n % 2 == 1)).sum()) + len(twice) + int(self._bad_geometry().sum())

    def _bad_geometry(self) -> np.ndarray:
        v, n = self.commands
        at, stop = _offsets(n)[:-1].copy(), _offsets(n)[1:]
        bad = (n == 0) | ~np.isin(self.kinds, (1, 2, 3))
        step = np.zeros(self.n, np.int64)
        live = np.flatnonzero(~bad)
        while len(live):
            op, count = (v[at[live]] & np.uint64(7)).astype(np.int64), (v[at[live]] >> np.uint64(3)).astype(np.int64)
            kind = self.kinds[live]
            turn = np.where(kind == 1, step[live], step[live] % kind)
            move = (op == 1) & ((count == 1) | (kind == 1)) & (count > 0)
            ok = np.where(turn == 0, move, np.where(turn == 1, (op == 2) & (count >= kind - 1) & (kind > 1), (op == 7) & (count == 1)))
            at[live] += 1 + np.where(op == 7, 0, 2 * count)
            step[live] += 1
            bad[live[~ok | (at[live] > stop[live])]] = True
            live = live[~bad[live] & (at[live] < stop[live])]
        whole = np.where(self.kinds == 1, step == 1, step % np.maximum(self.kinds, 1) == 0)
        return bad | ~whole


#: Repeats are looked for in so many parts of a layer, each by itself.
BUCKETS = 32


def _hashes(entries: list[bytes]) -> np.ndarray:
    """64 bits of each entry: short ones are these bits themselves, so that different ones never meet."""
    if not entries:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, entries), np.int64, len(entries))
    out = np.zeros(len(entries), np.uint64)
    raw, at = np.frombuffer(b"".join(entries), np.uint8), _offsets(size)[:-1]
    for k in range(8):
        i = np.flatnonzero(size > k)
        out[i] |= raw[at[i] + k].astype(np.uint64) << np.uint64(8 * k)
    long = np.flatnonzero(size > 8)
    if len(long):
        out[long] = pd.util.hash_array(np.array([entries[i] for i in long.tolist()], object), categorize=False)
    return out


def _checked(batches):
    names, kinds = ["z", "x", "y", "layer", "n_features", "faults", "bucket", "hashes"], (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    for b in batches:
        rows = []
        for z, x, y, layer, n_keys, n_values, data in zip(*(b.column(c).to_pylist() for c in ("z", "x", "y", "layer", "n_keys", "n_values", "data"))):
            p = Piece(data)
            rows.append((z, x, y, layer, p.n, p.faults(n_keys, n_values), None, None))
            for no, h in enumerate((p.ids[p.has_id], *map(_hashes, p.entries))):
                part = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(59)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(BUCKETS + 1))
                rows += [(z, x, y, layer, 0, 0, no * BUCKETS + i, h[order[cut[i] : cut[i + 1]]].tobytes()) for i in range(BUCKETS) if cut[i] < cut[i + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _repeated(key, rows):
    """Whether a number stands twice in a bucket."""
    h = np.concatenate([np.frombuffer(d, np.uint64) for d in rows.column("hashes").to_pylist()])
    columns = [pa.array([v.as_py()], t) for v, t in zip(key, (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32()))]
    return pa.Table.from_arrays([*columns, pa.array([len(np.unique(h)) != len(h)])], names=[*LAYER, "bucket", "repeated"])


def conformance(spark, path: str, extent: int = EXTENT) -> DataFrame:
    """(z, x, y, n_features, violations) of stored pieces: the rules of ``tiles.violations``, for layers of any size.

    Ids, and keys and values of up to eight bytes, are compared as they are, longer ones by a hash of 64 bits.
    """
    from .tiles import read_fields

    base = spark.read.parquet(f"{path}/pieces")

    def counted(batches):
        for b in batches:
            tags = [_fields(d)[0] for d in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in LAYER), *(pa.array([int((t == k).sum()) for t in tags], pa.int64()) for k in (26, 34))], names=[*LAYER, "n_keys", "n_values"])

    # the tables of a layer are as long as its pieces say, not as its features need
    sizes = base.mapInArrow(counted, "z int, x long, y long, layer string, n_keys long, n_values long").groupBy(*LAYER).agg(F.sum("n_keys").alias("n_keys"), F.sum("n_values").alias("n_values"))
    rows = f"{path}/checks"
    base.join(sizes, LAYER).mapInArrow(_checked, "z int, x long, y long, layer string, n_features long, faults long, bucket int, hashes binary").write.parquet(rows)
    rows = spark.read.parquet(rows)
    own = rows.where("bucket is null").groupBy("z", "x", "y").agg(F.sum("n_features").alias("n_features"), F.sum("faults").alias("faults"))
    twice = rows.where("bucket is not null").select(*LAYER, "bucket", "hashes").groupBy(*LAYER, "bucket").applyInArrow(_repeated, "z int, x long, y long, layer string, bucket int, repeated boolean")
    twice = twice.where("repeated").groupBy("z", "x", "y").agg(F.count_distinct("layer", F.floor(F.col("bucket") / BUCKETS)).alias("repeats"))

    @F.pandas_udf("long")
    def framed(name: pd.Series, head: pd.Series, tail: pd.Series, size: pd.Series) -> pd.Series:
        """Faults of the frame: one layer of the stated length, a name, version 2."""
        out = []
        for n, a, b, s in zip(name, head, tail, size):
            inner = field(1, n.encode())
            want = varint(3 << 3 | 2) + varint(len(inner) + int(s) + len(b)) + inner
            out.append(int(bytes(a) != want) + int(not n) + int([v for k, _, v in read_fields(bytes(b)) if k == 15] != [2]))
        return pd.Series(out)

    measured = base.groupBy(*LAYER).agg(F.sum(F.length("data")).alias("size"))
    frames = heads(spark, path, extent).join(measured, LAYER).select("z", "x", "y", framed("layer", "head", "tail", "size").alias("frame")).groupBy("z", "x", "y").agg(F.sum("frame").alias("frame"))
    out = own.join(twice, ["z", "x", "y"], "left").join(frames, ["z", "x", "y"])
    return out.select("z", "x", "y", "n_features", (F.col("faults") + F.col("frame") + F.coalesce("repeats", F.lit(0))).alias("violations"))


def decoded_kinds(pieces: DataFrame) -> DataFrame:
    """(z, x, y, layer, feature_id, type) of all features in pieces."""

    def run(batches):
        names = [*LAYER, "feature_id", "type"]
        for b in batches:
            for i, data in enumerate(b.column("data").to_pylist()):
                p = Piece(data)
                at = pa.array(np.full(p.n, i))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in LAYER), pa.array(p.ids.astype(np.int64)), pa.array(p.kinds, pa.int32())], names=names)

    return pieces.select(*LAYER, "data").mapInArrow(run, "z int, x long, y long, layer string, feature_id long, type int")
