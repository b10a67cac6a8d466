"""GeoJSON documents to feature rows: one row for each point, line or polygon that is drawn."""
from __future__ import annotations

import json
import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = "doc_id long, pos int, type string, rings array<array<struct<lng:double,lat:double>>>, props array<struct<key:string,kind:string,value:string>>"


class Invalid(ValueError):
    """A document or feature that breaks the format."""


def _position(p, strict: bool):
    ok = isinstance(p, list) and len(p) >= 2 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in p[:2])
    if ok:
        return float(p[0]), float(p[1])
    if strict:
        raise Invalid("a position needs two numbers")
    return None


def _positions(a, strict: bool):
    if not isinstance(a, list):
        raise Invalid("coordinates must be an array")
    plain = [(p[0], p[1]) for p in a if type(p) is list and len(p) >= 2 and type(p[0]) is float and type(p[1]) is float]
    return plain if len(plain) == len(a) else [q for q in (_position(p, strict) for p in a) if q is not None]


def _line(a, strict: bool):
    ps = _positions(a, strict)
    if len(ps) < 2:
        if strict:
            raise Invalid("a line needs two positions")
        return None
    return [ps]


def _open(ring):
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def _polygon(a, strict: bool):
    if not isinstance(a, list):
        raise Invalid("coordinates must be an array")
    rings = [_open(_positions(r, strict)) for r in a]
    if not rings or len(rings[0]) < 3:
        if strict:
            raise Invalid("a polygon needs an exterior of three positions")
        return None
    return [rings[0], *(r for r in rings[1:] if len(r) >= 3)]


def _parts(g, strict: bool):
    """(type, rings) of every simple geometry in g."""
    if not isinstance(g, dict) or not isinstance(g.get("type"), str):
        raise Invalid("a geometry needs a type")
    kind = g["type"]
    if kind == "GeometryCollection":
        if not isinstance(g.get("geometries"), list):
            raise Invalid("a collection needs geometries")
        for inner in g["geometries"]:
            yield from _parts(inner, strict)
        return
    simple = {"Point": "Point", "MultiPoint": "Point", "LineString": "LineString", "MultiLineString": "LineString", "Polygon": "Polygon", "MultiPolygon": "Polygon"}.get(kind)
    if simple is None:
        raise Invalid(f"unknown geometry {kind}")
    c = g.get("coordinates")
    if not isinstance(c, list):
        raise Invalid("a geometry needs coordinates")
    for one in c if kind.startswith("Multi") else [c]:
        if simple == "Point":
            p = _position(one, strict)
            rings = None if p is None else [[p]]
        else:
            rings = (_line if simple == "LineString" else _polygon)(one, strict)
        if rings:
            yield simple, rings


def properties(p) -> list[tuple[str, str, str]]:
    """Scalars as (key, kind, text): s, b, i (64-bit integers) or d; the last of equal keys counts."""
    out = []
    for k, v in (p if isinstance(p, dict) else {}).items():
        if isinstance(v, bool):
            out.append((k, "b", "true" if v else "false"))
        elif isinstance(v, str):
            out.append((k, "s", v))
        elif isinstance(v, int) and -(1 << 63) <= v < 1 << 63:
            out.append((k, "i", str(v)))
        elif isinstance(v, (int, float)) and not math.isnan(float(v)):
            out.append((k, "d", repr(float(v))))
    return out


def _feature(f, strict: bool, out: list) -> None:
    if not isinstance(f, dict) or "geometry" not in f:
        raise Invalid("a feature needs a geometry")
    if f["geometry"] is None:
        return
    tags = properties(f.get("properties"))
    for kind, rings in _parts(f["geometry"], strict):
        out.append((kind, rings, tags))


def read_document(text: str, strict: bool = False) -> list[tuple]:
    """(type, rings, properties) rows.  Lenient: what is malformed is left out, what came before stays."""
    out: list[tuple] = []
    try:
        doc = json.loads(text)
        if not isinstance(doc, dict) or not isinstance(doc.get("type"), str):
            raise Invalid("the root needs a type")
        if doc["type"] == "FeatureCollection":
            if not isinstance(doc.get("features"), list):
                raise Invalid("a collection needs features")
            for f in doc["features"]:
                try:
                    _feature(f, strict, out)
                except Invalid:
                    if strict:
                        raise
        elif doc["type"] == "Feature":
            _feature(doc, strict, out)
        else:
            out += [(k, r, []) for k, r in _parts(doc, strict)]
    except ValueError:  # also of malformed JSON
        if strict:
            raise
    return out


#: Positions of one batch of rows at most, besides the document that passes it.
POSITIONS = 500_000


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    """FEATURES of (doc_id, pos, type, rings, properties) rows: columns of flat values and offsets, no object for a position."""
    offsets = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    ids, pos, kinds, shapes, props = zip(*rows) if rows else [()] * 5
    rings = [r for s in shapes for r in s]
    flat = np.fromiter(chain.from_iterable(chain.from_iterable(rings)), float)
    points = pa.StructArray.from_arrays([pa.array(flat[0::2]), pa.array(flat[1::2])], names=["lng", "lat"])
    tags = list(chain.from_iterable(props))
    tags = pa.StructArray.from_arrays([pa.array([t[i] for t in tags], pa.string()) for i in range(3)], names=["key", "kind", "value"])
    nested = pa.ListArray.from_arrays(offsets(map(len, shapes)), pa.ListArray.from_arrays(offsets(map(len, rings)), points))
    columns = [pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(kinds, pa.string()), nested, pa.ListArray.from_arrays(offsets(map(len, props)), tags)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "pos", "type", "rings", "props"])


def flatten(docs: DataFrame, strict: bool = False) -> DataFrame:
    """FEATURES rows of documents (doc_id, doc); ``pos`` is the place in its document."""

    def run(batches):
        for b in batches:
            rows, held = [], 0
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("doc").to_pylist()):
                for pos, (kind, rings, tags) in enumerate(read_document(text or "", strict)):
                    rows.append((i, pos, kind, rings, tags))
                    held += sum(map(len, rings))
                if held > POSITIONS:
                    yield _as_batch(rows)
                    rows, held = [], 0
            yield _as_batch(rows)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "doc").mapInArrow(run, FEATURES)


def having(features: DataFrame, kind: str | None = None, has: str | None = None, lacks: str | None = None) -> DataFrame:
    """Features of one geometry type, with one property and without another."""
    held = lambda k: F.exists("props", lambda p: p["key"] == k)
    for test in ((F.col("type") == kind) if kind else None, held(has) if has else None, ~held(lacks) if lacks else None):
        features = features if test is None else features.where(test)
    return features


def bounding_box(features: DataFrame) -> DataFrame:
    """min_lng, max_lng, min_lat, max_lat of each document: a combining aggregate over vertices."""
    v = features.select("doc_id", F.explode(F.flatten("rings")).alias("p"))
    return v.groupBy("doc_id").agg(F.min("p.lng").alias("min_lng"), F.max("p.lng").alias("max_lng"), F.min("p.lat").alias("min_lat"), F.max("p.lat").alias("max_lat"))


def feature_count(doc):
    """Features of a collection column, 1 for any other typed object, else 0."""
    v = F.try_parse_json(doc)
    kind = F.try_variant_get(v, "$.type", "string")
    n = F.size(F.try_variant_get(v, "$.features", "array<variant>"))
    return F.when(kind == "FeatureCollection", F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))).when(kind.isNotNull(), F.lit(1)).otherwise(F.lit(0))
