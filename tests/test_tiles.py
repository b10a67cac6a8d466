"""Tile geometry and bytes."""
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.functions.numbers import unzigzag, zigzag
from tesseral.operators import clip, geojson, geometry, tiles
from tesseral.operators.geometry import Encoder, area2, clip_line, clip_ring, decode_commands, encode_parts, orient
from tesseral.sources import kml


def test_command_vectors():
    assert encode_parts(2, [[(2, 2), (2, 10), (10, 10)]]) == [9, 4, 4, 18, 0, 16, 16, 0]
    assert encode_parts(2, [[(2, 2), (2, 10), (10, 10)], [(1, 1), (3, 5)]]) == [9, 4, 4, 18, 0, 16, 16, 0, 9, 17, 17, 10, 4, 8]
    assert encode_parts(3, [[(3, 6), (8, 12), (20, 34)]]) == [9, 6, 12, 18, 10, 12, 24, 44, 15]
    assert Encoder().points([(5, 7), (3, 2)]).out == [17, 10, 14, 3, 9]
    assert decode_commands([17, 10, 14, 3, 9]) == [[(5, 7)], [(3, 2)]]


def test_commands_round_trip():
    rings = [[(0, 0), (100, 0), (100, 100), (0, 100)], [(10, 10), (10, 20), (20, 20), (20, 10)]]
    assert decode_commands(encode_parts(3, rings)) == rings


def test_clip_line():
    assert clip_line([(0, 0), (100, 100)]) == [[(0, 0), (100, 100)]]
    assert clip_line([(-9000, -9000), (-8000, -9000)]) == []
    assert clip_line([(5, 5), (5, 5)]) == []
    out = clip_line([(100, 100), (100, -1000), (200, -1000), (200, 100)])
    assert out == [[(100, 100), (100, -205)], [(200, -205), (200, 100)]]


def test_hidden_segment_ends_a_part():
    assert clip_line([(0, 0), (5000, 0), (6000, 0), (0, 0)]) == [[(0, 0), (4301, 0)], [(4301, 0), (0, 0)]]
    assert clip_line([(0, 0), (10, 0), (10, 0), (20, 0)]) == [[(0, 0), (10, 0), (20, 0)]]


def _flat(shapes):
    flat = [p for s in shapes for p in s]
    return np.array([p[0] for p in flat], float), np.array([p[1] for p in flat], float), np.cumsum([0] + [len(s) for s in shapes])


def _nested(x, y, part, of=None):
    out = [list(zip(x[a:b].tolist(), y[a:b].tolist())) for a, b in zip(part[:-1], part[1:])]
    return out if of is None else [out[a:b] for a, b in zip(of[:-1], of[1:])]


def test_columns_clip_as_single_shapes():
    r = random.Random(4)
    far = lambda: r.choice([r.randrange(-300, 4400), r.randrange(-9000, 13000), r.choice([-205, -204, 4300, 4301, 0])])
    shapes = [[(far(), far()) for _ in range(r.randrange(0, 12))] for _ in range(3000)]
    shapes += [s + s[:1] for s in shapes[:500]] + [[p for p in s for _ in range(2)] for s in shapes[:300]]
    x, y, off = _flat(shapes)
    assert _nested(*clip.clip_lines(x, y, off)) == [clip_line(s) for s in shapes]
    cut = clip.clip_rings(x, y, off)
    want = [clip_ring(s) if s else [] for s in shapes]
    assert _nested(*cut) == want
    hole = np.arange(len(shapes)) % 3 == 1
    turned = [orient(s, h) if s else [] for s, h in zip(want, hole)]
    assert _nested(*clip.orient_rings(*cut, hole)) == turned
    polygon = np.array([*range(0, len(shapes), 3), len(shapes)])
    got = clip.whole_polygons(*clip.orient_rings(*cut, hole), polygon)
    kept = [[s for s in turned[a:b] if s] if turned[a] else [] for a, b in zip(polygon[:-1], polygon[1:])]
    assert _nested(*got) == kept
    values, at = clip.commands(*got, closed=True)
    assert [values[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [encode_parts(geometry.POLYGON_TYPE, p) for p in kept]
    got = clip.clip_lines(x, y, off)
    values, at = clip.commands(*got, closed=False)
    assert [values[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [encode_parts(geometry.LINE_TYPE, clip_line(s)) for s in shapes]


def test_shapes_in_tiles(spark):
    """Bytes of lines and of polygons with holes hold what each tile clips of them one by one."""
    r = random.Random(9)
    ring = lambda n, lng, lat, w: [(lng + r.uniform(-w, w), lat + r.uniform(-w, w)) for _ in range(n)]
    rows = []
    for i in range(40):
        lng, lat, w = r.uniform(-170, 170), r.uniform(-75, 75), r.choice([0.01, 5, 40])
        rows.append((i, 2, [ring(r.randrange(1, 8), lng, lat, w)]) if i % 2 else (i, 3, [ring(r.randrange(2, 7), lng, lat, w) for _ in range(r.randrange(1, 4))]))
    rows += [(100, 2, [[]]), (101, 3, []), (102, 3, None), (103, 2, [[(0.0, -90.0), (10.0, 90.0)]])]
    df = spark.createDataFrame(rows, "id long, type int, rings array<array<struct<lng:double,lat:double>>>")
    for zoom in (0, 2):
        got = {(x["id"], x["x"], x["y"]): x["commands"] for x in tiles.tile_shapes(df, zoom).collect()}
        want = {}
        for i, kind, rings in rows[:-1]:
            for x in range(1 << zoom):
                for y in range(1 << zoom):
                    if not rings or not rings[0]:
                        continue
                    parts = geometry.line_in_tile(*zip(*rings[0]), zoom, x, y) if kind == 2 else geometry.rings_in_tile(rings, zoom, x, y)
                    if parts:
                        want[i, x, y] = encode_parts(kind, parts)
        assert {k: v for k, v in got.items() if k[0] != 103} == want
    full = tiles.tile_shapes(df, 2).selectExpr("z", "x", "y", "'shapes' AS layer", "id AS pos", "type", "commands", "cast(null as array<struct<key:string,kind:string,value:string>>) AS tags", "id AS explicit_id")
    data = tiles.encode_tiles(full)
    assert all(x["violations"] == 0 for x in tiles.conformance(data).collect())
    seen = {(f["id"], t["x"], t["y"]): list(f["commands"]) for t in data.collect() for layer in tiles.decode_tile(bytes(t["data"])) for f in layer["features"]}
    assert seen == {k: list(v) for k, v in got.items()}


def test_clip_ring_and_orient():
    big = [(-9e4, -9e4), (9e4, -9e4), (9e4, 9e4), (-9e4, 9e4)]
    ring = clip_ring(big)
    assert sorted(ring) == [(-205, -205), (-205, 4301), (4301, -205), (4301, 4301)]
    assert area2(orient(ring)) > 0 > area2(orient(ring, hole=True))
    assert clip_ring([(9000, 9000), (9100, 9000), (9100, 9100)]) == [] and orient([(0, 0), (1, 1), (2, 2)]) == []


def test_bad_hole_drops_alone():
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    assert len(geometry.rings_in_tile([square(-40, 40), square(-10, 10)], 0, 0, 0)) == 2
    assert len(geometry.rings_in_tile([square(-40, 40), [(0, 0), (1, 1)]], 0, 0, 0)) == 1
    assert geometry.rings_in_tile([[(0, 0), (1, 1)], square(-10, 10)], 0, 0, 0) == []


def test_layer_bytes():
    assert tiles.build_tile([]) == b""
    empty = tiles.decode_tile(tiles.build_tile([tiles.Layer("none")]))
    assert empty == [{"name": "none", "extent": 4096, "version": 2, "features": []}]
    a = tiles.Layer("a")
    a.add(1, [9, 50, 34], [("x", "i", 7), ("y", "s", "é"), ("z", "b", True), ("n", "s", None)])
    a.add(1, [9, 50, 34], [("x", "i", 7), ("y", "d", 7.0), ("z", "f", 0.5)], explicit_id=(1 << 64) - 1)
    a.add(1, [9, 2, 2], [("x", "i", -3), ("y", "u", (1 << 64) - 1)])
    (layer,) = tiles.decode_tile(a.build())
    assert [f["id"] for f in layer["features"]] == [1, (1 << 64) - 1, 2]
    assert layer["features"][0]["tags"] == {"x": 7, "y": "é", "z": True}
    assert layer["features"][1]["tags"] == {"x": 7, "y": 7.0, "z": 0.5} and layer["features"][2]["tags"] == {"x": -3, "y": (1 << 64) - 1}
    assert len(a.tables) == 7


def test_float_keys():
    a = tiles.Layer("a")
    a.add(1, [9, 0, 0], [("k", "d", 0.0), ("k", "d", -0.0), ("k", "d", math.nan), ("k", "d", float("nan"))])
    assert len(a.tables) == 2 and struct.unpack("<d", a.tables[0][1:])[0] == 0.0


def test_unsupported_kind_leaves_no_key():
    a = tiles.Layer("a")
    with pytest.raises(ValueError):
        a.add(1, [9, 0, 0], [("fine", "i", 1), ("span", "timespan", 3)])
    assert not a.keys and a.next_id == 1


def test_zigzag_columns(spark):
    rows = spark.createDataFrame([(v,) for v in (0, -1, 1, -2, 2147483647, -2147483648)], "v long").select("v", zigzag(F.col("v")).alias("z")).withColumn("b", unzigzag(F.col("z"))).collect()
    assert [r["z"] for r in rows] == [0, 1, 2, 3, 4294967294, 4294967295] and all(r["b"] == r["v"] for r in rows)


def test_tiles_round_trip(spark, sf):
    from tesseral.plans import queries

    a = queries.tile_decode_roundtrip(spark, sf).count()
    assert a == queries.tile_points(spark, sf).count() > 0


def test_violations():
    a = tiles.Layer("a")
    a.add(1, [9, 50, 34], [("x", "i", 7)])
    a.add(2, encode_parts(2, [[(2, 2), (2, 10)]]), [])
    a.add(3, encode_parts(3, [[(0, 0), (9, 0), (9, 9)]]), [])
    assert tiles.violations(a.build()) == [] == tiles.violations(b"")
    assert tiles.violations(a.build() + a.build()) == ["repeated layer name"]
    b = tiles.Layer("b")
    b.add(1, [9, 50], [])
    b.add(2, [9, 0, 0], [], explicit_id=1)
    b.add(3, [9, 0, 0, 10, 1, 1, 15], [])
    b.add(9, [9, 0, 0], [])
    found = tiles.violations(b.build())
    assert len(found) == 5 and "repeated feature id" in found and "parameters are missing" in found


def test_tile_store(spark, sf, tmp_path):
    from tesseral.plans import queries

    t = queries._tile_table(spark, sf)
    tiles.save_tiles(t, str(tmp_path / "t"))
    back = tiles.load_tiles(spark, str(tmp_path / "t"))
    assert {(r["z"], r["x"], r["y"], bytes(r["data"])) for r in back.collect()} == {(r["z"], r["x"], r["y"], bytes(r["data"])) for r in t.collect()}


def test_geojson():
    doc = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"MultiPoint","coordinates":[[1,2],[3,4,5]]},"properties":{"a":9007199254740993,"b":1.5,"c":null,"d":{"x":1},"e":"t","f":false}},{"type":"Feature","geometry":null},{"type":"Feature"},{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]],[[0,0],[1,1]]]}},{"type":"Feature","geometry":{"type":"GeometryCollection","geometries":[{"type":"LineString","coordinates":[[0,0],[1,1]]},{"type":"Point","coordinates":["x",1]}]}}]}'
    rows = geojson.read_document(doc)
    assert [r[0] for r in rows] == ["Point", "Point", "Polygon", "LineString"]
    assert rows[0][2] == [("a", "i", "9007199254740993"), ("b", "d", "1.5"), ("e", "s", "t"), ("f", "b", "false")]
    assert rows[2][1] == [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]
    for bad in ("{", "[]", '{"type":"Nope"}', '{"type":"Feature"}', '{"type":"Point","coordinates":[1]}'):
        assert geojson.read_document(bad) == []
        with pytest.raises(ValueError):
            geojson.read_document(bad, strict=True)


def test_kml():
    doc = """<kml xmlns="http://www.opengis.net/kml/2.2"><Document>
    <Style id="a"><LineStyle><color>7f0000ff</color><width>3</width></LineStyle></Style>
    <StyleMap id="m"><Pair><key>normal</key><styleUrl>#a</styleUrl></Pair><Pair><key>highlight</key><styleUrl>#b</styleUrl></Pair></StyleMap>
    <Folder><Folder><Placemark><name>line</name><styleUrl>#m</styleUrl><LineString><coordinates>1,2,0 3,4,0</coordinates></LineString></Placemark></Folder></Folder>
    <Placemark><MultiGeometry><Point><coordinates>5,6</coordinates></Point><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></MultiGeometry></Placemark></Document></kml>"""
    rows = kml.read_document(doc)
    assert [r["type"] for r in rows] == ["LineString", "Point", "Polygon"]
    assert rows[0]["line_color"] == "#ff00007f" and rows[0]["line_width"] == 3 and rows[1]["icon_scale"] == 1.0
    assert rows[2]["rings"] == [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]]


def test_tile_addresses_are_checked(spark):
    at = lambda z, x, y: spark.range(1).select(tiles.checked_tile(F.lit(z), F.lit(x), F.lit(y)).alias("ok")).first()["ok"]
    assert at(0, 0, 0) and at(30, (1 << 30) - 1, 0)
    for bad in ((-1, 0, 0), (31, 0, 0), (2, 4, 0), (2, 0, -1)):
        with pytest.raises(Exception, match="z must be"):
            at(*bad)
    with pytest.raises(ValueError):
        tiles.checked_tile(F.lit(0), F.lit(0), F.lit(0), 0)


def test_attributes_of_all_types(spark):
    df = spark.sql("SELECT 'a' AS s, true AS b, 1.5F AS f, 2.5D AS d, 7 AS i, 1.25BD AS m, DATE'2024-02-03' AS day, TIMESTAMP_NTZ'2024-02-03 04:05:06.25' AS ntz, TIMESTAMP'2024-02-03 04:05:06' AS ts, array(1) AS x")
    row = df.select(*[tiles.attribute(df, c).alias(c) for c in df.columns if c != "x"]).first()
    got = {c: (row[c]["kind"], row[c]["value"]) for c in row.asDict()}
    assert got == {"s": ("s", "a"), "b": ("b", "true"), "f": ("f", "1.5"), "d": ("d", "2.5"), "i": ("i", "7"), "m": ("d", "1.25"), "day": ("s", "2024-02-03T00:00:00.0000000"), "ntz": ("s", "2024-02-03T04:05:06.2500000"), "ts": ("s", "2024-02-03T04:05:06.0000000+00:00")}
    with pytest.raises(ValueError):
        tiles.attribute(df, "x")
