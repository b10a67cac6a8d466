"""Curve, ranges, geohash, geodesy: inverses, exact covers, golden values."""
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesseral.functions import curve, geodesy, geohash, projection
from tesseral.operators import spatial
from tesseral.plans import ranges


@given(st.integers(1, 30), st.data())
@settings(max_examples=200, deadline=None)
def test_curve_inverse(order, data):
    x, y = data.draw(st.integers(0, 2**order - 1)), data.draw(st.integers(0, 2**order - 1))
    assert curve.decode_value(curve.encode_value(x, y, order), order) == (x, y)


def test_curve_steps_have_length_one():
    path = [curve.decode_value(d, 4) for d in range(256)]
    assert len(set(path)) == 256
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:]))


def test_order_is_bounded():
    with pytest.raises(ValueError):
        curve.check_order(31)


def test_columns_agree_with_values(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 65536).alias("x"), (F.col("id") * 104729 % 65536).alias("y"))
    rows = df.withColumn("d", curve.encode(F.col("x"), F.col("y"), 16)).withColumn("c", curve.decode(F.col("d"), 16)).collect()
    assert all(r["d"] == curve.encode_value(r["x"], r["y"], 16) and (r["c"]["x"], r["c"]["y"]) == (r["x"], r["y"]) for r in rows)


@given(st.integers(0, 15), st.integers(0, 15), st.integers(0, 15), st.integers(0, 15))
@settings(max_examples=200, deadline=None)
def test_ranges_cover_exactly(a, b, c, d):
    box = ranges.Box(min(a, b), min(c, d), max(a, b), max(c, d))
    want = {curve.encode_value(x, y, 4) for x in range(box.x0, box.x1 + 1) for y in range(box.y0, box.y1 + 1)}
    assert {k for lo, hi in ranges.box_ranges(box, 4, 0) for k in range(lo, hi + 1)} == want
    few = ranges.box_ranges(box, 4, 3)
    assert len(few) <= 3 and want <= {k for lo, hi in few for k in range(lo, hi + 1)}


def test_boxes_wrap_and_clip():
    assert ranges.wrapped(ranges.Box(-2, -5, 1, 3), 4) == [ranges.Box(14, 0, 15, 3), ranges.Box(0, 0, 1, 3)]
    assert ranges.wrapped(ranges.Box(0, 20, 3, 25), 4) == []
    assert ranges.wrapped(ranges.Box(-1, 0, 15, 0), 4) == [ranges.Box(0, 0, 15, 0)]


def test_hit_and_miss():
    lon, lat = 18.0, 57.0
    north = 57.0 + math.degrees(1000 / geodesy.RADIUS)
    key = ranges.key_of_value(lon, lat, 19)
    inside = lambda m: any(a <= key <= b for a, b in ranges.radius_ranges(lon, north, m, 19))
    assert inside(1001) and not inside(900)


@pytest.mark.parametrize("lon,lat,metres", [(18.0, 57.0, 500e3), (179.9, 10.0, 300e3), (-179.9, -10.0, 300e3), (0.0, 89.0, 500e3), (30.0, -88.5, 900e3), (0.0, 0.0, 0.0)])
def test_within_is_brute_force(spark, lon, lat, metres):
    r = random.Random(5)
    pts = [(i, r.uniform(-180, 180), math.degrees(math.asin(r.uniform(-1, 1)))) for i in range(3000)] + [(9000 + i, max(-180.0, min(180.0, lon + r.uniform(-9, 9))), max(-90.0, min(90.0, lat + r.uniform(-4, 4)))) for i in range(500)]
    df = spark.createDataFrame(pts, "id long, lon double, lat double")
    got = {x["id"] for x in spatial.within(spatial.with_key(df), lon, lat, metres).collect()}
    want = {x["id"] for x in df.where(spatial.distance(lon, lat) <= metres).collect()}
    assert got == want


def test_within_join_is_brute_force(spark):
    r = random.Random(6)
    pts = spark.createDataFrame([(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(3000)], "id long, lon double, lat double")
    qs = spark.createDataFrame([(0, 179.5, 5.0, 9e5), (1, -179.5, 80.0, 9e5), (2, 10.0, -89.0, 5e5), (3, 20.0, 50.0, 1e6)], "q_id long, q_lon double, q_lat double, metres double")
    got = {(x["q_id"], x["id"]) for x in spatial.within_join(pts, qs, 1e6).collect()}
    all_ = pts.crossJoin(qs).where(geodesy.haversine_m(F.col("q_lon"), F.col("q_lat"), F.col("lon"), F.col("lat")) <= F.col("metres"))
    assert got == {(x["q_id"], x["id"]) for x in all_.collect()}


def test_nearest_box_holds_the_nearest_of_the_fixture(spark):
    df = spatial.with_key(spark.createDataFrame([(1, 18.0, 57.0), (2, 18.2, 57.0), (3, 18.5, 57.0)], "id long, lon double, lat double"))
    for lon, lat, want in ((18.0001, 57.0001, 1), (18.2001, 57.0001, 2), (18.5001, 57.0001, 3), (18.0, 57.0, 1), (18.5, 57.0, 3)):
        assert spatial.nearest_box(df, lon, lat).orderBy("dist_m").first()["id"] == want
    assert spatial.nearest_box(df.limit(0), 18.0, 57.0).count() == 0


def test_geohash_golden(spark):
    one = spark.range(1)
    enc = lambda lat, lon: one.select(geohash.encode(F.lit(lon), F.lit(lat), 5)).first()[0]
    assert enc(59.3281936, 18.0440866) == "u6scd" and enc(51.5074, -0.1278) == "gcpvj"
    b = one.select(geohash.decode(F.lit("u6scd")).alias("b")).first()["b"]
    assert b["south"] <= 59.3281936 <= b["north"] and b["west"] <= 18.0440866 <= b["east"]
    with pytest.raises(Exception, match="not a geohash"):
        one.select(geohash.decode(F.lit("u6sc!"))).collect()
    for bad in (0, 13):
        with pytest.raises(ValueError):
            geohash.check_precision(bad)
    assert [geohash.precision_value(z) for z in (0, 3, 4, 6, 7, 9, 11, 12, 14, 17)] == [1, 1, 2, 2, 3, 4, 4, 5, 6, 7]


def test_mercator_rejects_nan(spark):
    x, y = projection.MERCATOR.to_grid(F.lit(float("nan")), F.lit(1.0), 10)
    with pytest.raises(Exception, match="not a number"):
        spark.range(1).select(x, y).collect()


def test_pushdown_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "points")
    pts = spark.range(2000).select("id", (F.col("id") * 7.3 % 360 - 180).alias("lon"), (F.col("id") * 3.1 % 170 - 85).alias("lat"))
    spatial.write_index(pts, path, 4)
    plan = spatial.within(spark.read.parquet(path), 18.0, 57.0, 1e5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(hid" in plan
