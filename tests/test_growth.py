"""Work that must not grow faster than the input, nor lie in one task."""
import math
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tesseral.functions.geodesy import RADIUS, haversine_m
from tesseral.operators import geojson, spatial


def test_join_at_borders(spark):
    """Poles, date line, radius zero, negative and half the world: the pairs of a plain comparison."""
    r = random.Random(3)
    edge = [(180.0, 0.0), (-180.0, 0.0), (179.999, 89.9), (-179.999, -89.9), (0.0, 90.0), (0.0, -90.0), (9.0, 9.0), (-9.0, 0.0)]
    points = edge + [(r.uniform(-180, 180), r.choice([r.uniform(-90, 90), r.uniform(85, 90)])) for _ in range(300)]
    centres = [(*p, m) for p in edge for m in (0.0, -1.0, 300_000.0, 1_000_000.0)] + [(*points[-1 - i], r.uniform(0, 1_000_000)) for i in range(40)]
    ps = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, lon double, lat double")
    for most, scale in ((1_000_000.0, 1.0), (math.pi * RADIUS, 20.0)):
        qs = spark.createDataFrame([(i, a, b, m * scale) for i, (a, b, m) in enumerate(centres)], "q_id long, q_lon double, q_lat double, metres double")
        got = spatial.within_join(ps, qs, most)
        assert got.columns == ["id", "lon", "lat", "q_id", "q_lon", "q_lat", "metres", "dist_m"]
        plain = ps.crossJoin(qs).where(haversine_m(F.col("q_lon"), F.col("q_lat"), F.col("lon"), F.col("lat")) <= F.col("metres"))
        assert sorted(map(tuple, got.select("q_id", "id").collect())) == sorted(map(tuple, plain.select("q_id", "id").collect()))


def test_join_tries_few_pairs(spark, sf):
    """Cells a quarter of the largest radius wide: at most four pairs are tried for one that is found (cells as wide as it: some ten)."""
    r = random.Random(4)
    place = lambda n: [(i, r.uniform(-180, 180), r.uniform(-70, 70)) for i in range(n)]
    ps = spark.createDataFrame(place(3000), "id long, lon double, lat double")
    qs = spark.createDataFrame([(*q, 1_000_000.0) for q in place(60)], "q_id long, q_lon double, q_lat double, metres double")
    tried = spatial.within_join(ps, qs, 1_000_000.0)
    plan = tried._jdf.queryExecution().optimizedPlan()
    nodes, joins = [plan], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Join":
            joins.append(node)
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    left, right = joins[0].children().apply(0), joins[0].children().apply(1)
    keys = ["_cell"] if "_cell" in left.output().mkString(",") else ["cx", "cy"]
    of = lambda p: spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, p)
    count = lambda p: {tuple(x[k] for k in keys): x["n"] for x in type(tried)(of(p), spark).groupBy(*keys).agg(F.count("*").alias("n")).collect()}
    a, b = count(left), count(right)
    assert sum(n * b.get(c, 0) for c, n in a.items()) <= 4 * tried.count()


def test_lateral_ranges_are_dealt(spark, sf):
    """The circles come from one small file, which would be one task."""
    tasks = entry.queries()["hilbert_ranges_lateral"](spark, sf).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_feed_files_are_not_tiny(spark, sf):
    """Files are made, listed and opened one by one: there are far fewer of them than features."""
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert len(entry.queries()["quake_feed"](spark, sf).inputFiles()) <= 1 + events // 1000


def test_flatten_columns(spark):
    """Rows built as flat columns: parts, rings, holes and attributes of mixed documents, and documents without any."""
    poly = '{"type":"Feature","properties":{"a":1,"b":"x","c":null,"d":true,"e":0.5},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4.5,0],[4,4],[0,0]],[[1,1],[2,1.5,9],[2,2],[1,1]],[[1,1]]]}}'
    multi = '{"type":"MultiLineString","coordinates":[[[0.5,1.5],["x",1],[2,true],[3,4]],[[1.0,2.0]]]}'
    df = spark.createDataFrame([(1, poly), (2, multi), (3, None), (4, "{"), (5, '{"type":"Point","coordinates":[1.5,2]}')], "doc_id int, doc string").repartition(1)
    pairs = lambda rings: [[tuple(p) for p in ring] for ring in rings]
    got = sorted((x.doc_id, x.pos, x.type, pairs(x.rings), list(map(tuple, x.props))) for x in geojson.flatten(df).collect())
    tags = [("a", "i", "1"), ("b", "s", "x"), ("d", "b", "true"), ("e", "d", "0.5")]
    assert got == [
        (1, 0, "Polygon", [[(0.0, 0.0), (4.5, 0.0), (4.0, 4.0)], [(1.0, 1.0), (2.0, 1.5), (2.0, 2.0)]], tags),
        (2, 0, "LineString", [[(0.5, 1.5), (3.0, 4.0)]], []),
        (5, 0, "Point", [[(1.5, 2.0)]], []),
    ]


def test_flatten_makes_no_object_of_a_position():
    """A batch of rows is nested columns over one array of numbers."""
    b = geojson._as_batch([(1, 0, "Point", [[(1.0, 2.0)]], []), (1, 1, "LineString", [[(3.0, 4.0), (5.0, 6.0)]], [("k", "s", "v")])])
    assert b.column("rings").flatten().flatten().field(1).to_pylist() == [2.0, 4.0, 6.0] and b.num_rows == 2
    assert geojson._as_batch([]).num_rows == 0
