"""Inputs of the registered queries, derived from the driver tables with integer arithmetic."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _placed(df: DataFrame, key: str, *keep: str) -> DataFrame:
    k = F.col(key)
    lon = ((k * 7919) % 3600000) / F.lit(10000.0) - F.lit(180.0)
    lat = ((k * 104729) % 1700000) / F.lit(10000.0) - F.lit(85.0)
    return df.select(k.alias("id"), lon.alias("lon"), lat.alias("lat"), *keep)


def pois(spark, d, *keep):
    return _placed(table(spark, d, "orders"), "o_orderkey", *keep)


def cities(spark, d, *keep):
    return _placed(table(spark, d, "customer"), "c_custkey", *keep)


def centres(spark, d):
    """Query points with a radius of 200 to 1000 km."""
    q = _placed(table(spark, d, "supplier"), "s_suppkey")
    return q.select(F.col("id").alias("q_id"), F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat"), ((F.col("id") % 5 + 1) * 200000.0).alias("metres"))


def work(spark, d):
    return table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("key"), "ts", F.abs(F.floor("value")).cast("long").alias("duration_ms"), (F.col("event_type") == "error").alias("fails"))


def series(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "ts", "value", (F.lit(65.0) - F.col("value")).alias("error"))


def commands(spark, d):
    """The events as a command log: name is the user, errors delete."""
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("SET")
    body = F.to_json(F.struct(op.alias("Operation"), F.col("user_id").cast("string").alias("Name"), F.round("value", 2).cast("decimal(18,2)").cast("string").alias("Value")))
    return table(spark, d, "events").select(F.col("event_id").alias("index"), (F.floor(F.col("event_id") / 1000) + 1).cast("long").alias("term"), body.alias("command"))


def packets(spark, d):
    way = F.when(F.col("event_type") == "click", "request").when(F.col("event_type") == "view", "response")
    return table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 10).alias("target"), F.col("user_id").cast("string").alias("src"), way.alias("direction")).where(F.col("direction").isNotNull())


def tracks(spark, d):
    """Lines: the positions of an order's items, in their order."""
    i = _placed(table(spark, d, "lineitem").withColumn("k", F.col("l_partkey") + F.col("l_linenumber")), "k", "l_orderkey", "l_linenumber")
    one = i.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "lon", "lat"))).alias("v"))
    return one.select("l_orderkey", F.transform("v", lambda p: p["lon"]).alias("lons"), F.transform("v", lambda p: p["lat"]).alias("lats"))


def documents_geojson(spark, d):
    """A feature for each customer, as text."""
    c = cities(spark, d, "c_name", "c_acctbal", "c_nationkey")
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    props = F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") > 0).alias("solvent"))
    return c.select(F.col("id").alias("doc_id"), F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("doc"))


def documents_kml(spark, d):
    """A KML document with a shared style for each customer."""
    c = cities(spark, d, "c_name")
    head = '<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Style id="a"><LineStyle><color>80112233</color><width>2</width></LineStyle></Style><Folder><Placemark><name>'
    at = F.concat(F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit(",0"))
    tail = "</coordinates></Point></Placemark></Folder></Document></kml>"
    return c.select(F.col("id").alias("doc_id"), F.concat(F.lit(head), "c_name", F.lit("</name><styleUrl>#a</styleUrl><Point><coordinates>"), at, F.lit(tail)).alias("doc"))


def documents_collections(spark, d):
    """A feature collection for each order: its positions as points, as a line and as a closed ring."""
    t = tracks(spark, d).withColumn("ps", F.zip_with("lons", "lats", lambda a, b: F.array(a, b)))
    shape = lambda kind, c: F.concat(F.lit('{"type":"' + kind + '","coordinates":'), c, F.lit("}"))
    ring = F.concat(F.lit("["), F.to_json(F.concat("ps", F.slice("ps", 1, 1))), F.lit("]"))
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":null,"geometry":{"type":"GeometryCollection","geometries":['), shape("MultiPoint", F.to_json("ps")), F.lit(","), shape("LineString", F.to_json("ps")), F.lit("]}},"), F.lit('{"type":"Feature","properties":{},"geometry":'), shape("Polygon", ring), F.lit("}]}"))
    return t.select(F.col("l_orderkey").alias("doc_id"), whole.alias("doc"))


def _sql_placed(table: str, key: str, *keep: str) -> str:
    more = "".join(f", {k}" for k in keep)
    return f"SELECT {key} AS id, (({key} * 7919) % 3600000) / 10000.0::DOUBLE - 180.0::DOUBLE AS lon, (({key} * 104729) % 1700000) / 10000.0::DOUBLE - 85.0::DOUBLE AS lat{more} FROM {table}"


SQL_POIS = _sql_placed("orders", "o_orderkey", "o_orderpriority")
SQL_CITIES = _sql_placed("customer", "c_custkey", "c_name", "c_acctbal", "c_nationkey", "c_mktsegment")
SQL_CENTRES = f"SELECT id AS q_id, lon AS q_lon, lat AS q_lat, (id % 5 + 1) * 200000.0::DOUBLE AS metres FROM ({_sql_placed('supplier', 's_suppkey')})"
