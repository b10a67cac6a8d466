"""Readers of the small text formats: city lists, earthquake feeds, GeoJSON files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CITY_SCHEMA = "name string, lat double, lng double, population long, country string"


def city_rows(lines: DataFrame) -> DataFrame:
    """Cities of text lines (column value): plain commas, five fields or more, blanks trimmed."""
    parts = F.split("value", ",")
    t = lines.select(parts.alias("f")).where(F.size("f") >= 5)
    at = lambda i: F.trim(F.col("f")[i])
    return t.select(at(0).alias("name"), at(1).cast("double").alias("lat"), at(2).cast("double").alias("lng"), at(3).cast("long").alias("population"), at(4).alias("country"))


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """Cities of CSV files; the first line of each file is its header.

    Lines are read whole (a separator that no text has), so that fields are cut by plain commas.
    """
    return city_rows(spark.read.csv(path, schema="value string", sep="\x01", quote="", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))


def quake_rows(feed: DataFrame) -> DataFrame:
    """Earthquakes of feature rows (mag, place, time in ms, lng, lat, depth): no magnitude, no row."""
    t = feed.where(F.col("mag").isNotNull())
    return t.select("lat", "lng", F.col("mag").alias("magnitude"), "depth", F.coalesce("place", F.lit("Unknown")).alias("place"), F.date_format(F.timestamp_millis("time"), "yyyy-MM-dd HH:mm 'UTC'").alias("time"))


def read_quakes(spark: SparkSession, path: str) -> DataFrame:
    """Earthquakes of whole GeoJSON feed files."""
    shape = "struct<features:array<struct<properties:struct<mag:double,place:string,time:bigint>,geometry:struct<coordinates:array<double>>>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("d"))
    f = doc.select(F.explode("d.features").alias("f"))
    return quake_rows(f.select("f.properties.mag", "f.properties.place", "f.properties.time", F.col("f.geometry.coordinates")[0].alias("lng"), F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[2].alias("depth")))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents as (doc); a path that cannot be read gives no rows."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"))
    except AnalysisException:
        return spark.createDataFrame([], "doc string")
