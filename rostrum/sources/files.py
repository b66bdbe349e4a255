"""Readers of landed files, and layers that are built once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.sources.parse import front_matter


def in_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], columns: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Columns of Parquet files inside a box (west, south, east, north); both prune at the scan."""
    west, south, east, north = box
    return spark.read.parquet(path).where(F.col(x).between(west, east) & F.col(y).between(south, north)).select(*columns)


def latest_release(paths: DataFrame, prefix: str) -> DataFrame:
    """The greatest release name of listed paths (path) under the prefix."""
    name = F.regexp_extract("path", rf"{prefix}([^/]+)/", 1)
    return paths.select(name.alias("release")).where("release <> ''").agg(F.max("release").alias("release"))


def text_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV, gzipped or not, with a header and a given schema: codes with leading zeros stay strings."""
    return spark.read.schema(schema).option("header", True).csv(path)


def curated_merges(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, force) of a JSON file of merges."""
    schema = "merges array<struct<source string, target string, force_cross_type boolean, note string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("merges")).select("source", "target", F.coalesce("force_cross_type", F.lit(False)).alias("force"))


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta, body) of a folder of Markdown pages."""
    pages = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return front_matter(pages.select(F.regexp_replace(F.col("_metadata.file_path"), rf"^.*?{path.strip('/').rsplit('/', 1)[-1]}/", "").alias("path"), F.col("value").alias("text")))


def weekday_trips(stops: DataFrame, trips: DataFrame, stop_times: DataFrame, calendar: DataFrame) -> DataFrame:
    """stops with n_trips, the distinct trips of services that run on all five weekdays; zero where there are none."""
    days = sum(F.col(d).cast("int") for d in ("monday", "tuesday", "wednesday", "thursday", "friday"))
    running = trips.join(calendar.where(days >= 5).select("service_id"), "service_id", "left_semi").select("trip_id")
    n = stop_times.join(running, "trip_id", "left_semi").groupBy("stop_id").agg(F.count_distinct("trip_id").alias("n_trips"))
    return stops.join(n, "stop_id", "left").withColumn("n_trips", F.coalesce("n_trips", F.lit(0)))


def build_if_missing(spark: SparkSession, path: str, build: Callable[[], DataFrame], source: str, vintage: str) -> DataFrame:
    """The layer at path, built and written the first time; its manifest says where it came from. The commit is atomic: a
    layer without the writer's success mark is built again."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
        note = spark.createDataFrame([(path, source, vintage)], "path string, source string, vintage string")
        note.write.mode("overwrite").json(f"{path}.manifest")
    return spark.read.parquet(path)


def candidate(df: DataFrame, names: list[str]) -> str | None:
    """The first of names that df has, without regard to case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def settings(spark: SparkSession, text: str) -> DataFrame:
    """(key, value, source) of a jurisdiction's pinned values, given as JSON {key: {value, source}}."""
    rows = [(k, float(v["value"]), v.get("source")) for k, v in json.loads(text).items()]
    return spark.createDataFrame(rows, "key string, value double, source string")
