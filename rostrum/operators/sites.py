"""Which parcels a project stands on: the first of several ways that answers, for a table of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.text import name_key
from rostrum.operators import mentions as M
from rostrum.operators import polygons as P
from rostrum.operators.graph import cut_lineage

SQFT_PER_ACRE = 43_560.0


def pin_key(pin: Column) -> Column:
    """A parcel number without differences in white space."""
    return F.trim(F.regexp_replace(pin, r"\s+", " "))


def review_places(projects: DataFrame, reviews: DataFrame) -> DataFrame:
    """(project, x, y): the first of reviews (review, name, url, x, y) whose url has the project's slug in it or whose name is the
    project's, by its number; reviews without a place don't count."""
    placed = reviews.where("x is not null and y is not null")
    slugs = projects.where("slug <> ''").select("project", F.array(F.lower("slug")).alias("variants"))
    long_ = F.length(F.col("variants")[0]) >= M.MIN_VARIANT
    by_url = M.matches(placed.where("url is not null").select("review", "url"), slugs.where(long_), text="url", key="review", entity="project").select("project", "review")
    short = slugs.where(~long_).select("project", F.col("variants")[0].alias("part"))
    parts = placed.select("review", F.explode(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))).alias("part"))  # slugs too short to search for stand between other signs
    by_url = by_url.unionByName(short.join(parts, "part").select("project", "review"))
    keys = projects.select("project", name_key(F.col("name")).alias("k")).where("k <> ''")
    by_name = keys.join(placed.select("review", name_key(F.col("name")).alias("k")), "k").select("project", "review")
    first = by_url.unionByName(by_name).groupBy("project").agg(F.min("review").alias("review"))
    return first.join(placed.select("review", "x", "y"), "review").select("project", "x", "y")


def resolved_sites(projects: DataFrame, parcels: DataFrame, reviews: DataFrame) -> DataFrame:
    """(project, method, pins, acres, note) of each project: its parcels' numbers and their area, and how they were found.

    projects: project, slug, name, pins (array), x, y (published place) and geo_x, geo_y (place of the address); parcels: pin, rings in
    feet, each pin once. The numbers that documents state come first, white space aside; then the parcels around the published
    place, or the address's where none is published; then those around the review map's place. A way that finds no parcel gives
    way to the next; where none does, note says so."""
    own = parcels.withColumn("_k", pin_key(F.col("pin")))
    stated = projects.select("project", F.explode("pins").alias("p")).select("project", pin_key(F.col("p")).alias("_k")).distinct()
    tries = [stated.join(own, "_k").select("project", "pin", F.lit(0).alias("rung"))]
    place = F.coalesce(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("x", "y")), F.when(F.col("geo_x").isNotNull() & F.col("geo_y").isNotNull(), F.struct(F.col("geo_x").alias("x"), F.col("geo_y").alias("y"))))
    places = [projects.select("project", place.alias("at")).where("at is not null").select("project", "at.x", "at.y"), review_places(projects, reviews)]
    tries += [P.located(at, parcels, "pin").select("project", "pin", F.lit(i).alias("rung")) for i, at in enumerate(places, 1)]
    found = cut_lineage(tries[0].unionByName(tries[1]).unionByName(tries[2]))  # read twice
    best = found.groupBy("project").agg(F.min("rung").alias("rung"))
    area = parcels.select("pin", P.area_of(F.col("rings")).alias("area"))
    taken = found.join(best, ["project", "rung"]).join(area, "pin")
    sums = taken.groupBy("project", "rung").agg(F.array_sort(F.collect_set("pin")).alias("pins"), (F.sum("area") / SQFT_PER_ACRE).alias("acres"))
    method = F.when(F.col("rung") == 0, "document_pins").when(F.col("rung") == 1, "address_geocode").when(F.col("rung") == 2, "review_map")
    note = F.when(F.col("rung").isNull(), "no usable parcel numbers, place or review map entry")
    return projects.select("project").join(sums, "project", "left").select("project", method.alias("method"), "pins", "acres", note.alias("note"))
