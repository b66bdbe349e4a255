"""Composite operators: seeding people, page rendering, module order, consistency notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, MapType, StructType, TimestampNTZType, TimestampType

from rostrum.functions import text as X


def seeded_people(rosters: DataFrame) -> DataFrame:
    """(slug, name, alias): people of rosters (name, titles array) with their names, last names and titled last names;
    an alias that two people would have, without regard to case, resolves to neither and is left out."""
    own = rosters.select(X.slugify(F.col("name")).alias("slug"), X.display_name(F.col("name")).alias("name"), "titles", F.initcap(X.last_name(F.col("name"))).alias("last")).where("slug <> ''")
    every = F.concat(F.array("name", "last"), F.transform("titles", lambda t: F.concat_ws(" ", t, "last")))
    aliases = own.select("slug", "name", F.explode(F.array_distinct(every)).alias("alias"))
    free = aliases.groupBy(F.lower("alias").alias("_a")).agg(F.count_distinct("slug").alias("n")).where("n = 1").select("_a")
    return aliases.join(free, F.lower("alias") == F.col("_a"), "left_semi")


def rendered(entities: DataFrame, updates: DataFrame) -> DataFrame:
    """(path, body, hash): a page for each entity with its updates by date; the hash tells what changed."""
    line = F.struct("meeting_date", "update_id", F.concat(F.lit("- "), F.date_format("meeting_date", "yyyy-MM-dd"), F.lit(": "), F.col("update_text")).alias("t"))
    said = updates.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("lines"))
    body = F.concat(F.lit("---\ntitle: "), F.col("name"), F.lit("\n---\n"), F.coalesce("lines", F.lit("")), F.lit("\n"))
    pages = entities.join(said, "entity_id", "left").select(F.concat(F.lit("entities/"), X.slugify(F.col("name")), F.lit(".md")).alias("path"), body.alias("body"))
    return pages.withColumn("hash", X.short_hash(F.col("body")))


def markers(pages: DataFrame, metrics: DataFrame) -> DataFrame:
    """(path, key, value) of each {{metric:key}} marker; value is null for a key that isn't a metric."""
    found = pages.select("path", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\{\{metric:([\w.]+)\}\}"), 1))).alias("key"))
    return found.join(metrics.select("key", "value"), "key", "left").select("path", "key", "value")


def consistency(results: DataFrame) -> DataFrame:
    """results (site, walk_dollars, walk_trips, uplift) with notes: dollars for a walk trip outside 0.25 to 30, uplift over a half."""
    each = F.try_divide(F.col("walk_dollars"), F.col("walk_trips"))
    return results.withColumn("notes", F.array_compact(F.array(F.when((each < 0.25) | (each > 30), "dollars for a walk trip"), F.when(F.col("uplift") > 0.5, "corridor uplift"))))


#: Modules of each project type, in order; later ones see what earlier ones found.
MODULES = {"development": ("economic", "fiscal"), "mixed_use": ("economic", "fiscal"), "bike_lane": ("bike_lane",), "trail": ("trail",)}


def evaluate(project_type: str, spec: DataFrame, modules: dict[str, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]]) -> dict[str, DataFrame]:
    """Each module's metrics (metric, value), run in order with what came before."""
    prior: dict[str, DataFrame] = {}
    for name in MODULES[project_type]:
        prior[name] = modules[name](spec, dict(prior))
    return prior


def slug_lookup(rows: DataFrame, targets: DataFrame, slug: str = "slug", target: str = "target_id") -> DataFrame:
    """rows with the target that has their slug, and note, which says why a row without one is passed over."""
    found = rows.join(targets.select(slug, target), slug, "left")
    return found.withColumn("note", F.when(F.col(target).isNull(), F.concat(F.lit("SKIP "), F.coalesce(slug, F.lit("")), F.lit(": no such target"))))


def prior_metrics(asked: DataFrame, found: DataFrame, keys: list[str], order: str) -> DataFrame:
    """asked (keys, metric) with value: that of the first of found's metrics of exactly this name, null without one."""
    first = found.groupBy(*keys, "metric").agg(F.min_by("value", order).alias("value"))
    return asked.join(first, [*keys, "metric"], "left")


def votes_by_last_name(people: DataFrame, ballots: DataFrame) -> DataFrame:
    """people (person_id, name) with votes_cast: ballots (member, n) are kept by last name, so people who share one share
    their votes."""
    cast = ballots.groupBy(F.lower("member").alias("_key")).agg(F.sum("n").alias("votes_cast"))
    own = people.withColumn("_key", X.last_name(F.col("name"))).join(cast, "_key", "left").drop("_key")
    return own.withColumn("votes_cast", F.coalesce("votes_cast", F.lit(0)))


def first_cast(votes: Column, last_name: Column) -> Column:
    """The vote of the first key of a JSON object that is the last name, case apart; null without one."""
    entries = F.map_entries(F.from_json(votes, "map<string,string>"))
    return F.get(F.filter(entries, lambda e: F.lower(e["key"]) == F.lower(last_name)), F.lit(0))["value"]


def iso_dates(df: DataFrame) -> DataFrame:
    """df with every date and timestamp, in structs and arrays too, as ISO text; fractions of a second only where there are any."""

    def iso(c: Column, kind: DataType) -> Column:
        if isinstance(kind, DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(kind, TimestampType | TimestampNTZType):
            return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*[iso(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: iso(x, kind.elementType))
        if isinstance(kind, MapType):
            return F.transform_values(c, lambda _, v: iso(v, kind.valueType))
        return c

    return df.select(*[iso(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
