"""Entity resolution: names to entities, normalised bases, merges and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions import text as X
from rostrum.operators.graph import cut_lineage
from rostrum.operators.relational import latest_by


def lookup(keys: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """keys (key) with entity_id: by slug, else by alias without regard to case (the smallest entity of equal ones)."""
    by_slug = entities.select(F.col("slug").alias("key"), F.col("entity_id").alias("_s"))
    by_alias = aliases.groupBy(F.lower("alias").alias("_a")).agg(F.min("entity_id").alias("_i"))
    return keys.join(by_slug, "key", "left").join(by_alias, F.lower("key") == F.col("_a"), "left").withColumn("entity_id", F.coalesce("_s", "_i")).drop("_s", "_i", "_a")


def bases(slugs: DataFrame) -> DataFrame:
    """slugs (slug, ...) with each shorter slug that suffix words, years and acronyms leave, and its depth."""
    tokens = F.split("slug", "-")

    def cut(acc, _):
        def next_of(t):
            last = F.element_at(t, -1)
            drop = F.size(X.strip_acronym(t)) < F.size(t)
            drop = drop | last.isin(*X.RESOLVE_STRIP) | X.is_year_token(last)
            return F.when((F.size(t) > 2) & drop, F.concat(acc, F.array(F.slice(t, F.lit(1), F.size(t) - 1)))).otherwise(acc)

        return X.bind(F.element_at(acc, -1), next_of)

    chain = F.aggregate(tokens, F.array(tokens), cut)
    out = slugs.withColumn("_chain", F.array_distinct(chain)).select(*slugs.columns, F.posexplode("_chain").alias("depth", "_base"))
    return out.where("depth > 0").select(*slugs.columns, "depth", F.array_join("_base", "-").alias("base"))


def resolve(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (name, entity_type) with slug, entity_id and how: slug, alias, base, or create (entity_id null).

    Slugs of what isn't a person are normalised first; bases match entities of the same type, the longest first."""
    own = names.withColumn("slug", X.slugify(F.col("name")))
    own = own.withColumn("slug", F.when((F.col("entity_type") != "person") & (F.col("slug") != ""), X.normalize_slug(F.col("slug"))).otherwise(F.col("slug"))).where("slug <> ''")
    hits = entities.groupBy("slug").agg(F.min("entity_id").alias("by_slug"))
    alias = aliases.groupBy(F.lower(F.trim("alias")).alias("_alias")).agg(F.min("entity_id").alias("by_alias"))
    shown = F.lower(F.trim(X.display_name(F.col("name"))))
    out = own.join(hits, "slug", "left").join(alias, F.lower(F.trim("name")) == F.col("_alias"), "left").drop("_alias")
    out = out.withColumn("_shown", shown).join(alias.withColumnsRenamed({"_alias": "_shown", "by_alias": "by_shown"}), "_shown", "left").drop("_shown")
    missing = own.where("entity_type <> 'person'").select("slug", "entity_type").distinct()
    found = bases(missing).join(entities.select(F.col("slug").alias("base"), "entity_type", F.col("entity_id").alias("by_base")), ["base", "entity_type"])
    found = latest_by(found, ["slug", "entity_type"], [F.col("depth"), F.col("by_base")]).select("slug", "entity_type", "by_base")
    out = out.join(found, ["slug", "entity_type"], "left")
    how = F.when(F.col("by_slug").isNotNull(), "slug").when(F.coalesce("by_alias", "by_shown").isNotNull(), "alias").when(F.col("by_base").isNotNull(), "base").otherwise("create")
    return out.select("name", "entity_type", "slug", F.coalesce("by_slug", "by_alias", "by_shown", "by_base").alias("entity_id"), how.alias("how"))


def chase(mapping: DataFrame) -> DataFrame:
    """mapping (source, target), each source once, with chains followed to their end. A round doubles what is followed and cuts the
    lineage, so there are as many rounds as the logarithm of the longest chain. Chains that run in a circle are an error;
    a source that is its own target stays."""
    mapping = cut_lineage(mapping.select("source", "target"))
    for _ in range(mapping.count().bit_length() + 1):  # no chain without a circle is longer than there are sources
        on = mapping.where("source <> target").select(F.col("source").alias("target"), F.col("target").alias("further"))
        mapping = cut_lineage(mapping.join(on, "target", "left").select("source", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")))
        moving, circles = mapping.agg(F.count_if("moved"), F.count_if(F.col("moved") & (F.col("source") == F.col("target")))).first()
        if not moving:
            return mapping.select("source", "target")
        if circles:
            break
        mapping = mapping.drop("moved")
    raise ValueError("chase: a chain runs in a circle")


def merge_entities(facts: DataFrame, mapping: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """facts with entity_id moved from sources to targets; where keys then collide (nulls alike), the target's own row stays."""
    moved = facts.join(mapping.select(F.col("source").alias("entity_id"), F.col("target").alias("_to")), "entity_id", "left")
    moved = moved.withColumn("_own", F.col("_to").isNull()).withColumn("entity_id", F.coalesce("_to", "entity_id")).drop("_to")
    return latest_by(moved, ["entity_id", *key], [F.col("_own").desc(), *[F.col(c) for c in order]]).drop("_own", "rank").select(*facts.columns)


def dedupe_plan(entities: DataFrame) -> DataFrame:
    """(entity_id, slug, action, target): what one pass does to each entity that isn't a person and whose slug isn't
    canonical: merge into the holder of the canonical slug when of its type, skip when of another, else rename; of several
    that would take a free slug the first takes it and the others merge into it."""
    own = entities.where("entity_type <> 'person'").withColumn("canonical", X.normalize_slug(F.col("slug"))).where("canonical <> slug")
    holders = entities.groupBy(F.col("slug").alias("canonical")).agg(F.min_by(F.struct("entity_id", "entity_type"), "entity_id").alias("h"))
    out = own.join(holders, "canonical", "left")
    w = Window.partitionBy("canonical", F.col("h").isNull()).orderBy("entity_id")
    out = out.withColumn("_first", F.first(F.struct("entity_id", "entity_type")).over(w))
    holder = F.coalesce("h", "_first")
    action = F.when(F.col("h").isNull() & (F.col("_first.entity_id") == F.col("entity_id")), "rename").when(holder["entity_type"] != F.col("entity_type"), "skip").otherwise("merge")
    return out.select("entity_id", "slug", "canonical", action.alias("action"), F.when(action == "merge", holder["entity_id"]).alias("target"))


def token_duplicates(names: DataFrame, official: DataFrame) -> DataFrame:
    """names (id, name) with duplicate: nothing distinctive in it, or its distinctive tokens hold, or are held by, those of an
    official name. A pair shares a token, so an equi-join on tokens finds it and nothing is crossed."""
    own = names.withColumn("_t", F.array_sort(X.distinctive_tokens(F.col("name"))))
    ours = own.select("_t").distinct()  # many names have the same tokens: sets are compared once
    theirs = official.select(F.array_sort(X.distinctive_tokens(F.col("name"))).alias("_o")).where(F.size("_o") > 0).distinct()
    a = ours.select("_t", F.explode("_t").alias("token"))
    b = theirs.select("_o", F.explode("_o").alias("token"))
    same = a.join(b, "token").groupBy("_t", "_o").agg(F.count(F.lit(1)).alias("same"))
    hit = same.where((F.col("same") == F.size("_t")) | (F.col("same") == F.size("_o"))).select("_t").distinct().withColumn("_hit", F.lit(True))
    return own.join(hit, "_t", "left").withColumn("duplicate", (F.size("_t") == 0) | F.coalesce("_hit", F.lit(False))).drop("_t", "_hit")


def greedy_suppress(names: DataFrame, group: str, order: list[str]) -> DataFrame:
    """(group, name): names of a group in order, less those whose tokens hold or are held by those of one kept before."""
    row = F.struct(*order, F.col("name").alias("name"), F.array_sort(X.distinctive_tokens(F.col("name"))).alias("tokens"))
    every = names.groupBy(group).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    held = lambda a, b: (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    kept = F.aggregate("rows", F.array().cast("array<struct<name:string,tokens:array<string>>>"), lambda acc, x: F.when((F.size(x["tokens"]) == 0) | F.exists(acc, lambda k: held(k["tokens"], x["tokens"])), acc).otherwise(F.concat(acc, F.array(F.struct(x["name"].alias("name"), x["tokens"].alias("tokens"))))))
    return every.select(group, F.explode(F.transform(kept, lambda k: k["name"])).alias("name"))
