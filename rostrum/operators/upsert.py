"""Idempotent writes as joins of what is stored with what came in; each returns the new state of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.text import ics_escape


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """old with new's rows put in by key: new's columns win, but `keep` columns stay as they were stored."""
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.withColumn("_old", F.lit(True)).alias("o").join(n, list(key), "full")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*key, *[pick(c).alias(c) for c in old.columns if c not in key])


def insert_new(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old and those of new whose key it hasn't."""
    return old.unionByName(new.join(old.select(*key), list(key), "left_anti"))


def snapshot(old: DataFrame, new: DataFrame, key: Sequence[str], fill: Sequence[str] = ()) -> DataFrame:
    """new, which replaces old; `fill` columns keep the stored value where the new one is null or empty."""
    kept = old.select(*key, *[F.col(c).alias(f"_{c}") for c in fill])
    out = new.join(kept, list(key), "left")
    return out.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) if c in fill else F.col(c) for c in new.columns])


def partial_merge(old: DataFrame, new: DataFrame, key: Sequence[str], complete: bool) -> DataFrame:
    """A complete sync overwrites all fields and prunes what isn't listed; a partial one overwrites with what it has only."""
    joined = old.withColumn("_o", F.lit(True)).alias("o").join(new.withColumn("_n", F.lit(True)).alias("n"), list(key), "full")
    if complete:
        joined = joined.where("_n")
    kinds = dict(new.dtypes)

    def pick(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if complete:
            return n
        empty = n.isNull() | ((n == "") if kinds[c] == "string" else (F.size(n) == 0) if kinds[c].startswith(("array", "map")) else F.lit(False))
        return F.when(F.coalesce(empty, F.lit(True)), o).otherwise(n)

    return joined.select(*key, *[pick(c).alias(c) for c in old.columns if c not in key])


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Delete and recreate by group: old without the groups that new has, and new."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def write_groups(new: DataFrame, path: str, group: str) -> None:
    """The same on storage: only the partitions of new's groups are overwritten, whatever the session's mode."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)


def hash_sync(old: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
    """(path, outcome) of pushing pages (path, entity, hash): created, updated, unchanged, deleted, or orphaned where the
    page's entity isn't known."""
    pages = new.join(known.select(F.col("entity").alias("_k")).distinct(), F.col("entity") == F.col("_k"), "left")
    fresh = pages.select("path", F.col("hash").alias("_new"), F.col("_k").isNotNull().alias("_ok"))
    both = old.select("path", F.col("hash").alias("_old")).join(fresh, "path", "full")
    outcome = F.when(F.col("_new").isNull(), "deleted").when(~F.col("_ok"), "orphaned").when(F.col("_old").isNull(), "created").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    return both.select("path", outcome.alias("outcome"))


def calendar(events: DataFrame) -> DataFrame:
    """(event_id, entry): a calendar entry of each event (event_id, title, starts_at, url) with a start, two hours long."""
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss")
    end = F.col("starts_at") + F.expr("INTERVAL 2 HOURS")
    lines = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("event_id").cast("string")), F.concat(F.lit("DTSTART:"), stamp(F.col("starts_at"))), F.concat(F.lit("DTEND:"), stamp(end)), F.concat(F.lit("SUMMARY:"), ics_escape(F.col("title"))), F.lit("END:VEVENT"))
    return events.where("starts_at is not null").select("event_id", lines.alias("entry"))


def run_log(df: DataFrame, run_id: int, errors: Sequence[str] = ()) -> DataFrame:
    """One row for a run: how many rows it processed, and its errors as JSON."""
    return df.agg(F.count(F.lit(1)).alias("processed")).select(F.lit(run_id).alias("run_id"), "processed", F.to_json(F.array(*map(F.lit, errors)) if errors else F.array().cast("array<string>")).alias("errors"))


def apply_extractions(raw: DataFrame) -> dict[str, DataFrame]:
    """items, votes, mentions and updates from extractions (meeting_id, json): the first of an agenda's equal labels stays,
    labels are cut to 64 characters and an empty one is "?"; an entity's updates of a meeting are joined in item order."""
    schema = "agenda_items array<struct<label string, title string, outcome string, votes array<struct<description string, motion_result string, vote_breakdown map<string,string>>>, entities array<struct<entity_type string, name string, role string, update_text string, status_after string>>>>"
    rows = raw.select("meeting_id", F.from_json("json", schema).alias("x")).select("meeting_id", F.posexplode("x.agenda_items").alias("pos", "item"))
    label = F.coalesce(F.nullif(F.left(F.col("item.label"), F.lit(64)), F.lit("")), F.lit("?"))
    from rostrum.operators.relational import latest_by

    items = latest_by(rows.withColumn("label", label), ["meeting_id", "label"], [F.col("pos")]).drop("rank")
    votes = items.select("meeting_id", "label", F.posexplode("item.votes").alias("vote_no", "v")).select("meeting_id", "label", "vote_no", "v.*")
    mentions = items.select("meeting_id", "label", "pos", F.posexplode("item.entities").alias("n", "e")).where(F.col("e.name") != "").select("meeting_id", "label", "pos", "n", "e.*")
    place = F.struct("pos", "n")
    said = F.collect_list(F.when(F.col("update_text") != "", F.struct("pos", "n", F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col("update_text")).alias("t"))))
    updates = mentions.groupBy("meeting_id", "name").agg(F.array_join(F.transform(F.array_sort(said), lambda s: s["t"]), " ").alias("update_text"), F.max_by("status_after", F.when(F.col("status_after") != "", place)).alias("status_after"), F.min_by("label", place).alias("first_label")).where("update_text <> ''")
    return {"items": items.select("meeting_id", "label", "pos", F.col("item.title").alias("title"), F.col("item.outcome").alias("outcome")), "votes": votes, "mentions": mentions.drop("pos", "n"), "updates": updates}
