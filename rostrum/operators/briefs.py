"""What a reader sees of a meeting to come and of the projects: composed from mentions, updates and the official directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions import text as X
from rostrum.operators import mentions as M
from rostrum.operators.graph import cut_lineage
from rostrum.operators.identity import token_duplicates
from rostrum.operators.relational import like_text, where_equal


def tracked(entities: DataFrame, updates: DataFrame, meetings: DataFrame) -> DataFrame:
    """entities (entity_id, entity_type, ...) other than persons that have updates, with update_count, last_seen and the text and
    date of the latest update; of one day's updates the one with the greatest id is the latest."""
    said = updates.join(meetings.select("meeting_id", "meeting_date"), "meeting_id")
    order = F.struct("meeting_date", "update_id")
    sums = said.groupBy("entity_id").agg(F.count(F.lit(1)).alias("update_count"), F.max("meeting_date").alias("last_seen"), F.max_by(F.struct(F.col("meeting_date").alias("date"), F.col("update_text").alias("text")), order).alias("latest_update"))
    return entities.where("entity_type <> 'person'").join(sums, "entity_id")


def meeting_briefs(upcoming: DataFrame, entities: DataFrame, aliases: DataFrame, updates: DataFrame, meetings: DataFrame, projects: DataFrame, evaluations: DataFrame) -> DataFrame:
    """upcoming (event_id, agenda_text, ...) with has_agenda_text and topics: the tracked entities that the agenda names, by number
    of updates, then id, each with its status, its history, the line that names it and the slug of its finished evaluation.

    entities: entity_id, slug, name, entity_type, current_status; aliases: entity_id, alias; updates: update_id, entity_id,
    meeting_id, update_text; projects: project_id, entity_id, external_slug; evaluations: project_id, status. Names count from
    five characters on, the longest that the agenda holds decides on the line. An entity's project is the one with the smallest
    id. A meeting without agenda text, or whose agenda names nothing, has no topics."""
    own = tracked(entities, updates, meetings)
    names = own.select("entity_id", "name").join(aliases.select("entity_id", "alias"), "entity_id", "left")
    texts = upcoming.where("agenda_text <> ''").select("event_id", "agenda_text")
    hits = M.matches(texts, M.variants(names), text="agenda_text", key="event_id")
    hits = hits.select("event_id", "entity_id", X.agenda_excerpt(F.col("agenda_text"), F.col("variant")).alias("agenda_context"))
    first = projects.where("entity_id is not null").groupBy("entity_id").agg(F.min_by(F.struct("project_id", "external_slug"), "project_id").alias("p"))
    done = first.join(evaluations.select("project_id", "status"), F.col("p.project_id") == F.col("project_id"), "left")
    slugs = done.where("status = 'synthesized'").select("entity_id", F.col("p.external_slug").alias("evaluation_slug"))
    topic = F.struct((-F.col("update_count")).alias("_n"), "entity_id", "slug", "name", "entity_type", "current_status", "update_count", "last_seen", "agenda_context", "latest_update", "evaluation_slug")
    found = hits.join(own, "entity_id").join(slugs, "entity_id", "left")
    topics = found.groupBy("event_id").agg(F.array_sort(F.collect_list(topic)).alias("topics"))
    out = upcoming.join(topics, "event_id", "left").withColumn("has_agenda_text", F.coalesce(F.col("agenda_text") != "", F.lit(False)))
    kind = topics.schema["topics"].dataType.simpleString()
    return out.withColumn("topics", F.transform(F.coalesce("topics", F.array().cast(kind)), lambda t: t.dropFields("_n")))


def containing(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of ids of sets (id, tokens, each set once) where a's tokens are all among b's, more than a's. A set meets
    others on its rarest token only, so frequent tokens form no pairs."""
    tokens = sets.select("id", F.explode("tokens").alias("token"))
    seen = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = tokens.join(seen, "token").groupBy("id").agg(F.min(F.struct("n", "token")).alias("r")).select("id", F.col("r.token").alias("token"))
    a = sets.join(rarest, "id").select(F.col("id").alias("a"), F.col("tokens").alias("ta"), "token")
    b = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"), F.explode("tokens").alias("token"))
    return a.join(b, "token").where((F.size("ta") < F.size("tb")) & (F.size(F.array_except("ta", "tb")) == 0)).select("a", "b")


def kept_in_order(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node): going through nodes from the smallest, each is kept unless one kept before is paired with it. pairs (a, b), a <> b.

    A round keeps what no open node comes before and drops its partners; the smallest open node is always decided."""
    open_ = cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left = cut_lineage(nodes.select("node").distinct())
    kept = None
    while left.limit(1).count():
        now = cut_lineage(left.join(open_.select(F.col("b").alias("node")).distinct(), "node", "left_anti"))
        kept = now if kept is None else kept.unionByName(now)
        gone = open_.join(now.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node")).distinct()
        left = cut_lineage(left.join(now, "node", "left_anti").join(gone, "node", "left_anti"))
        open_ = cut_lineage(open_.join(left.withColumnRenamed("node", "a"), "a", "left_semi").join(left.withColumnRenamed("node", "b"), "b", "left_semi"))
    return left if kept is None else kept


def directory(projects: DataFrame, entities: DataFrame, evaluations: DataFrame, *, project_type: str | None = None, division: str | None = None, status: str | None = None, q: str | None = None) -> DataFrame:
    """(source, category, slug, name, entity_id, entity_slug, entity_status, has_evaluation, no_analysis_reason, place): the official
    projects by name, then the project entities that only meetings know, by name.

    projects: project_id, external_slug, name, project_type, division, official_status, description, requests, entity_id;
    entities: entity_id, slug, name, entity_type, current_status; evaluations: project_id, status. An entity that a project is linked
    with has no row of its own, nor has one whose distinctive words hold, or are held by, those of an official name or of an
    entity listed before it, nor one without distinctive words. The filters on type, division and status leave official rows only;
    q keeps names that are like it. Names that are equal are put in order by id."""
    own = where_equal(projects, project_type=project_type, division=division, official_status=status)
    named = (lambda df: df.where(like_text(F.col("name"), q))) if q else (lambda df: df)
    about = entities.select("entity_id", F.col("slug").alias("entity_slug"), F.col("current_status").alias("entity_status"))
    judged = evaluations.select("project_id", F.col("status").alias("_status"))
    official = named(own).join(about, "entity_id", "left").join(judged, "project_id", "left")
    reason = X.no_analysis_reason(F.col("description"), F.col("requests"), F.col("official_status"), F.col("_status"))
    done = F.coalesce(F.col("_status") == "synthesized", F.lit(False))
    out = official.select(F.lit("official").alias("source"), F.lit("development").alias("category"), F.col("external_slug").alias("slug"), "name", "entity_id", "entity_slug", "entity_status", done.alias("has_evaluation"), reason.alias("no_analysis_reason"), F.struct(F.lit(0).alias("part"), "name", F.col("project_id").alias("id")).alias("place"))
    if project_type or division or status:
        return out
    linked = projects.where("entity_id is not null").select("entity_id").distinct()
    free = named(entities.where("entity_type = 'project'").join(linked, "entity_id", "left_anti"))
    fresh = token_duplicates(free.withColumnRenamed("entity_id", "id"), projects.select(F.col("project_id").alias("id"), "name")).where("not duplicate")
    order = F.struct("name", "id")
    sets = cut_lineage(fresh.groupBy(F.array_sort(X.distinctive_tokens(F.col("name"))).alias("tokens")).agg(F.min(order).alias("id")))  # of equal sets the first
    kept = kept_in_order(sets.select(F.col("id").alias("node")), containing(sets))
    rows = kept.select("node.name", F.col("node.id").alias("entity_id")).join(about, "entity_id")
    none = F.lit(None).cast("string")
    rows = rows.select(F.lit("meetings").alias("source"), X.category(F.col("name")).alias("category"), none.alias("slug"), "name", "entity_id", "entity_slug", "entity_status", F.lit(False).alias("has_evaluation"), none.alias("no_analysis_reason"), F.struct(F.lit(1).alias("part"), "name", F.col("entity_id").alias("id")).alias("place"))
    return out.unionByName(rows)
