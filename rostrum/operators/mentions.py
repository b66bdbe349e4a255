"""Who is named where: substring matches of name variants in texts, and rankings of them.

Each entity's variants are held as one array; each text is lower-cased once and tested with a literal search. One hit counts for an entity and a text, however many of its variants match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_VARIANT = 5
#: Names that go to the executors with the plan; with more, they are joined in as rows.
MAX_BROADCAST_NAMES = 20_000


def variants(names: DataFrame, entity: str = "entity_id", columns: tuple[str, ...] = ("name", "alias")) -> DataFrame:
    """(entity, variants): each entity's distinct lower-cased names of MIN_VARIANT characters or more."""
    own = names.select(entity, F.explode(F.array(*[F.lower(c) for c in columns])).alias("v")).where(F.length("v") >= MIN_VARIANT)
    return own.groupBy(entity).agg(F.array_sort(F.collect_set("v")).alias("variants"))


def matches(texts: DataFrame, named: DataFrame, text: str = "text", key: str = "chunk_id", entity: str = "entity_id", most: int = MAX_BROADCAST_NAMES) -> DataFrame:
    """Each row of texts (with a unique key) with each entity that it names, and the longest variant it has (the first of
    equal ones).

    Names that a count proves to be at most `most` are broadcast and tested against each text. With more, texts and names
    meet on five-character pieces: a text that contains a variant contains all its pieces, so the one that the fewest texts have loses no
    match, a beginning that all names share brings nothing together, and nothing is crossed; what meets is then tested in full."""
    low = texts.withColumn("_low", F.lower(text))
    named_in = F.exists("variants", lambda v: F.contains(F.col("_low"), v))
    if named.limit(most + 1).count() <= most:
        both = low.join(F.broadcast(named), named_in)
    else:
        met = rarest_pieces(low, named, key, entity)
        both = low.join(met, key).join(named, entity).where(named_in)
    found = F.filter("variants", lambda v: F.contains(F.col("_low"), v))
    longest = F.element_at(F.array_sort(F.transform(found, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), 1)["v"]
    return both.withColumn("variant", longest).drop("_low", "variants")


def rarest_pieces(low: DataFrame, named: DataFrame, key: str, entity: str) -> DataFrame:
    """(key, entity) of the texts that have, of one of an entity's variants, the piece of MIN_VARIANT characters that the fewest texts have."""
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_low") - (MIN_VARIANT - 1)), lambda i: F.substring(F.col("_low"), i, F.lit(MIN_VARIANT))))
    of_text = low.where(F.length("_low") >= MIN_VARIANT).select(key, F.explode(pieces).alias("_piece"))
    of_name = named.select(entity, F.explode(F.array_distinct("variants")).alias("_v")).select(entity, "_v", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_v") - (MIN_VARIANT - 1)), lambda i: F.substring(F.col("_v"), i, F.lit(MIN_VARIANT))))).alias("_piece"))
    asked = of_text.join(of_name.select("_piece").distinct(), "_piece", "left_semi").groupBy("_piece").count()
    rarest = of_name.join(asked, "_piece", "left").groupBy(entity, "_v").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "_piece")).alias("r"))
    begun = rarest.where("r.count > 0").select(entity, "r._piece").distinct()
    return of_text.join(begun, "_piece").select(key, entity).distinct()


def window_of_meetings(meetings: DataFrame, chunks: DataFrame, *, as_of: str | None = None, days: int | None = None, body: str | None = None, n: int | None = None, most: int = 12) -> DataFrame:
    """Meetings with a transcript: the n most recent, or, with days or a body, those in the look-back window, `most` at most."""
    own = meetings.join(chunks.select("meeting_id").distinct(), "meeting_id", "left_semi")
    if days is not None or body is not None:
        own = own.where(F.col("meeting_date") >= F.date_sub(F.lit(as_of).cast("date"), days or 60))
        if body is not None:
            own = own.where(F.col("body") == body)
        n = most
    return own.orderBy(F.col("meeting_date").desc(), F.col("meeting_id").desc()).limit(n or 3)


def hot_topics(meetings: DataFrame, chunks: DataFrame, names: DataFrame, *, top: int = 30, **window) -> DataFrame:
    """(entity_id, seconds, chunk_mentions, meetings): topics by named discussion time; persons don't count, a chunk without
    times adds a mention but no time, and topics without time are dropped after the limit."""
    own = window_of_meetings(meetings, chunks, **window)
    said = chunks.join(F.broadcast(own.select("meeting_id")), "meeting_id")
    hits = matches(said, variants(names.where("entity_type <> 'person'")))
    span = F.coalesce((F.col("end_seconds") - F.col("start_seconds")).cast("double"), F.lit(0.0))
    per = hits.groupBy("entity_id", "meeting_id").agg(F.sum(span).alias("s"), F.count(F.lit(1)).alias("n"))
    ranked = per.groupBy("entity_id").agg(F.sum("s").alias("seconds"), F.sum("n").alias("chunk_mentions"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("meeting_id", "s")))).alias("meetings"))
    return ranked.orderBy(F.col("seconds").desc(), F.col("entity_id")).limit(top).where("seconds > 0")


def discussion_series(meetings: DataFrame, chunks: DataFrame, names: DataFrame, most: int = 24) -> DataFrame:
    """(entity_id, meeting_id, meeting_date, seconds): named seconds by meeting, chunks without times left out; the latest
    `most` meetings of each entity."""
    from rostrum.operators.relational import latest_by

    timed = chunks.where("start_seconds is not null and end_seconds is not null")
    hits = matches(timed, variants(names)).groupBy("entity_id", "meeting_id").agg(F.sum((F.col("end_seconds") - F.col("start_seconds")).cast("double")).alias("seconds"))
    dated = hits.join(meetings.select("meeting_id", "meeting_date"), "meeting_id")
    return latest_by(dated, ["entity_id"], [F.col("meeting_date").desc(), F.col("meeting_id").desc()], most).drop("rank")


def known_entities(texts: DataFrame, names: DataFrame, most: int = 60) -> DataFrame:
    """(meeting_id, entity_id, place): the first `most` entities by id, persons left out, that a meeting's texts name."""
    from rostrum.operators.relational import latest_by

    hits = matches(texts, variants(names.where("entity_type <> 'person'"))).select("meeting_id", "entity_id").distinct()
    return latest_by(hits, ["meeting_id"], [F.col("entity_id")], most, "place")
