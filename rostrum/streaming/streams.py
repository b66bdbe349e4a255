"""Incremental processing: watermarked windows, stateful limits, digests behind high-water marks, idempotent batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from rostrum.operators.folds import ordered_fold
from rostrum.operators.graph import cut_lineage
from rostrum.operators.relational import latest_by


def timed(events: DataFrame) -> DataFrame:
    """Event time as a timestamp with zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    own = timed(events).withWatermark("ts", late)
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    own = timed(events).withWatermark("ts", late)
    return own.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    own = timed(events).withWatermark("ts", late)
    return own.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


def limited(events: DataFrame, most: int, seconds: int, keys: list[str]) -> DataFrame:
    """(keys, n, t, event_id, allowed) of each call: n numbers a key's calls in order, t is the time in microseconds."""
    span = seconds * 1_000_000
    calls = events.select(*keys, F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")

    def start() -> list:
        return [0, deque()]

    def step(state: list, call: tuple):
        n, live = state
        t, event = call
        state[0] += 1
        if t is None:
            return ((n, t, event, False),)
        while live and live[0] < t - span:
            live.popleft()
        allowed = len(live) < most
        if allowed:
            live.append(t)
        return ((n, t, event, allowed),)

    kind = lambda c: calls.schema[c].dataType.simpleString()
    named = ", ".join(f"`{k}` {kind(k)}" for k in keys)
    return ordered_fold(calls, keys, ["t", "event_id"], ["t", "event_id"], f"{named}, n bigint, t bigint, event_id {kind('event_id')}, allowed boolean", start, step)


def rate_limit(events: DataFrame, most: int, seconds: int, key: str | Sequence[str] = "user_id") -> DataFrame:
    """(key, event_id, allowed): at most `most` allowed calls of a key in the trailing window; denied calls don't count, and
    calls without a time are denied.

    A fold over each key's ordered calls whose state is the allowed times still in the window."""
    keys = [key] if isinstance(key, str) else list(key)
    return limited(events, most, seconds, keys).select(*keys, "event_id", "allowed")


def daily_budget(events: DataFrame, most: int = 6, seconds: int = 60, per_day: int = 500, key: str = "user_id") -> DataFrame:
    """(key, event_id, allowed): calls within the key's trailing window and within the day's budget of all keys.

    Windows and budget start anew at midnight, so a key's days are folded apart. Until the budget is spent each call that
    the window allows takes of it, and nothing is allowed after: the day's first `per_day` of them are the allowed ones. Calls
    are told apart by time, event id, key and their number within the key, so equal or missing event ids do no harm."""
    own = cut_lineage(limited(events.withColumn("day", F.to_date("ts")), most, seconds, [key, "day"]))
    place = F.struct("t", "event_id", key, "n")
    last = latest_by(own.where("allowed"), ["day"], [F.col("t"), F.col("event_id"), F.col(key), F.col("n")], per_day).groupBy("day").agg(F.max(place).alias("last"))
    return own.join(last, "day", "left").select(key, "event_id", (F.col("allowed") & F.coalesce(place <= F.col("last"), F.lit(False))).alias("allowed"))


def rate_limit_stream(events: DataFrame, most: int, seconds: int, key: str = "user_id") -> DataFrame:
    """The same on a stream: state holds the key's allowed times, at most `most`, and goes when they have all passed."""
    span = pd.Timedelta(seconds=seconds)

    def run(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = [pd.Timestamp(x) for x in state.get[0]] if state.exists else []
        for pdf in batches:
            out = []
            for _, r in pdf.sort_values(["ts", "event_id"]).iterrows():
                live = [t for t in live if t >= r["ts"] - span]
                ok = len(live) < most
                if ok:
                    live.append(r["ts"])
                out.append((name[0], r["event_id"], ok))
            yield pd.DataFrame(out, columns=[key, "event_id", "allowed"])
        state.update(([t.isoformat() for t in live],))
        if live:
            state.setTimeoutTimestamp(int((live[-1] + span).timestamp() * 1000) + 1) if int((live[-1] + span).timestamp() * 1000) > state.getCurrentWatermarkMs() else None

    own = timed(events).withWatermark("ts", "1 minute")
    return own.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long, allowed boolean", "live array<string>", "append", "EventTimeTimeout")


def digests(subscriptions: DataFrame, updates: DataFrame) -> DataFrame:
    """(email, entity_id, update_ids): for each confirmed subscription the updates above its mark, oldest first."""
    own = subscriptions.where("confirmed").join(updates, "entity_id").where("update_id > last_update_id")
    return own.groupBy("email", "entity_id").agg(F.array_sort(F.collect_list("update_id")).alias("update_ids"))


def advanced(subscriptions: DataFrame, updates: DataFrame, sent: DataFrame) -> DataFrame:
    """subscriptions with the marks of the addresses in sent moved to the newest update of their entity."""
    newest = updates.groupBy("entity_id").agg(F.max("update_id").alias("_newest"))
    out = subscriptions.join(newest, "entity_id", "left").join(sent.select("email").distinct().withColumn("_sent", F.lit(True)), "email", "left")
    mark = F.when(F.col("_sent") & F.col("confirmed"), F.greatest("last_update_id", F.coalesce("_newest", "last_update_id"))).otherwise(F.col("last_update_id"))
    return out.select("email", "entity_id", "confirmed", mark.alias("last_update_id"))


def ingest_available(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str) -> None:
    """Read what is new in a folder of Parquet files and add rows whose key the sink hasn't; safe to run again."""

    def add(batch: DataFrame, _: int) -> None:
        try:
            seen = spark.read.parquet(sink).select(key)
            batch = batch.join(seen, key, "left_anti")
        except Exception as e:  # the first batch finds no sink
            if "PATH_NOT_FOUND" not in str(e):
                raise
        batch.dropDuplicates([key]).write.mode("append").parquet(sink)

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def live_topics(hits: DataFrame, width: str = "60 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Named seconds by topic in a sliding window, for hits (ts, entity_id, seconds)."""
    own = timed(hits).withWatermark("ts", late)
    return own.groupBy(F.window("ts", width, step).alias("w"), "entity_id").agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("mentions")).select(F.col("w.end").cast("timestamp_ntz").alias("until"), "entity_id", "seconds", "mentions")


#: What the state of a source's snapshots holds, and what the stream tells of them; times in microseconds.
SEEN = "seen bigint, title string, agenda_text string"
CHANGES = "source string, event_id string, at bigint, change string, title string, agenda_text string"


def change(source: str, event_id: str, at: int, kind: str, title: str | None, agenda_text: str | None) -> Row:
    return Row(source=source, event_id=event_id, at=at, change=kind, title=title, agenda_text=agenda_text)


class SnapshotState(StatefulProcessor):
    """A source's current events: each snapshot replaces the one before it, as the batch does."""

    def __init__(self, grace_seconds: int) -> None:
        self.grace = grace_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.version = handle.getValueState("version", "at bigint")
        self.events = handle.getMapState("events", "event_id string", SEEN)

    def handleInputRows(self, key, rows, timer_values):
        for row in sorted(rows, key=lambda r: r.at):
            if self.version.exists() and row.at <= self.version.get()[0]:
                continue  # late or repeated: what is newer stands
            self.version.update((row.at,))
            for event in {e["event_id"]: e for e in row.events or []}.values():
                name, title, text = (event["event_id"],), event["title"], event["agenda_text"]
                was = self.events.getValue(name) if self.events.containsKey(name) else None
                if text is None and was is not None:
                    text = was[2]  # fetched text outlives a snapshot without it
                self.events.updateValue(name, (row.at, title, text))
                if was is None or (was[1], was[2]) != (title, text):
                    yield change(key[0], name[0], row.at, "added" if was is None else "changed", title, text)
            yield from self.dropped(key[0], row.at, row.at - self.grace)
            if self.grace and any(v[0] < row.at for _, v in self.events.iterator()):
                self.handle.registerTimer((row.at + self.grace) // 1000)

    def handleExpiredTimer(self, key, timer_values, expired):
        yield from self.dropped(key[0], self.version.get()[0], expired.getExpiryTimeInMs() * 1000 - self.grace)

    def dropped(self, source: str, at: int, until: int) -> Iterator[Row]:
        """Events that the newest snapshot lacks, last seen at `until` or before, go."""
        for name, v in [(name, v) for name, v in self.events.iterator() if v[0] < at and v[0] <= until]:
            self.events.removeKey(name)
            yield change(source, name[0], at, "removed", v[1], v[2])

    def close(self) -> None:
        pass


def snapshot_changes(snapshots: DataFrame, late: str = "0 seconds", grace_seconds: int = 0) -> DataFrame:
    """(source, event_id, version, change, title, agenda_text): what each snapshot of a source adds to, changes in and removes from
    its events, on a stream of snapshots (source, version, events: array of event_id, title, agenda_text).

    A snapshot that isn't newer than the newest one seen of its source changes nothing, so late and repeated ones do no harm. An
    event that a newer snapshot lacks goes at once or, with a grace, when the watermark has passed the version that lacked
    it by that long and no snapshot has brought it back. State is one row for each event of a source; it needs the RocksDB state
    store."""
    own = snapshots.withWatermark("version", late).withColumn("at", F.unix_micros("version"))
    out = own.groupBy("source").transformWithState(SnapshotState(grace_seconds), StructType.fromDDL(CHANGES), "append", "EventTime")
    return out.select("source", "event_id", F.timestamp_micros("at").alias("version"), "change", "title", "agenda_text")


def snapshot_of(snapshots: DataFrame) -> DataFrame:
    """(source, event_id, title, agenda_text): the events of each source's newest snapshot, each with the newest agenda text that
    was fetched since it is listed without a break; the batch that snapshot_changes adds up to."""
    rows = snapshots.dropDuplicates(["source", "version"])
    order = Window.partitionBy("source").orderBy("version")
    rows = rows.withColumn("no", F.row_number().over(order)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("source")))
    each = rows.select("source", "no", "of", F.inline("events")).groupBy("source", "no", "of", "event_id").agg(F.last("title").alias("title"), F.last("agenda_text").alias("agenda_text"))
    by = Window.partitionBy("source", "event_id").orderBy("no")
    run = each.withColumn("run", F.col("no") - F.row_number().over(by))  # equal along versions without a gap
    along = Window.partitionBy("source", "event_id", "run").orderBy("no")
    kept = run.withColumn("agenda_text", F.last("agenda_text", ignorenulls=True).over(along))
    return kept.where(F.col("no") == F.col("of")).select("source", "event_id", "title", "agenda_text")
