"""Relational operators with a defined order: every limit and every "first" has a unique key behind it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators.folds import ordered_fold


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Equality filters; a parameter that is None filters nothing."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def between_dates(df: DataFrame, column: str, first=None, last=None) -> DataFrame:
    """Both ends included; a bound that is None is open."""
    if first is not None:
        df = df.where(F.col(column) >= F.lit(first).cast("date"))
    return df if last is None else df.where(F.col(column) <= F.lit(last).cast("date"))


def look_back(df: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    return df.where(F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days))


def contains_text(column: Column, needle: str) -> Column:
    """Literal, case-insensitive substring: no wildcards."""
    return F.contains(F.lower(column), F.lit(needle.strip().lower()))


def like_text(column: Column, needle: str) -> Column:
    """Case-insensitive pattern in which the needle's % and _ are wildcards."""
    return column.ilike(f"%{needle}%")


def checked_query(q: str, limit: int = 50, days: int | None = None) -> None:
    if not 2 <= len(q) <= 200:
        raise ValueError("q: 2 to 200 characters")
    if not 1 <= limit <= 200:
        raise ValueError("limit: 1 to 200")
    if days is not None and not 7 <= days <= 730:
        raise ValueError("days: 7 to 730")


def search_forms(q: str) -> tuple[str, str]:
    """(needle, raw) of a query whose raw length is checked: substrings are looked for without its outer white space and in
    lower case, vectors are made from it as it is."""
    checked_query(q)
    return q.strip().lower(), q


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The n first rows of each key by order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, place).where(F.col(rank) <= n)


def last_value_by(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str) -> DataFrame:
    """The value of the greatest row by order where it isn't null; one aggregation, no sort."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(out))


def count_per_parent(parents: DataFrame, children: DataFrame, key: str, out: str) -> DataFrame:
    """parents with the number of their children, zero where there are none."""
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return parents.join(counts, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def related(members: DataFrame, node: str, event: str, eligible: DataFrame, least: int = 2, top: int = 6) -> DataFrame:
    """(node, other, shared): the `top` eligible others that share at least `least` distinct events with each node.

    The pairs of an event are counted in the join's own aggregation; they are never kept."""
    left = members.select(F.col(node), F.col(event)).distinct()
    right = left.join(eligible.select(node), node, "left_semi").select(F.col(node).alias("other"), F.col(event))
    pairs = left.join(right, event).where(F.col(node) != F.col("other")).groupBy(node, "other").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    return latest_by(pairs, [node], [F.col("shared").desc(), F.col("other").asc()], top)


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The last value that isn't null up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def chapters(items: DataFrame, meeting: str, start: str, duration: str, tie: str, least: int = 2) -> DataFrame:
    """Segments of a recording: from each start to the next, the last to the end. Starts at or past the end are dropped, and
    so are recordings with fewer than `least` segments."""
    own = items.where(F.col(start).isNotNull() & F.col(duration).isNotNull() & (F.col(start) < F.col(duration)))
    w = Window.partitionBy(meeting).orderBy(start, tie)
    whole = Window.partitionBy(meeting)
    return own.withColumn("seconds", F.greatest(F.lit(0), F.coalesce(F.lead(start, 1).over(w), F.col(duration)) - F.col(start))).withColumn("lead_in", F.min(start).over(whole)).withColumn("n", F.count(F.lit(1)).over(whole)).where(F.col("n") >= least).drop("n")


def merge_segments(segments: DataFrame, meeting: str, order: str, start: str, end: str, text: str, size: int = 700) -> DataFrame:
    """(meeting, part, start, end, text): consecutive segments joined until their text reaches `size` characters, a fold over
    each meeting's ordered segments that holds one part at a time."""
    times = [F.col(c).cast("double").alias(n) for c, n in ((start, "_start"), (end, "_end"))]
    rows = segments.select(F.col(meeting), F.col(order).alias("_order"), *times, F.col(text).alias("_text"))
    kind = rows.schema[meeting].dataType.simpleString()

    def part(s: list) -> tuple:
        return (s[0], s[1], s[2], " ".join(s[3]) if s[3] or s[5] > 1 else None)

    def step(s: list, row: tuple):
        done = ()
        if s[5] and s[4] >= size:
            done = (part(s),)
            s[:] = [s[0] + 1, None, None, [], 0, 0]
        if not s[5]:
            s[1] = row[0]
        s[2] = row[1]
        if row[2] is not None:
            s[4] += len(row[2]) + bool(s[3])
            s[3].append(row[2])
        s[5] += 1
        return done

    return ordered_fold(rows, [meeting], ["_order", "_start", "_end", "_text"], ["_start", "_end", "_text"], f"`{meeting}` {kind}, part int, start double, end double, text string", lambda: [0, None, None, [], 0, 0], step, lambda s: (part(s),))


def first_per_label(build: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return latest_by(build, keys, [F.col(c) for c in order]).drop("rank")


def normalized_label(label: Column) -> Column:
    return F.lower(F.rtrim(label, F.lit(".")))


def exclusive_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """Quantile at rank q * (n + 1) with linear interpolation, clipped to the ends."""
    by = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(by)
    rank = F.row_number().over(by.orderBy(value))
    at = F.least(F.greatest(F.lit(q) * (F.col("_n") + 1), F.lit(1.0)), F.col("_n").cast("double"))
    low = F.floor(at)
    share = F.when(F.col("_r") == low, 1 - (at - low)).when(F.col("_r") == low + 1, at - low).otherwise(0.0)
    return df.where(F.col(value).isNotNull()).withColumn("_n", n).withColumn("_r", rank).groupBy(*keys).agg(F.sum(share * F.col(value)).alias(out))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """A quality gate: df, but reading a row that breaks the condition fails with the message."""
    return df.where(F.when(condition, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def duplicated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that aren't unique, with their rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

