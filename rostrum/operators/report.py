"""Numbers in drafts, and whether they can be traced to the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that scale a number.
MAGNITUDES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "billion": 1e9}
NUMBER = r"([−-]?)\$?(\d[\d,]*(?:\.\d+)?)(?:\s?(k|thousand|million|billion|m)\b)?"


def numbers(drafts: DataFrame, text: str = "text") -> DataFrame:
    """drafts' other columns with place, value and digits of each number outside code fences.

    A true minus makes a number negative; a hyphen does unless a letter or digit stands before it. digits are the significant
    ones as written, trailing zeros not counted, two at least."""
    clean = F.regexp_replace(text, r"(?s)```.*?```", "")
    # a number with the character before it: expressions give groups but no offsets
    found = F.regexp_extract_all(clean, F.lit(f"(?i)((?:^|[^0-9,.])?{NUMBER})"), 1)
    out = drafts.select(*[c for c in drafts.columns if c != text], F.posexplode(found).alias("place", "raw"))
    digits = F.regexp_extract("raw", r"(\d[\d,]*(?:\.\d+)?)", 1)
    sign = F.regexp_extract("raw", r"([−-]?)\$?\d", 1)
    before = F.regexp_extract("raw", r"^([A-Za-z0-9])-", 1)
    word = F.lower(F.regexp_extract("raw", r"(?i)\d\s?(k|thousand|million|billion|m)$", 1))
    scale = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MAGNITUDES.items() for x in kv]), word), F.lit(1.0))
    size = F.regexp_replace(digits, ",", "").cast("double") * scale
    negative = (sign == "−") | ((sign == "-") & (before == "") & ~F.lag("raw", 1, "").over(_window(drafts, text)).rlike(r"\d$"))
    written = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(digits, "[,.]", ""), "^0+", ""), "0+$", ""))
    return out.withColumn("value", F.when(negative, -size).otherwise(size)).withColumn("digits", F.greatest(written, F.lit(2))).drop("raw")


def _window(drafts: DataFrame, text: str):
    from pyspark.sql import Window

    return Window.partitionBy(*[c for c in drafts.columns if c != text]).orderBy("place")


def untraceable(found: DataFrame, allowed: DataFrame) -> DataFrame:
    """Numbers that match no allowed value: exactly once rounded, within half a percent, or within half a unit of the last
    digit written. allowed are a report's figures, a few hundred, and are broadcast once counted."""
    if allowed.limit(10_001).count() > 10_000:
        raise ValueError("over 10,000 allowed values")
    a, v = F.col("_a"), F.col("value")
    quantum = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(a))) - F.col("digits") + 1)
    near = F.when(a == 0, F.abs(v) < 1e-9).otherwise((F.abs(v - a) < 0.005 * F.abs(a)) | (F.abs(v - a) <= 0.51 * quantum))
    same = (v == a) | (F.bround(v) == a) | (F.bround(v, 1) == a) | (F.bround(v, 2) == a)
    return found.join(F.broadcast(allowed.select(F.col("value").alias("_a"))), same | near, "left_anti")
