"""Joins with patterns: identifiers with wildcards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the pieces on which values and patterns meet.
PIECE = 3


def pattern_join(values: DataFrame, patterns: DataFrame, value: str, pattern: str) -> DataFrame:
    """Rows of values and patterns where the value is like the pattern: `*` stands for any characters, `?` for one.

    A pattern's fixed stretches are cut into pieces of up to PIECE characters, and the pattern waits at the rarest of them among
    the values; a value looks up its own pieces and is then compared in full. Patterns without a fixed character are alike but for
    their least length; each distinct one meets the values of a length that it allows. Columns of both must have different
    names. Null values and patterns match nothing."""
    rows = values.where(F.col(value).isNotNull())
    asked = patterns.where(F.col(pattern).isNotNull())
    distinct = asked.select(F.col(pattern).alias("_p")).distinct()
    fixed = F.filter(F.split("_p", r"[*?]+"), lambda s: s != "")
    width = F.least(F.lit(PIECE), F.array_max(F.transform(fixed, lambda s: F.length(s))))
    own = distinct.withColumn("_fixed", fixed).withColumn("_width", F.when(F.size("_fixed") > 0, width).otherwise(0))
    cuts = F.flatten(F.transform(F.filter("_fixed", lambda s: F.length(s) >= F.col("_width")), lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - F.col("_width") + 1), lambda i: F.substring(s, i, F.col("_width")))))
    pieces = own.where("_width > 0").select("_p", F.explode(F.array_distinct(cuts)).alias("_piece"))
    names = rows.select(F.col(value).alias("_v")).distinct()
    widths = F.array(*[F.lit(w) for w in range(1, PIECE + 1)])
    parts = F.flatten(F.transform(widths, lambda w: F.when(F.length("_v") >= w, F.transform(F.sequence(F.lit(1), F.greatest(F.length("_v") - w + 1, F.lit(1))), lambda i: F.substring(F.col("_v"), i, w))).otherwise(F.array().cast("array<string>"))))
    entries = names.select("_v", F.explode(F.array_distinct(parts)).alias("_piece")).join(pieces.select("_piece").distinct(), "_piece", "left_semi")
    seen = entries.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    at = pieces.join(seen, "_piece", "left").groupBy("_p").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_piece")).alias("r")).select("_p", F.col("r._piece").alias("_piece"))
    quoted = F.regexp_replace("_p", r"([^*?]+)", r"\\Q$1\\E")
    regex = F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit(r"\z"))
    met = at.join(entries, "_piece").where(F.rlike("_v", regex)).select("_p", "_v")
    open_ = own.where("_width = 0").select("_p", F.length(F.translate("_p", "*", "")).alias("_least"), F.contains("_p", F.lit("*")).alias("_more"))
    lengths = names.select("_v", F.length("_v").alias("_length"))
    longest = lengths.agg(F.coalesce(F.max("_length"), F.lit(0))).first()[0]
    to = F.when(F.col("_more"), F.greatest("_least", F.lit(longest))).otherwise(F.col("_least"))
    wanted = open_.select("_p", F.explode(F.sequence("_least", to)).alias("_length"))
    met = met.unionByName(wanted.join(lengths, "_length").select("_p", "_v"))
    return rows.join(met, F.col(value) == F.col("_v")).join(asked, F.col("_p") == F.col(pattern)).drop("_v", "_p")
