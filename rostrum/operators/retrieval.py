"""Keyword and vector retrieval, and how their results are joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: Sequence[float], k: int = 8, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest rows by cosine distance, exact; distances are compared to nine places, then keys."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.col(column).isNotNull()).withColumn("distance", F.round(cosine_distance(F.col(column), q), 9)).orderBy("distance", key).limit(k)


def keyword(df: DataFrame, text: Column, needle: str, order: Sequence[Column], limit: int = 20) -> DataFrame:
    from rostrum.operators.relational import contains_text

    return df.where(contains_text(text, needle)).orderBy(*order).limit(limit)


def first_of(parts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """The parts' rows, one for each key: that of the earliest part. Parts have the same columns."""
    out = None
    for i, p in enumerate(parts):
        own = p.withColumn("source_rank", F.lit(i))
        out = own if out is None else out.unionByName(own)
    best = out.groupBy(*key).agg(F.min_by(F.struct(*[c for c in out.columns if c not in key]), "source_rank").alias("_row"))
    return best.select(*key, "_row.*")


def merge_by_distance(parts: Sequence[DataFrame], keep: int = 12) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("distance", "kind", "id").limit(keep)
