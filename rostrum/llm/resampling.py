"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A document's log importance weight is the sum, over its hashed words and word pairs, of ln(target share / raw share) of
their buckets. A Gumbel draw is added to each weight and the k largest sums are kept, which samples k documents without
replacement in proportion to the weights. k is found by counting, digit by digit, never by sorting into one task."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.llm.common import own_names, stage_table

BUCKETS = 1 << 15


def grams_of(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every word and of every pair of neighbouring words of a text, lower-cased A-Z."""
    h = np.fromiter(map(zlib.crc32, (text or "").encode().lower().split()), dtype=np.uint64)
    return np.concatenate([h % buckets, (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) % np.uint64(0xFFFFFFFB) % buckets]).astype(np.int64)


def gram_counts(docs: DataFrame, target_ids: set[int], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over all rows and over the target rows. Each task sends a row for each bucket at most."""
    ids = docs.sparkSession.sparkContext.broadcast(target_ids)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                g = np.bincount(grams_of(text, buckets), minlength=buckets)
                raw += g
                if doc in ids.value:
                    target += g
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "target": target[at]})

    rows = docs.select("doc_id", "text").mapInPandas(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for b, r, t in rows:
        raw[b], target[b] = r, t
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """ln of target over raw share by bucket; both shares are smoothed with the mean of a bucket's raw share."""
    p = (raw + 1) / (raw.sum() + len(raw))
    return np.log((target + 50 * p * (target.sum() > 0)) / (target.sum() + 50)) - np.log(p) if target.sum() else np.zeros(len(raw))


def gumbel(h: np.ndarray) -> np.ndarray:
    """A Gumbel draw for each 64-bit hash."""
    u = ((h.astype(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def kth_largest(df: DataFrame, order: str, k: int, digit: int = 16) -> int | None:
    """The k-th largest of a column of longs, found from the top digit down; each count has 2**digit rows at most."""
    if k <= 0:
        return None
    prefix, left, shifted = None, k, F.col(order).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    for low in range(64 - digit, -1, -digit):
        own = df if prefix is None else df.where(F.shiftrightunsigned(shifted, low + digit) == prefix)
        counts = own.groupBy(F.shiftrightunsigned(shifted, low).bitwiseAND(F.lit((1 << digit) - 1)).alias("d")).count().collect()
        for d, n in sorted(counts, reverse=True):
            if n >= left:
                prefix = d if prefix is None else (prefix << digit) | d
                if prefix >= 1 << 63:
                    prefix -= 1 << 64
                break
            left -= n
        else:
            return None
    return struct.unpack("<q", struct.pack("<Q", (prefix & ((1 << 64) - 1)) ^ (1 << 63)))[0]


@own_names
def importance(docs: DataFrame, labels: DataFrame, *, keep_share: float | None = None, max_labels: int = 50_000, buckets: int = BUCKETS, seed: int = 11) -> DataFrame:
    """docs with dsir_weight (log importance), dsir_key (weight and Gumbel draw) and dsir_kept.

    The target model is fitted on at most max_labels labelled rows, drawn by a hash of doc_id; the raw model counts all
    rows. keep_share is the share of rows to keep; by default the share of good ones among the drawn labels of these rows.
    Without labels all rows are kept. Null and empty texts have weight 0. Rows with the same id, text and key have one
    fate: where they tie at the cut, all of them are kept. Other columns are kept; one of ours
    takes the place of one of the same name."""
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    drawn = labels.where("quality in (0, 1)").join(ids, "doc_id", "left_semi").select("doc_id", "quality").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "quality").limit(max_labels).collect()
    target = {r["doc_id"] for r in drawn if r["quality"] == 1}
    share = keep_share if keep_share is not None else (len([r for r in drawn if r["quality"] == 1]) / len(drawn) if drawn else 1.0)
    raw, chosen = gram_counts(docs, target, buckets)
    ratio = spark.sparkContext.broadcast(log_ratio(raw, chosen))

    @F.pandas_udf(T.DoubleType())
    def weigh(text: pd.Series) -> pd.Series:
        return pd.Series([float(ratio.value[grams_of(x, buckets)].sum()) for x in text], dtype="float64")

    @F.pandas_udf(T.DoubleType())
    def draw(h: pd.Series) -> pd.Series:
        return pd.Series(gumbel(h.to_numpy().view(np.uint64)))

    scored = docs.withColumn("dsir_weight", weigh("text")).withColumn("dsir_key", F.col("dsir_weight") + draw(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))))
    # a double's bits, turned so that longs order as the doubles do
    scored = scored.withColumn("_order", order_of("dsir_key"))
    scored = stage_table(scored, "weighed")
    k = int(round(share * scored.count()))
    least = kth_largest(scored.select("_order"), "_order", k)
    kept = F.lit(False) if least is None else F.col("_order") >= F.lit(least).cast("long")
    return scored.withColumn("dsir_kept", kept).drop("_order")


@F.pandas_udf(T.LongType())
def order_of(x: pd.Series) -> pd.Series:
    bits = (x.to_numpy(dtype="float64") + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@own_names
def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that importance() keeps."""
    return importance(docs, labels, **options).where("dsir_kept").select(*docs.columns)
