"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is a stream of its documents in a random order, repeated as often as its target asks. The stream is cut
into blocks of words; the tree hands exact block quotas of every source down to the output shards; each shard draws
its own disjoint range of each source's permuted blocks; inside a shard the documents are shuffled."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.llm.common import n_words, own_names, running_total

#: Sources are named and weighed one by one; more of them than this are a sign of a wrong column.
MAX_SOURCES = 100_000
#: Cells of the table of sources x shards, which the driver draws and broadcasts: 32 MB at most.
MAX_CELLS = 1 << 22
#: numpy draws from populations below 10**9.
MAX_BLOCKS = 500_000_000


def water_fill(sizes: Sequence[int], weights: Sequence[float], max_repeat: float, total: float) -> list[float]:
    """Shares of total by weight, none above max_repeat times its size; what is cut off is shared again by weight."""
    caps = [max_repeat * s for s in sizes]
    capped: set[int] = set()
    while True:
        left = total - sum(caps[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        level = left / weight if weight else 0.0
        over = {i for i, w in enumerate(weights) if i not in capped and level * w > caps[i]}
        if not over:
            return [float(caps[i]) if i in capped else level * w for i, w in enumerate(weights)]
        capped |= over


def splitting_tree(quotas: Sequence[int], n_shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (rows) in each shard (columns). Each node gives its left child a random draw, without
    replacement, of its blocks; rows sum to the quotas exactly, and shard sizes differ by one at most per level."""
    counts = np.zeros((len(quotas), n_shards), dtype=np.int64)
    nodes = [(0, n_shards, np.asarray(quotas, dtype=np.int64))]
    while nodes:
        a, b, own = nodes.pop()
        if b - a == 1:
            counts[:, a] = own
            continue
        half = (a + b) // 2
        rng = np.random.default_rng([seed, a, b])
        take = int(own.sum()) * (half - a) // (b - a)
        left = rng.multivariate_hypergeometric(own, take, method="marginals")
        nodes += [(a, half, left), (half, b, own - left)]
    return counts


def coprime(k: int, rng: np.random.Generator) -> int:
    """A factor that permutes 0..k-1 under multiplication modulo k."""
    a = int(rng.integers(1, max(2, k)))
    while math.gcd(a, k) != 1:
        a += 1
    return a


def plan(sizes: Sequence[int], weights: Sequence[float], max_repeat: int, block_words: int, shard_words: int, seed: int) -> dict:
    """Targets, block quotas, the tree's shard offsets and the block permutations; lists run along the sources."""
    total = sum(sizes)
    targets = water_fill(sizes, weights, max_repeat, total)
    takes = [min(round(t), max_repeat * s) for t, s in zip(targets, sizes, strict=True)]
    block = max(block_words, -(-sum(takes) // MAX_BLOCKS))
    quotas = [-(-t // block) for t in takes]
    n_shards = max(1, min(-(-sum(takes) // shard_words), MAX_CELLS // max(1, len(sizes))))
    counts = splitting_tree(quotas, n_shards, seed)
    rng = np.random.default_rng([seed, len(quotas)])
    return {"targets": targets, "takes": takes, "block": block, "quotas": quotas, "n_shards": n_shards, "ends": counts.cumsum(axis=1), "perm": [(coprime(k, rng), int(rng.integers(0, max(1, k)))) for k in quotas]}


@own_names
def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), weight_of: Callable[[str | None, int], float] | None = None, max_repeat: int = 3, block_words: int = 4096, shard_words: int = 1 << 22, seed: int = 7) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_taken and mix_pieces, an array of (shard, place, epoch, n_words).

    Sources in code-point order, null last, weigh `weights` in turn (or weight_of(source, rank)). Each source's taken
    words equal its target rounded; only the last document of a stream's last pass is taken in part. A document without
    words, or with null text, has no pieces. Repeated rows are documents of their own. An empty table gives an empty
    one. Other columns are kept; a column of ours takes the place of one of the same name."""
    spark = docs.sparkSession
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    sized = docs.withColumn("mix_size", n_words(F.col("text"))).withColumn("_source", key)
    found = sized.groupBy("_source").agg(F.sum("mix_size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources: mix by a coarser column")
    found = sorted(found, key=lambda r: r["_source"].encode())
    sizes = [r["n"] for r in found]
    w = [weight_of(r["_source"][1:] if r["_source"][0] == "0" else None, i) if weight_of else weights[i % len(weights)] for i, r in enumerate(found)]
    p = plan(sizes, w, max_repeat, block_words, shard_words, seed)
    rows = [(r["_source"], i, sizes[i], p["targets"][i], p["takes"][i], max(1, p["quotas"][i]), *p["perm"][i]) for i, r in enumerate(found)]
    table = spark.createDataFrame(rows, "_source string, _index int, mix_source_size long, mix_target double, _take long, _blocks long, _mul long, _add long")
    ends = spark.sparkContext.broadcast(p["ends"])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def shards(index: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([np.searchsorted(ends.value[i], x, side="right").astype(np.int32) for i, x in zip(index, places, strict=True)])

    row = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    out = sized.join(F.broadcast(table), "_source").withColumn("_hash", row)
    out = running_total(out, ["_index"], "_hash", ["doc_id"], F.col("mix_size"), "_before")
    start = lambda e: F.col("_before") + e * F.col("mix_source_size")
    words = lambda e: F.greatest(F.lit(0), F.least(F.col("mix_size"), F.col("_take") - start(e)))
    place = lambda e: ((F.floor(start(e) / F.lit(p["block"])) * F.col("_mul") + F.col("_add")) % F.col("_blocks")).cast("long")
    passes = F.filter(F.sequence(F.lit(0), F.lit(max_repeat - 1)), lambda e: words(e) > 0)
    out = out.withColumn("_passes", passes).withColumn("_shards", shards("_index", F.transform("_passes", place)))
    piece = F.transform("_passes", lambda e, i: F.struct(F.col("_shards")[i].alias("shard"), F.xxhash64(F.lit(seed), F.col("_shards")[i], F.col("_hash"), e).alias("place"), e.alias("epoch"), words(e).alias("n_words")))
    out = out.withColumn("mix_pieces", piece).withColumn("mix_taken", F.aggregate("mix_pieces", F.lit(0).cast("long"), lambda s, x: s + x["n_words"]))
    return out.select(*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_pieces")


@own_names
def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: docs' columns, a row for each piece, dealt to its shard and shuffled inside it.

    The text of a piece taken in part is the document's start, up to its last taken word."""
    pieces = mix(docs, **options).select(*docs.columns, "mix_size", F.explode("mix_pieces").alias("_piece"))
    units = F.split(F.col("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    cut = F.array_join(F.slice(units, F.lit(1), F.col("_piece.n_words").cast("int")), "")
    text = F.when(F.col("_piece.n_words") < F.col("mix_size"), cut).otherwise(F.col("text"))
    pieces = pieces.withColumn("text", text)
    if "n_chars" in docs.columns:
        pieces = pieces.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return pieces.repartition(F.col("_piece.shard"), F.pmod(F.col("_piece.place"), F.lit(64))).sortWithinPartitions("_piece.shard", "_piece.place").select(*docs.columns)
