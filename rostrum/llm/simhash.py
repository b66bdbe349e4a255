"""SimHash near-duplicates by multi-index hashing.

A fingerprint's two 32-bit halves are the segments. Two fingerprints at most two bits apart agree in one half but for
one bit, so each fingerprint looks up the Hamming ball of radius one around both halves in the tables of halves and
verifies the complete distance of what it finds. A bucket of a table with more than `bucket_limit` fingerprints isn't
crossed: its fingerprints and those that look it up are linked through the points one bit from both, an exact way whose
groups hold 65 fingerprints at most."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.llm.common import join_by_hot_key, own_names, stage_table

SEED = 42
HALF = 0xFFFFFFFF


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text, as a signed long; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(g), SEED) for g in grams), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(x) for x in text], dtype="int64")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def flips(value: Column, bits: int) -> Column:
    """value and all that differ from it in one of the lowest bits."""
    masks = [(1 << b) - (1 << 64) * (b == 63) for b in range(bits)]
    return F.array(value, *[value.bitwiseXOR(F.lit(m).cast("long")) for m in masks])


def near_pairs(fps: DataFrame, max_bits: int = 2, bucket_limit: int = 64) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints of fps (column fp): every pair at most two bits apart is
    linked directly or through a third fingerprint that is at most two bits from both."""
    if max_bits != 2:
        raise ValueError("two segments with balls of radius one reach two bits")
    halves = F.array(F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("val")), F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(HALF)).alias("val")))
    entries = fps.select("fp", F.inline(halves))
    sizes = entries.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n"))
    table = stage_table(entries.join(sizes, ["seg", "val"]).select("seg", "val", F.col("fp").alias("g"), "n"), "segments")
    tables = table.where(F.col("n") <= bucket_limit).select("seg", "val", "g").unionByName(table.where(F.col("n") > bucket_limit).select("seg", "val", F.lit(None).cast("long").alias("g")).distinct())
    probes = entries.select("fp", "seg", F.explode(flips(F.col("val"), 32)).alias("val"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("g")))
    met = stage_table(probes.join(tables.hint("merge"), ["seg", "val"]).where(F.col("g").isNull() | ((F.col("fp") < F.col("g")) & (apart <= max_bits))).select("fp", "g").distinct(), "met")
    crowded = met.where(F.col("g").isNull()).select("fp")
    between = crowded.select("fp", F.explode(flips(F.col("fp"), 64)).alias("mid"))
    stars = between.groupBy("mid").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a < b")
    return met.where(F.col("g").isNotNull()).select(F.col("fp").alias("a"), F.col("g").alias("b")).unionByName(stars).distinct()


#: Rows of two longs that are broadcast rather than shuffled: 16 MB.
FEW = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if a count proves that it has at most FEW rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root): for each node of links (a, b) the smallest node it is connected with. Each round takes the
    smallest root of the neighbours and then the root's own root, so that long chains halve."""
    links = stage_table(links, "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = stage_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    small = roots.limit(FEW + 1).count() <= FEW
    for _ in range(max_rounds):
        sent = F.broadcast(roots) if small else roots
        seen = both.join(sent, both["b"] == sent["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        better = stage_table(seen.join(sent, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")), "better")
        up = better.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = stage_table(better.join(F.broadcast(up) if small else up, "root").select("node", "was", F.least("root", "up").alias("root")), "roots")
        roots = new.select("node", "root")
        if new.where(F.col("root") != F.col("was")).limit(1).count() == 0:
            return roots
    raise RuntimeError(f"components not found in {max_rounds} rounds")


def groups(marked: DataFrame, max_bits: int = 2, bucket_limit: int = 64) -> tuple[DataFrame, int]:
    """For rows (doc_id, fp, ...): each fp once, with n (its rows), root (the smallest fp connected) and component_id (the
    smallest doc_id connected); and the number of rows."""
    own = stage_table(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    found = rooted_groups(own, components(near_pairs(own.select("fp"), max_bits, bucket_limit)))
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return found, total


def rooted_groups(own: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, n, root, component_id) of own (fp, least, n) and the (node, root) of those that are connected."""
    rooted = own.join(few(roots.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stage_table(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return stage_table(rooted.join(least, "root").select("fp", "n", "root", "component_id"), "groups")


def near_duplicates(docs: DataFrame, max_bits: int = 2, bucket_limit: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    Texts that are null or have no words have fingerprint zero and are linked like any other. Repeated rows are
    returned as often as they come. A null doc_id is never the smallest; a component of null ids only has a null id.
    An empty table gives an empty one. Columns other than doc_id and text play no part."""
    marked = stage_table(docs.select("doc_id", fingerprint("text").alias("fp")), "marked")
    found, total = groups(marked, max_bits, bucket_limit)
    return join_by_hot_key(marked, found.select("fp", "n", "component_id"), "fp", "n", total)


@own_names
def keep_one(docs: DataFrame, max_bits: int = 2, bucket_limit: int = 64) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id (of rows that share it, any one)."""
    marked = stage_table(docs.withColumn("_fp", fingerprint("text")), "printed")
    found, _ = groups(marked.select("doc_id", F.col("_fp").alias("fp")), max_bits, bucket_limit)
    return one_of_each(docs, marked, found)


def one_of_each(docs: DataFrame, marked: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs, which marked holds with their _fp, that stand for the groups found."""
    first = marked.select("doc_id", F.col("_fp").alias("fp")).join(found.where(F.col("component_id").isNotNull()).select("fp", "root", F.col("component_id").alias("doc_id")), ["fp", "doc_id"])
    # where a document id is repeated, or all ids of a component are null, any row of its smallest fingerprint stands for it
    chosen = first.groupBy("root", "doc_id").agg(F.min("fp").alias("fp"), F.count(F.lit(1)).alias("_rows"))
    nulls = found.where(F.col("component_id").isNull()).groupBy("root").agg(F.min("fp").alias("fp"), F.lit(2).cast("long").alias("_rows")).select("root", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "fp", "_rows")
    reps = stage_table(chosen.unionByName(nulls).select(F.col("doc_id").alias("_doc"), F.col("fp").alias("_rep"), "_rows"), "reps")
    kept = marked.join(reps, (F.col("_fp") == F.col("_rep")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    once = kept.where("_rows = 1").select(*docs.columns)
    return once.unionByName(kept.where("_rows > 1").dropDuplicates(["_rep", "_doc"]).select(*docs.columns))
