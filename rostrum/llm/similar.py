"""Near-duplicates by the Jaccard similarity of word shingles: SimHash fingerprints in a multi-index, and an exact way for the rest.

Each set of shingles has a fingerprint, which is looked up in the tables of `simhash`; what is found there is verified on the
complete sets. Sets of a similarity of 0.8 mostly differ in more bits than any such table reaches, so prefix filtering finds
all others. Two sets of which the intersection is at least `least` of the union share one of the first n - ceil(least * n) + 1 members
of each, under any order that is the same for all sets. Shingles seen often in a sample of the texts come last in that
order, which only keeps the buckets of a shingle small: it doesn't decide what is found. Every pair that meets in a bucket
and could be similar by its sizes, its places and the members its prefixes share is verified on the complete sets, unless both
are already connected. Members of crowded buckets are first compared with one leader each, so that a large group of copies
is connected by as many comparisons as it has members."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm.common import give_back, own_names, stage_table
from rostrum.llm.simhash import components, few, near_pairs, one_of_each, rooted_groups

WIDTH = 5
LEAST = 0.8
#: Texts of which shingles are counted for the order, and how often one must occur there to come later.
SAMPLE, OFTEN = 20_000, 3
#: Buckets before one in which two sets may have met already.
BEFORE = 8
#: Keys that are broadcast rather than shuffled with the texts.
MANY = 1_000_000
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; all words are one shingle where there are fewer than width."""
    words = (text or "").encode().lower().split()  # as for fingerprints
    if not words:
        return np.zeros(0, np.int64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * MIX[0] + own[i : i + len(h)]
    for m in MIX[1:]:
        h = (h ^ (h >> np.uint64(32))) * m
    return np.unique((h ^ (h >> np.uint64(32))).view(np.int64))


def set_key(text: str | None, width: int = WIDTH) -> int:
    own = shingles(text, width)
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64)) if len(own) else 0


def fingerprint(own: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed long: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 15):
        ones += np.unpackbits(own[at : at + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view(np.int64)[0])


def prefix(own: np.ndarray, often: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The members of a set by which it is found; `often` (sorted) and `counts` say which come late."""
    size = len(own) - math.ceil(least * len(own) - 1e-9) + 1
    if len(often) and len(own):
        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
        own = own[np.lexsort((own, np.where(often[at] == own, counts[at], 0)))]
    return own[:size]


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same >= least * (len(a) + len(b) - same) - 1e-9


def buckets(marked: DataFrame, least: float, width: int) -> tuple[DataFrame, DataFrame]:
    """For rows (_fp, text) of marked, (key, n, first, print) of each distinct set of n shingles: its prefix and its
    fingerprint; and (h, key, n, left, w): the sets under those of their prefix that another set's prefix has too. Members that
    the same sets have are one bucket h, of w members: a shared passage isn't met once for each of its shingles. (Two buckets
    whose hash h is the same only meet more.) left counts the members of the set's prefix from there on, in the order of how
    many prefixes have them."""
    spark = marked.sparkSession

    @F.pandas_udf("array<long>")
    def all_of(text: pd.Series) -> pd.Series:
        return pd.Series([shingles(x, width) for x in text])

    part = max(1, marked.count() // SAMPLE)
    some = marked.where(F.pmod(F.xxhash64("_fp"), F.lit(part)) == 0).select(F.explode(all_of("text")).alias("h"))
    late = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN).toArrow()
    h, n = (late[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("h", "n"))
    order = np.argsort(h)
    often = spark.sparkContext.broadcast((h[order], n[order]))

    @F.pandas_udf("n int, first array<long>, print long")
    def first_of(text: pd.Series) -> pd.DataFrame:
        sets = [shingles(x, width) for x in text]
        out = pd.DataFrame({"n": [len(x) for x in sets], "first": [prefix(x, *often.value, least) for x in sets], "print": [fingerprint(x) for x in sets]})
        del sets
        give_back()
        return out

    own = marked.select(F.col("_fp").alias("key"), first_of("text").alias("p")).groupBy("key").agg(F.first("p").alias("p"))
    own = stage_table(own.select("key", "p.n", "p.first", "p.print"), "prefixes")
    entries = own.select("key", "n", F.explode("first").alias("h"))
    met = entries.groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("key")).alias("all")).where("members > 1")
    from_here = F.row_number().over(Window.partitionBy("key").orderBy(F.col("members").desc(), F.col("h").desc()))
    shared = entries.join(met, "h").withColumn("left", from_here).groupBy("key", "all").agg(F.first("n").alias("n"), F.max("left").alias("left"), F.count(F.lit(1)).alias("w"))
    return own, stage_table(shared.withColumnRenamed("all", "h"), "shared")


def printed_pairs(own: DataFrame) -> DataFrame:
    """Pairs (a, b) of the sets of own (key, print) whose fingerprints the multi-index links, one set for each fingerprint,
    and of the other sets of a fingerprint with that one."""
    one = stage_table(own.groupBy("print").agg(F.min("key").alias("key")), "prints")
    met = near_pairs(one.select(F.col("print").alias("fp")))
    by = lambda x: one.select(F.col("print").alias(x), F.col("key").alias(f"k{x}"))
    apart = met.join(by("a"), "a").join(by("b"), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    same = own.select("print", F.col("key").alias("b")).join(one.withColumnRenamed("key", "a"), "print").where("a != b").select("a", "b")
    return apart.unionByName(same)


def links(marked: DataFrame, least: float = LEAST, width: int = WIDTH, crowd: int = 64, rounds: int = 6) -> DataFrame:
    """(node, root) of the distinct sets of marked (_fp, text) that are similar to another one: components of all pairs.

    What the fingerprints link comes first. Leaders are compared, for at most `rounds` rounds, while buckets of over `crowd` rows
    hold more than four unconnected pairs for each of their rows and a round connects half of those at least; then all
    unconnected pairs are."""
    own, shared = buckets(marked, least, width)

    @F.pandas_udf("binary")
    def packed(text: pd.Series) -> pd.Series:
        out = pd.Series([shingles(x, width).tobytes() for x in text])
        give_back()
        return out

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), least) for x, y in zip(a, b, strict=True)], dtype="bool")

    def verified(pairs: DataFrame) -> DataFrame:
        """The similar ones of pairs (a, b); a may be a hot key."""
        pairs = stage_table(pairs, "candidates")
        keys = stage_table(pairs.select(F.col("a").alias("_fp")).unionByName(pairs.select(F.col("b").alias("_fp"))).distinct(), "keys")
        texts = marked.join(F.broadcast(keys) if keys.count() <= MANY else keys, "_fp", "left_semi").groupBy(F.col("_fp").alias("key")).agg(F.first("text").alias("text"))
        sets = stage_table(texts.select("key", packed("text").alias("s")), "sets")
        with_a = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a")
        both = with_a.join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
        return stage_table(both.where(alike("sa", "sb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "verified")

    # of two similar sets, `need` members are in both: so many of the prefixes, and what follows the one that ends first
    need = F.ceil(least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-9)
    after = F.greatest(*[F.ceil(least * F.col(n) - 1e-9) - 1 for n in ("na", "nb")])
    fits = F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9
    met = F.sum("w") >= F.first(need - after)
    found, before = verified(printed_pairs(own)), math.inf
    roots = components(found)
    for turn in range(rounds + 1):
        now = stage_table(shared.join(few(roots.withColumnRenamed("node", "key")), "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")
        parts = now.groupBy("h", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("square"), F.count(F.lit(1)).alias("roots"))
        parts = stage_table(parts.where("roots > 1"), "parts")
        crowded = parts.where(F.col("m") > crowd)
        unconnected, inside = crowded.agg(F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("square")) / 2), F.lit(0.0)), F.coalesce(F.sum("m"), F.lit(0))).first()
        if turn == rounds or unconnected <= 4 * inside or unconnected > before / 2:
            break
        before, names = unconnected, few(crowded.select("h"))
        rich = now.groupBy("key").agg(F.sum("w").alias("rich"))
        first = now.join(names, "h", "left_semi")
        ranked = first.join(rich, "key").withColumn("rank", F.col("rich") if turn == 0 else F.xxhash64("key", F.lit(turn)))
        lead = ranked.groupBy("h").agg(F.max(F.struct("rank", F.col("key").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))).alias("x")).select("h", "x.a", "x.na", "x.ra")
        stars = first.withColumnRenamed("n", "nb").join(lead, "h").where((F.col("root") != F.col("ra")) & fits)
        new = verified(stars.groupBy("a", F.col("key").alias("b")).agg(met.alias("met")).where("met").select("a", "b"))
        if new.limit(1).count() == 0:
            break
        found = found.unionByName(new)
        roots = components(found)
    # need - after members are in both prefixes: so many are left in either at the first one of them, by how many prefixes have it.
    # For the larger set b this limits the size of the smaller one a. Where one of the last buckets of both is the same, they have met.
    half = least / (1 + least)
    last = F.collect_list("h").over(Window.partitionBy("key").orderBy(F.col("left").desc(), "h").rowsBetween(-BEFORE, -1))
    open_ = stage_table(now.join(parts.select("h", (F.col("m") > crowd).alias("many")), "h").withColumn("last", last), "open")
    small = open_.select("h", "many", F.col("root").alias("ra"), F.col("key").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("last").alias("xa"))
    low, most = F.ceil(least * F.col("n") - 1e-9), (F.col("left") + F.ceil(least * F.col("n") - 1e-9) - 1) / half - F.col("n")
    large = open_.withColumn("low", low).withColumn("top", F.least(F.col("n").cast("long"), F.floor(most + 1e-6))).where("low <= top")
    large = large.select("h", "many", F.col("root").alias("rb"), F.col("key").alias("b"), F.col("n").alias("nb"), "low", "top", F.col("last").alias("xb"))
    new = F.expr("ra != rb and low <= na and na <= top and (na < nb or a < b)") & (F.col("la") >= need - after) & ~F.arrays_overlap("xa", "xb")
    meet = small.where("not many").drop("many").join(large.where("not many").drop("many"), "h").where(new).select("a", "b", "na", "nb")
    # in crowded buckets rows only meet in a class of sizes, and components do first, by what any of their sets may be
    class_of = lambda n: F.floor(F.log(n.cast("double")) / math.log(1.02)).cast("int")
    small = small.where("many").withColumn("size", class_of(F.col("na")))
    large = large.where("many").withColumn("size", F.explode(F.sequence(class_of(F.col("low")), class_of(F.col("top")))))
    large = large.join(small.select("h", "size").distinct(), ["h", "size"], "left_semi")
    some_a = small.groupBy("h", "size", "ra").agg(F.min("na").alias("na"), F.max("na").alias("na_top"), F.max("la").alias("la"))
    some_b = large.groupBy("h", "size", "rb").agg(F.min("low").alias("low"), F.max("top").alias("top"), F.max("nb").alias("nb"))
    may = F.expr("ra != rb and low <= na_top and na <= top") & (F.col("la") >= half * F.col("na") - (least - half) * F.col("nb") - 1e-6)
    two = some_a.join(some_b, ["h", "size"]).where(may).select("h", "size", "ra", "rb")
    meet = meet.unionByName(two.join(small, ["h", "size", "ra"]).join(large, ["h", "size", "rb"]).where(new).select("a", "b", "na", "nb"))
    pairs = stage_table(meet.distinct(), "meet")
    firsts = lambda x: own.select(F.col("key").alias(x), F.col("first").alias(f"f{x}"))
    pairs = pairs.join(firsts("a"), "a").join(firsts("b"), "b").where(F.size(F.array_intersect("fa", "fb")) >= need - after)
    return components(found.unionByName(verified(pairs.select("a", "b"))))


@own_names
def keep_one(docs: DataFrame, least: float = LEAST, width: int = WIDTH, crowd: int = 64) -> DataFrame:
    """docs with one row of each component of similar texts: the one with the smallest doc_id (of rows that share it, any
    one). Texts that are null or have no words are copies of each other."""

    @F.pandas_udf("long")
    def key_of(text: pd.Series) -> pd.Series:
        out = pd.Series([set_key(x, width) for x in text], dtype="int64")
        give_back()
        return out

    marked = stage_table(docs.withColumn("_fp", key_of("text")), "keyed")
    own = stage_table(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    found = rooted_groups(own, links(marked.select("_fp", "text"), least, width, crowd))
    return one_of_each(docs, marked, found)
