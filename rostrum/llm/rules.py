"""Quality rules with risk-controlled thresholds, in DataFrame functions throughout.

Each rule rejects a document whose score is above a cutoff. On labelled holdouts, for each stratum (language) and rule,
the cutoffs of a fixed grid are tested from the most lenient on: "at least `risk / rules` of the good documents of this
stratum are rejected" is refuted when the exact binomial tail of the rejections seen is small enough. Testing in a fixed
order stops at the first cutoff that isn't refuted and needs no correction along the grid; over strata and rules the
error is divided (Bonferroni). Of the cutoffs that passed, the one whose rejected bad documents outweigh the rejected
good ones most is taken; a rule that helps nowhere, or has too few labels for a proof, is left out in that stratum."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm.common import SPACE, let, n_words, own_names, stage_table

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
#: Candidate cutoffs by rule, ascending; they don't depend on the data, which the test's guarantee needs.
GRIDS: dict[str, list[float]] = {
    "symbols": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0],
    "capitals": [0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7],
    "long_words": [5.75, 6.0, 6.25, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
    "short_words": [-4.5, -4.25, -4.0, -3.75, -3.5, -3.25, -3.0, -2.75, -2.5, -2.0, -1.5, -1.0],
    "repeated_lines": [0.1, 0.2, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99],
    "repeated_words": [0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.14, 0.15, 0.16, 0.17, 0.18, 0.19],
}


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a window of `width` words found twice or more in the text, the first one included."""

    def covered(windows: Column) -> Column:
        def count(ordered: Column) -> Column:
            same = lambda j, x: F.get(ordered, j)["h"] == x["h"]
            twins = F.transform(ordered, lambda x, j: F.when(F.coalesce(same(j - 1, x), F.lit(False)) | F.coalesce(same(j + 1, x), F.lit(False)), x["i"]))
            return let(F.sort_array(F.array_compact(twins)), lambda at: F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - p, F.lit(width)))), F.lit(0), lambda s, x: s + x))

        return let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), count)

    def windows(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return let(made, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))

    return let(words, lambda w: F.when(F.size(w) <= width, F.lit(0)).otherwise(windows(w)))


@own_names
def measure(docs: DataFrame) -> DataFrame:
    """docs with rule_words, rule_chars, rule_symbols, rule_dup_lines, rule_repeats (long) and rule_scores, a struct with a
    score for each rule. Null and empty texts have zero everywhere. Windows are compared by 64-bit hashes of their words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    out = docs.select(
        *docs.columns,
        n_words(text).alias("rule_words"),
        F.length(F.translate(text, BLANK, "")).cast("long").alias("rule_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("rule_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_lines"),
        repeated_words(words_of(text)).cast("long").alias("rule_repeats"),
        upper.alias("_upper"),
    )
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    scores = F.struct(
        per("rule_symbols", "rule_words").alias("symbols"),
        per("_upper", "rule_chars").alias("capitals"),
        per("rule_chars", "rule_words").alias("long_words"),
        (-per("rule_chars", "rule_words")).alias("short_words"),
        per("_lines.dup", "_lines.all").alias("repeated_lines"),
        per("rule_repeats", "rule_words").alias("repeated_words"),
    )
    return out.select(*docs.columns, "rule_words", "rule_chars", "rule_symbols", F.col("_lines.dup").cast("long").alias("rule_dup_lines"), "rule_repeats", scores.alias("rule_scores"))


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), exact, term by term; 0 where k is at or above the mean, which refutes nothing."""
    first = n * math.log1p(-p)

    def more(a: Column, i: Column) -> Column:
        term = a["term"] + F.ln((n - i + 1).cast("double")) - F.ln(i.cast("double")) + math.log(p) - math.log1p(-p)
        return let(term, lambda t: F.struct(t.alias("term"), (F.greatest(a["sum"], t) + F.log1p(F.exp(-F.abs(a["sum"] - t)))).alias("sum")))

    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(first.alias("term"), first.alias("sum")), more, lambda a: a["sum"])
    return F.when(k >= n * p, F.lit(0.0)).when(k == 0, first).otherwise(tail)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.03, error: float = 0.05, price: float = 20.0) -> DataFrame:
    """(stratum, cuts): for each stratum the array of (rule, cutoff) that hold with confidence 1 - error together.

    measured: rows of measure() with doc_id and _stratum; labels: doc_id, quality (1 good, 0 bad; others aren't used)."""
    good = labels.where("quality in (0, 1)").select("doc_id", "quality")
    own = measured.select("doc_id", "_stratum", "rule_scores").join(good, "doc_id")
    level = lambda rule: F.size(F.filter(F.array(*map(F.lit, GRIDS[rule])), lambda c: F.col(f"rule_scores.{rule}") > c))
    levels = own.select("_stratum", "quality", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in GRIDS])))
    counts = levels.groupBy("_stratum", "rule", "level").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    grid = F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(j).alias("j"), F.lit(c).alias("cutoff")) for r, g in GRIDS.items() for j, c in enumerate(g)]))
    grid = measured.sparkSession.range(1).select(grid)
    over = F.col("level") > F.col("j")
    seen = counts.join(F.broadcast(grid), "rule").groupBy("_stratum", "rule", "j", "cutoff").agg(F.sum("good").cast("long").alias("n"), F.sum(F.when(over, F.col("good")).otherwise(0)).cast("long").alias("k"), F.sum(F.when(over, F.col("bad")).otherwise(0)).cast("long").alias("hit"))
    tests = len(GRIDS) * F.greatest(F.lit(1), F.count_distinct("_stratum"))
    allowed = counts.agg(F.ln(F.lit(error) / tests).alias("allowed"))  # one row
    refuted = log_binomial_tail(F.col("k"), F.col("n"), risk / len(GRIDS)) <= F.col("allowed")
    along = Window.partitionBy("_stratum", "rule").orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, 0)
    held = seen.crossJoin(F.broadcast(allowed)).withColumn("ok", F.min(refuted.cast("int")).over(along) == 1)
    gain = F.col("hit") - price * F.col("k")
    best = held.where(F.col("ok") & (gain > 0)).groupBy("_stratum", "rule").agg(F.max_by("cutoff", F.struct(gain, F.col("cutoff"))).alias("cutoff"))
    return best.groupBy("_stratum").agg(F.sort_array(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))


def breaks(rule: str, cut: Column) -> Column:
    return (cut["rule"] == rule) & (F.col(f"rule_scores.{rule}") > cut["cutoff"])


@own_names
def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """measure(docs) with rule_base_failed, rule_cuts (the cutoffs of its stratum) and rule_kept.

    A document fails the base when it has under ten words or over a fifth of them in repeated windows. Null strata are a
    stratum; labels whose document isn't there, and documents without a label, play no part in the fit; a document
    labelled twice counts twice. Without labels all that pass the base are kept. Repeated rows are judged one by one.
    What docs holds besides is kept; a column of ours takes the place of one of the same name."""
    measured = measure(docs).withColumn("_stratum", F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")))
    measured = stage_table(measured, "measured")
    cuts = stage_table(cutoffs(measured, labels, **options), "cutoffs")
    failed = (F.col("rule_words") < 10) | (100 * F.col("rule_repeats") > 20 * F.col("rule_words"))
    over = [F.coalesce(F.exists("cuts", partial(breaks, r)), F.lit(False)) for r in GRIDS]
    out = measured.join(cuts, "_stratum", "left")
    rejected = F.array_compact(F.array(*[F.when(x, F.lit(r)) for r, x in zip(GRIDS, over, strict=True)]))
    out = out.withColumn("rule_base_failed", failed).withColumn("rule_broken", rejected)
    return out.withColumn("rule_kept", ~failed & (F.size("rule_broken") == 0)).withColumnRenamed("cuts", "rule_cuts").drop("_stratum")


@own_names
def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that judge() keeps."""
    return judge(docs, labels, **options).where("rule_kept").select(*docs.columns)
