"""Dropping lines that many documents share.

Lines are exploded with their positions, normalised and hashed; the documents of each hash are counted; the positions of
lines over the threshold go back to their document, which is put together from the stretches between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import join_by_hot_key, let, own_names, stage_table

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a few numbers each that are broadcast rather than shuffled, and positions in them: some 10 MB.
FEW_ROWS, FEW_POSITIONS = 200_000, 2_000_000


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """What two lines have in common to count as one: ASCII white space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def common_lines(entries: DataFrame, min_docs: int) -> DataFrame:
    """(key, last, n) of the keys that min_docs documents hold: the largest doc_id and the number of lines. The distinct
    pairs of key and document are dealt by both, so a key that every document holds is spread over all tasks."""
    holders = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    return entries.groupBy("key").agg(holders.alias("holders"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("holders") >= min_docs).select("key", "last", "n")


@own_names
def drop_common_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """docs with text put together from the lines that stay, and n_lines (before) and n_dropped.

    A line goes if its key has min_chars code points or more and at least min_docs documents hold that key, unless this is
    the largest doc_id among them, which keeps all its lines with the key. A document is a doc_id: rows that repeat one
    count once, and so do all rows without one, which are never the largest. Null text counts as one empty line and becomes
    empty text. An empty table gives an empty one. Keys are compared by 128 bits of hash."""
    copy = F.xxhash64("text")  # tells rows of one doc_id apart whose lines have different positions
    key = line_key(F.col("line"))
    long_lines = docs.select("doc_id", copy.alias("copy"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).where(F.char_length(key) >= min_chars)
    entries = long_lines.select("doc_id", "copy", "pos", F.struct(F.xxhash64(key), F.xxhash64(F.lit(1), key)).alias("key"))
    common = stage_table(common_lines(entries.select("doc_id", "key"), min_docs), "common_lines")
    if common.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        found = entries.join(F.broadcast(common.drop("n")), "key")
    else:
        found = join_by_hot_key(entries, common, "key", "n", common.agg(F.sum("n")).first()[0])
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("doc_id", "copy").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    gone = stage_table(gone, "dropped_lines").withColumnsRenamed({"doc_id": "_doc", "copy": "_copy"})
    rows, positions = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    gone = F.broadcast(gone) if rows <= FEW_ROWS and positions <= FEW_POSITIONS else gone.hint("shuffle_hash")
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (copy == F.col("_copy")), "left")
    text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(without(lines_of(F.col("text")), F.col("gone")))
    added = {"n_lines": F.size(lines_of(F.col("text"))).cast("long"), "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"), "text": text}
    return out.withColumns(added).select(*docs.columns, "n_lines", "n_dropped")


def without(lines: Column, gone: Column) -> Column:
    """The lines but those at the sorted positions gone, joined: the stretches between one position and the next."""

    def stretches(every: Column) -> Column:
        ends = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(every)))
        return let(ends, lambda e: F.flatten(F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda j: F.slice(every, e[j] + 2, e[j + 1] - e[j] - 1))))

    return F.array_join(let(lines, stretches), "\n")
