"""What the corpus operators share: words, staged tables, distributed running totals and skew-proof lookups."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: The columns of documents that the operators read.
READ = {"doc_id", "text", "lang", "source", "n_chars"}

_staged: list[tuple[SparkSession, str] | None] = []
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="rostrum-"))
    return _own_dir[0]


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there, and any executor can
    read it again after another one is lost. The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rostrum-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def staged_count() -> int:
    return len(_staged)


def reads_staged(df: DataFrame, start: int, end: int) -> bool:
    """Whether df reads any of the staged tables from the start-th to the end-th."""
    names = [entry[1].rsplit("/", 1)[-1] for entry in _staged[start:end] if entry]
    return bool(names) and any(n in f for f in df.inputFiles() for n in names)


def drop_staged(start: int = 0, end: int | None = None) -> None:
    """Delete the staged tables from the start-th to the end-th; nothing may read them any more."""
    for i, entry in enumerate(_staged[start:end], start):
        if entry is None:
            continue
        spark, path = entry
        _staged[i] = None
        with contextlib.suppress(Exception):  # the JVM may be gone already
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


atexit.register(drop_staged)


def own_names(body):
    """body(docs, ...) with docs' columns under names that can't meet those that body makes up: all but the ones it reads
    or is told of, by position or by keyword, are called user_0, user_1, ... inside, and have their names again in what it
    returns. Names are told apart as Spark does, whatever their case. A column that body adds takes the place of one of the
    same name."""

    @functools.wraps(body)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        told = {x.lower() for x in (*args, *options.values()) if isinstance(x, str)}
        inside = [c.lower() if c.lower() in READ else c if c.lower() in told else f"user_{i}" for i, c in enumerate(docs.columns)]
        out = body(docs.toDF(*inside), *args, **options)
        names = dict(zip(inside, docs.columns, strict=True))
        added = {c.lower() for c in out.columns if c not in names}
        return out.select(*[F.col(c).alias(names.get(c, c)) for c in out.columns if c not in names or names[c].lower() not in added])

    return run


def give_back() -> None:
    """Hand the memory that Python, Arrow and the C library hold without use back to the system: a worker that waits for its next
    task is small then, and an executor has as many as it has cores."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda variable is bound where Catalyst would inline the expression."""
    return F.transform(F.array(value), body)[0]


def running_total(df: DataFrame, group: list[str], key: str, ties: list[str], value: Column, out: str, buckets: int = 1024) -> DataFrame:
    """Add out: the sum of value over the rows of the group that come before, in the order of key (a hash).

    The group is cut into ranges of the key; only range totals meet in one task (at most `buckets` rows a group), so
    a group that holds a third of all rows is spread over all tasks. Columns of group and key hold no nulls."""
    shift = 64 - (buckets - 1).bit_length()
    df = df.withColumn("_range", F.shiftrightunsigned(F.col(key), shift).cast("int"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, "_range").agg(F.sum(value).alias("_sum")).select(*group, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*group, "_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(totals, [*group, "_range"]).withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_base", "_range")


def join_by_hot_key(big: DataFrame, small: DataFrame, key: str, weight: str, total: int, share: int = 500) -> DataFrame:
    """big inner join small on key, where small has each key once and `weight`, its rows in big.

    Keys with over a 1/share of all rows, so fewer than `share` of them, are broadcast; the rest are shuffled.
    weight isn't returned."""
    limit = max(1, total // share)
    hot = F.broadcast(small.where(F.col(weight) > limit).drop(weight))
    cold = small.where(F.col(weight) <= limit).drop(weight)
    names = [c for c in cold.columns if c != key]
    marked = big.join(hot.select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in names]), F.col(key) == F.col("_hot_key"), "left")
    first = marked.where(F.col("_hot_key").isNotNull()).select(*big.columns, *[F.col(f"_hot_{c}").alias(c) for c in names])
    rest = marked.where(F.col("_hot_key").isNull()).select(*big.columns).join(cold, key).select(*big.columns, *names)
    return first.unionByName(rest)
