"""Vector code compression: product codes whose nearest entries are found by annular norm pruning.

A codebook's entries are sorted by norm. No entry whose norm differs from a part's norm by more than the best distance
so far can be nearer, so the best of the two entries with the closest norms bounds an interval of norms, found by binary
search, and only the entries inside, ends included, are compared exactly, in integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import join_by_hot_key, stage_table

#: Labels whose sums are broadcast rather than shuffled: some 10 MB.
FEW_LABELS = 200_000


def is_sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of points the index of the nearest row of entries (ties: the lowest) and the squared distance."""

    def apart(rows: np.ndarray, found: np.ndarray) -> np.ndarray:
        gap = rows - found
        return np.einsum("ij,ij->i", gap, gap)

    norm = np.sqrt(np.einsum("ij,ij->i", entries, entries).astype(np.float64))
    order = np.argsort(norm, kind="stable")
    norm, entries = norm[order], entries[order]
    own = np.sqrt(np.einsum("ij,ij->i", points, points).astype(np.float64))
    at = np.searchsorted(norm, own)
    best = np.minimum(*(apart(points, entries[np.clip(at - k, 0, len(norm) - 1)]) for k in (0, 1)))
    reach = np.sqrt(best.astype(np.float64))
    reach += 1e-6 + 1e-9 * (own + reach)  # more than the roots are rounded by
    low, high = np.searchsorted(norm, own - reach, "left"), np.searchsorted(norm, own + reach, "right")
    many = high - low
    starts = np.cumsum(many) - many
    row = np.repeat(np.arange(len(points)), many)
    entry = np.arange(many.sum()) - np.repeat(starts - low, many)
    distance = apart(points[row], entries[entry])
    least = np.minimum.reduceat(distance, starts)
    index = np.where(distance == least[row], order[entry], len(norm))
    return np.minimum.reduceat(index, starts), least


def parts_of(vectors: pa.Array, parts: int, scale: int) -> np.ndarray:
    """A batch of vectors without nulls as integers, by row, part and position."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * float(scale)).astype(np.int64).reshape(len(vectors), parts, -1)


class Codebooks:
    """entries[part]: the integer entries of that part position, one a row."""

    def __init__(self, vectors: DataFrame, dims: int, parts: int, scale: int, entries: np.ndarray) -> None:
        self.vectors, self.dims, self.parts, self.scale, self.entries = vectors, dims, parts, scale, entries

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the sound vectors, v as doubles, and their number of components."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).where(is_sound(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("most"))
    first = sizes.orderBy(F.desc("n"), F.desc("dims")).first()
    if first is None:
        return rows, 0
    if first.dims == 0 or first.dims % parts:
        raise ValueError(f"vectors of {first.dims} components can't be cut into {parts} equal parts")
    if first.dims * (2 * scale * first.most + 2) ** 2 >= 2**62:
        raise ValueError("components are too large for exact distances of 64 bits")
    return rows.where(F.size("v") == first.dims), first.dims


def train(vectors: DataFrame, rounds: int = 2, parts: int = 16, entries: int = 64, scale: int = 256) -> Codebooks:
    """Codebooks of the vectors in (vec_id, embedding, label), which start from the smallest vec_ids and move to the floor
    of the mean of what they attract, `rounds` times; entries that attract nothing stay.

    Vectors that are null or hold a component that is null or not finite are dropped, and so are those with another number
    of components than most. An id that is repeated starts one entry, from its smallest vector; a missing id comes last. The
    driver holds the codebooks only: parts x entries sums come back from each round. Components must be small enough for
    squared distances to fit 63 bits; larger ones are an error."""
    rows, dims = usable(vectors, parts, scale)
    ids = rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).withColumnRenamed("vec_id", "_id")
    first = rows.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("_id"))).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.col("vec_id").asc_nulls_last()).collect() if dims else []
    start = np.floor(np.array([r.v for r in first], dtype=np.float64).reshape(len(first), parts, -1 if first else 1) * float(scale)).astype(np.int64)
    books = Codebooks(rows, dims, parts, scale, start.swapaxes(0, 1).copy())
    for _ in range(rounds if dims else 0):
        books.entries = moved(books)
    return books


def moved(books: Codebooks) -> np.ndarray:
    """The entries after one round: each task adds up what its parts are nearest to, and the sums are added up."""
    entries, parts, scale = books.entries, books.parts, books.scale
    count, width = entries.shape[1:]
    names = [f"s{k}" for k in range(width)]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, count, width + 1), dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            cut = parts_of(batch.column(0), parts, scale)
            for p in range(parts):
                index, _ = nearest(cut[:, p], entries[p])
                sums[p, :, 0] += np.bincount(index, minlength=count)
                for k in range(width):
                    sums[p, :, k + 1] += np.bincount(index, cut[:, p, k].astype(np.float64), count).astype(np.int64)
        part, entry = np.nonzero(sums[:, :, 0])
        columns = [part, entry, *(sums[part, entry, k] for k in range(width + 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "n", *names])

    found = books.vectors.select("v").mapInArrow(add_up, ", ".join(f"{c} long" for c in ("part", "entry", "n", *names)))
    new = entries.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect():
        new[r.part, r.entry] = [r[c] // r.n for c in names]
    return new


def encode(books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error, label_error) for each vector that the codebooks were trained on: the nearest entries' numbers
    in hex, two digits a part; their squared distances added up; and that added up over equal labels, nulls together."""
    entries, parts, scale = books.entries, books.parts, books.scale
    kinds = {f.name: f.dataType.simpleString() for f in books.vectors.schema.fields}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            cut = parts_of(batch.column(2), parts, scale)
            found = [nearest(cut[:, p], entries[p]) for p in range(parts)]
            digits = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes().hex()
            codes = pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(sum(f[1] for f in found), pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = books.vectors.select("vec_id", "label", "v").mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    coded = stage_table(coded, "codes").withColumn("_key", F.struct("label"))  # a struct is equal to itself whether null is inside or not
    totals = stage_table(coded.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label_errors")
    if totals.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        return coded.join(F.broadcast(totals.drop("n")), "_key").drop("_key")
    return join_by_hot_key(coded, totals, "_key", "n", totals.agg(F.sum("n")).first()[0]).drop("_key")
