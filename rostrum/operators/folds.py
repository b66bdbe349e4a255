"""Folds over ordered rows: each key's rows pass one at a time, so a key of any size needs the memory of its state only."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], schema: str, start: Callable[[], Any], step: Callable[[Any, tuple], Iterable[tuple]], end: Callable[[Any], Iterable[tuple]] = lambda state: ()) -> DataFrame:
    """Rows of `schema`, whose first columns are the keys: start() makes a key's state, step(state, row of values) changes it
    and gives the rows that follow the keys, and end(state) gives the last ones.

    Rows are sorted by keys and order within hash partitions, which spills; null keys are a key of their own."""
    out_schema = to_arrow_schema(StructType.fromDDL(schema))
    n = len(keys)
    columns = [*keys, *values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state: Any = None
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(out_schema)]
            return pa.RecordBatch.from_arrays(made, schema=out_schema)

        for rows in batches:
            for row in zip(*(rows.column(i).to_pylist() for i in range(len(columns))), strict=True):
                if key != row[:n]:
                    if key is not None:
                        out.extend((*key, *r) for r in end(state))
                    key, state = row[:n], start()
                out.extend((*key, *r) for r in step(state, row[n:]))
            yield batch()
            out = []
        if key is not None:
            out.extend((*key, *r) for r in end(state))
            yield batch()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*columns).mapInArrow(run, schema)
