"""Periodic runs of words in linear time, from the Lyndon arrays of both orders of the alphabet (Ellert and Fischer, 2021).

A run is a stretch that repeats itself with a period and can't be extended. For one of the two orders of the alphabet, the
run's least rotation is the longest Lyndon word wherever it starts in the run; so each run shows as a position, its next
smaller suffix and how far these two agree to the right and to the left. Suffixes are compared from left to right with
a stack of those that have no smaller suffix yet. What two suffixes have been seen to share is a copy of earlier text,
whose comparisons hold in the copy too: only words beyond the furthest agreement are ever compared, each once. No suffix
structure and no hash is built."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rostrum.llm.common import own_names

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def lyndon_runs(w: list[int], least: int, found: set[tuple[int, int, int]]) -> None:
    """Add to found the (start, length, period) of the runs of at least `least` symbols whose Lyndon roots are those of the
    order of w's numbers. w: numbers from 0, and -1, the end, which is smaller than all."""
    n = len(w) - 1
    smaller = [n] * n  # the next smaller suffix
    right = [0] * n  # symbols that a suffix shares with it
    before = [0] * n  # symbols that a suffix shares with the previous smaller suffix, which is below it in the stack
    left = [0] * n  # symbols before a position that agree with those before its next smaller suffix, one period at most
    stack = [-1]  # w[-1] is the end: nothing is smaller
    origin = copied = front = 0  # w[origin:][: front - copied] == w[copied:front]
    for r in range(n):
        b = w[r]
        t = stack[-1]
        if r >= front:
            while (a := w[t]) > b:
                smaller[t] = r
                stack.pop()
                t = stack[-1]
            if a < b:
                stack.append(r)
                continue
        source, to = origin, copied
        shift = to - source if to < r <= front else 0  # if so, what lies from `to` to r is a copy
        e = 0
        while t >= 0:  # the suffixes at t and r share e symbols: do they share more, and which is smaller?
            known = False
            if shift and t >= to and r + e < front:
                greater = smaller[t - shift] == r - shift
                e = right[t - shift] if greater else before[r - shift]
                known = r + e < front
                if not known:
                    e = front - r
            if not known:
                while w[t + e] == w[r + e]:
                    e += 1
                greater = w[t + e] > w[r + e]
                if r + e >= front:
                    origin, copied, front = t, r, r + e
            if not greater:
                before[r] = e
                break
            while True:
                stack.pop()
                smaller[t], right[t] = r, e
                if e:
                    p = r - t
                    k, most = 0, min(p, t)
                    if shift and t >= to and smaller[t - shift] == r - shift and right[t - shift]:
                        k = min(left[t - shift], t - to)
                        if k < t - to:
                            most = k  # the copy holds the mismatch, too
                    while k < most and w[t - 1 - k] == w[r - 1 - k]:
                        k += 1
                    left[t] = k
                    if k < p <= k + e and p + k + e >= least:
                        found.add((t - k, p + k + e, p))
                below = before[t]
                t = stack[-1]
                if e >= below:
                    break  # where e < below, t differs from r as what was above it does
            if e > below:
                before[r] = below  # t differs from what was above it before r does
                break
        stack.append(r)


def runs_of(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least `least` words and two periods, in order. Words are ordered by their
    first appearance, which is an order like any other."""
    numbers: dict[bytes, int] = {}
    w = [numbers.setdefault(x, len(numbers)) for x in words]
    found: set[tuple[int, int, int]] = set()
    if len(numbers) < len(w):
        lyndon_runs([*w, -1], least, found)
        top = len(numbers)
        lyndon_runs([*(top - x for x in w), -1], least, found)
    return sorted((s, n, p) for s, n, p in found)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    kept, at = [], 0
    for start, end in sorted((s + p, s + n) for s, n, p in runs):
        if start > at:
            kept += words[at:start]
        at = max(at, end)
    return kept + words[at:]


def collapse_texts(texts: pa.Array, least: int = 12) -> tuple[pa.Array, pa.Array]:
    """The collapsed texts and their runs."""
    runs, out = [], []
    for text in texts.to_pylist():
        words = (text or "").encode().split()  # ASCII white space only
        own = runs_of(words, least) if len(words) >= least else []
        runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
        out.append(b" ".join(collapsed(words, own)).decode())
    return pa.array(out, pa.string()), pa.array(runs, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))


@own_names
def collapse(docs: DataFrame, least: int = 12) -> DataFrame:
    """docs with `runs`, an array of (start, length, period) by start and period, and text without what runs repeat.

    A run is a stretch of words with smallest period p, at least `least` words and two periods long, that no neighbouring
    word extends. Of each run the first p words stay, unless another run drops them; what stays is joined by one space.
    Null and empty texts have no words: no runs, empty text. Each row is worked on by itself and whole, so repeated rows give
    equal results, ids play no part, and an empty table gives an empty one. Time and memory grow in proportion to a
    text's words."""

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            columns[at], runs = collapse_texts(batch.column(at), least)
            yield pa.RecordBatch.from_arrays([*columns, runs], names=[*batch.schema.names, "runs"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("runs", RUNS)]))
