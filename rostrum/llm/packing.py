"""Packing documents into windows by non-negative least squares.

Documents are cut into whole windows and a remainder. Shallow combinations of remainder lengths that fill a window
exactly are the columns of a matrix; non-negative least squares finds how often to repeat each so that together they use
up the histogram of remainders. The counts are rounded to what the histogram holds, and pieces are dealt to the
repetitions by their rank among pieces of the same length. What no combination takes is packed greedily, in one stream
that is cut where a window is full; the stream's last words fill windows of powers of two, which need no padding."""

from __future__ import annotations

import os
import re
import threading
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import give_back, running_total, stage_table

#: Words that a worker remembers the ids of; when there are more, it starts afresh. About 150 MB, which an idle worker
#: lets go.
REMEMBERED = 800_000
#: Letters whose lower case depends on what surrounds them, or is more than one letter.
CASED_ALONE = re.compile("[\u03a3\u0130]")
#: ASCII punctuation that makes pieces of its own after letters; the apostrophe may begin one with letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Combinations that the solver may choose from, whatever the corpus; they bound the plan that is broadcast.
MAX_PATTERNS = 20_000


class WordIds(dict):
    """Ids of words: white space is dropped and never joins two words, so words stand alone. A word that is new is split
    by the tokenizer's own model: directly where it is letters and then ASCII punctuation, else in full."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tails: dict[str, bytes] = {}
        self.tasks = 0
        # the printable stand-ins of byte-level models: bytes that aren't printable follow from U+0100 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.stand_ins = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.direct = self.tokenizer.model.tokenize if self.lowers_letters() else None

    def full(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def lowers_letters(self) -> bool:
        """Whether letters alone reach the model as one lower-cased piece in stand-ins; asked of a few words."""
        try:
            tries = ["Abstraction", "größe", "ÉLÈVE", "señora", "x", "Привет"]
            return all(self.split(w.lower(), self.tokenizer.model.tokenize) == self.full(w) and self.full(w + m) == self.full(w) + self.full(m) for w in tries for m in (",", "%$", ".##"))
        except Exception:  # a model of another kind: every word goes the full way
            return False

    def split(self, word: str, tokenize) -> bytes:
        piece = word if word.isascii() else "".join(map(self.stand_ins.__getitem__, word.encode()))
        return array("I", [t.id for t in tokenize(piece)]).tobytes()

    def __missing__(self, key: bytes) -> bytes:
        word = key.decode()
        stem = word.rstrip(MARKS)
        if self.direct is None or not stem.isalpha() or not (stem.isascii() or (unicodedata.is_normalized("NFC", stem) and not CASED_ALONE.search(stem))):
            ids = self.full(word)
        else:
            low = stem.lower()
            ids = self.get(low.encode()) if low != word else None
            if ids is None:
                ids = self.split(low, self.direct)
            if stem != word:
                tail = word[len(stem) :]
                if tail not in self.tails:
                    self.tails[tail] = self.full(tail)
                ids += self.tails[tail]
        if len(self) >= REMEMBERED:
            self.forget()
        self[key] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.tails.clear()

    def forget_when_idle(self, seconds: float = 3.0) -> None:
        """Let the words go unless another task of this worker starts soon."""
        seen = self.tasks

        def check() -> None:
            if self.tasks == seen:
                self.forget()
                give_back()

        timer = threading.Timer(seconds, check)
        timer.daemon = True
        timer.start()

    def __call__(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.__getitem__, (text or "").encode().split()))


_tokenizers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer and its memory for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(uid, doc_id, n, ids): each row's ids and end_id, as unsigned 32-bit little-endian numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        ids.tasks += 1
        end = array("I", [end_id]).tobytes()
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a in range(0, batch.num_rows, 250):
                part = batch.slice(a, 250)
                out = [ids(x) + end for x in part.column(1).to_pylist()]
                columns = [pa.array(np.arange(at, at + len(out))), part.column(0), pa.array([len(x) // len(end) for x in out], pa.int64()), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "n", "ids"])
                at += len(out)
        batch = part = out = columns = None
        give_back()
        ids.forget_when_idle()

    return docs.select("doc_id", "text").mapInArrow(run, f"uid long, doc_id {kind}, n long, ids binary")


def patterns(hist: np.ndarray, window: int, seed: int = 5, limit: int = MAX_PATTERNS) -> np.ndarray:
    """Combinations of two to five lengths that sum to the window, as rows padded with zeros.

    hist[l] is the number of pieces of length l. All pairs; then deeper ones with lengths drawn as often as they occur."""
    have = np.flatnonzero(hist)
    found = {(a, window - a, 0, 0, 0) for a in map(int, have) if a <= window - a and hist[window - a] and (2 * a != window or hist[a] > 1)}
    if len(have):
        rng = np.random.default_rng(seed)
        share = hist[have] / hist[have].sum()
        for depth in (3, 4, 5):
            for _ in range(8):
                first = rng.choice(have, size=(limit, depth - 1), p=share)
                last = window - first.sum(axis=1)
                ok = (last > 0) & (last < len(hist))
                rows = np.column_stack([first[ok], last[ok]])
                rows = np.sort(rows[hist[rows[:, -1]] > 0], axis=1)[:, ::-1]
                found.update((*map(int, r), *[0] * (5 - depth)) for r in rows[: limit // 8])
                if len(found) >= limit:
                    break
    return np.array(sorted(found)[:: max(1, -(-len(found) // limit))], dtype=np.int64).reshape(-1, 5)


def non_negative_least_squares(rows: np.ndarray, hist: np.ndarray, sweeps: int = 25) -> np.ndarray:
    """x >= 0 that makes the lengths used by x repetitions of the rows closest to hist, by cyclic descent."""
    x, left = np.zeros(len(rows)), hist.astype(float)
    uses = [np.unique(r[r > 0], return_counts=True) for r in rows]
    columns, counts = [u[0] for u in uses], [u[1].astype(float) for u in uses]
    norms = [float(c @ c) for c in counts]
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, c) in enumerate(zip(columns, counts, strict=True)):
            step = max(-x[j], float(c @ left[at]) / norms[j])
            if step:
                x[j] += step
                left[at] -= step * c
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def rounded(rows: np.ndarray, x: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Whole repetitions near x that use no more pieces than hist has; then as many more as still fit."""
    left, times = hist.copy(), np.zeros(len(rows), dtype=np.int64)
    for want in (np.rint(x), np.full(len(rows), np.inf)):
        for j in np.argsort(-x, kind="stable"):
            at, c = np.unique(rows[j][rows[j] > 0], return_counts=True)
            n = int(min(want[j], (left[at] // c).min()))
            times[j] += n
            left[at] -= n * c
    return times


def deal(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, int]:
    """Plan rows (length, first rank, ranks, first sequence, offset), by length and rank, and the number of sequences."""
    used: dict[int, int] = {}
    plan, base = [], 0
    for row, n in zip(rows, times, strict=True):
        if n:
            offset = 0
            for length in map(int, row[row > 0]):
                plan.append((length, used.get(length, 0), int(n), base, offset))
                used[length] = used.get(length, 0) + int(n)
                offset += length
            base += int(n)
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 5), base


def tail_edges(total: int, window: int) -> list[int]:
    """Where the stream's sequences end: at each full window, and then at powers of two, largest first."""
    edges, at = [], total - total % window
    for bit in range((total % window).bit_length() - 1, -1, -1):
        if total % window >> bit & 1:
            at += 1 << bit
            edges.append(at)
    return edges


def pack(docs: DataFrame, tokenizer: str, *, window: int = 4096, end_id: int = 2, seed: int = 5) -> DataFrame:
    """(doc_id, start, length, ids, sequence_id, offset, doc_tokens): a row for each piece, with its ids as unsigned
    32-bit little-endian numbers. tokenizer: path of a tokenizers file that drops white space.

    A null or empty text is a document of the end id alone. Repeated rows and repeated or null ids are documents of their
    own. An empty table gives no pieces. Columns other than doc_id and text play no part."""
    spark = docs.sparkSession
    table = stage_table(tokenized(docs, tokenizer, end_id), "ids")
    narrow = table.select("uid", "n", (F.col("n") % window).cast("int").alias("_rest"), F.floor(F.col("n") / window).cast("long").alias("_full"), F.xxhash64(F.lit(seed), "uid").alias("_hash"), F.lit(0).alias("_all"))
    hist = np.zeros(window, dtype=np.int64)
    for length, n in narrow.where("_rest > 0").groupBy("_rest").count().collect():
        hist[length] = n
    rows = patterns(hist, window, seed)
    plan, n_filled = deal(rows, rounded(rows, non_negative_least_squares(rows, hist), hist))
    taken = np.zeros(window, dtype=np.int64)
    np.add.at(taken, plan[:, 0], plan[:, 2])
    stream = int(((hist - taken) * np.arange(window)).sum())
    edges = tail_edges(stream, window)
    whole = stream // window
    sent = spark.sparkContext.broadcast((plan, taken, edges))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The slot of each remainder in a repetition, or sequence -1: the stream."""
        plan, taken, _ = sent.value
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for pdf in batches:
            length, rank = pdf["_rest"].to_numpy(np.int64), pdf["_rank"].to_numpy(np.int64)
            slot = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            inside = rank < taken[length]
            at = plan[np.where(inside, slot, 0)] if len(plan) else np.zeros((len(pdf), 5), np.int64)
            yield pdf.drop(columns="_rank").assign(sequence_id=np.where(inside, at[:, 3] + rank - at[:, 1], -1), offset=at[:, 4])

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The pieces of remainders in the stream, which begin at _from in it and end where a sequence does."""
        edges = sent.value[2]
        for pdf in batches:
            out = []
            for uid, n, rest, at in zip(pdf["uid"], pdf["n"], pdf["_rest"], pdf["_from"], strict=True):
                start, at = n - rest, int(at)
                while start < n:
                    if at < whole * window:
                        end, seq, off = (at // window + 1) * window, n_filled + at // window, at % window
                    else:
                        k = next(i for i, e in enumerate(edges) if at < e)
                        end, seq = edges[k], first_tail + k
                        off = at - (edges[k - 1] if k else whole * window)
                    m = min(n - start, end - at)
                    out.append((uid, start, m, seq, off))
                    at, start = at + m, start + m
            yield pd.DataFrame(out, columns=["uid", "start", "length", "sequence_id", "offset"])

    first_tail = n_filled + whole
    first_full = first_tail + len(edges)
    rests = running_total(narrow.where("_rest > 0"), ["_rest"], "_hash", ["uid"], F.lit(1), "_rank", 256)
    slots = stage_table(rests.select("uid", "n", "_rest", "_hash", "_rank").mapInPandas(placed, "uid long, n long, _rest int, _hash long, sequence_id long, offset long"), "slots")
    pieces = slots.where("sequence_id >= 0").select("uid", (F.col("n") - F.col("_rest")).alias("start"), F.col("_rest").cast("long").alias("length"), "sequence_id", "offset")
    loose = running_total(slots.where("sequence_id < 0").withColumn("_all", F.lit(0)), ["_all"], "_hash", ["uid"], F.col("_rest").cast("long"), "_from")
    pieces = pieces.unionByName(loose.select("uid", "n", "_rest", "_from").mapInPandas(streamed, "uid long, start long, length long, sequence_id long, offset long"))
    fulls = running_total(narrow.where("_full > 0"), ["_all"], "_hash", ["uid"], F.col("_full"), "_from").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)))
    pieces = pieces.unionByName(fulls.select("uid", (F.col("_k") * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.col("_from") + F.col("_k") + first_full).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    ids = F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    return table.join(pieces.hint("merge"), "uid").select("doc_id", "start", "length", ids.alias("ids"), "sequence_id", "offset", F.col("n").alias("doc_tokens"))
