"""LM scoring by prediction by partial matching, with contexts from phrases of words down to single bytes.

The longest contexts are four words, hashed. At content-defined places (every 16th on average, by the hash itself) such a
context predicts the whole phrase up to the next such place: the phrase that follows it most often in training, if it is
the majority. Whether that comes true is coded first, with an escape probability learnt from training for each number of
occurrences (secondary escape estimation). Of a training text's own phrases the occurrence that is being coded is left out.
These contexts cross words, lines and passages, and find text that training has seen.

Where no phrase comes true, a word is coded. First comes an adaptive context of the document itself: the word that followed
the word before, the last time that stood in this document; its escapes are estimated in the same way, and after an escape
the guessed word is excluded from what the trie says.

Then comes the byte trie. Its contexts are the bytes of the current word so far, with the white space before it as their
first byte, and then its last six, five, ... and no bytes. A symbol not seen after a context escapes to the next shorter one,
where the symbols of the longer context are excluded; below the empty context all symbols left are alike. Escapes are
estimated as by method D: each symbol gives up a fixed part of one occurrence, and the escape gets what they give up. Counts of
shorter contexts are updated only where a symbol is new to the longer one (update exclusion), so they count distinct longer
contexts. As these contexts don't reach into the word before, a word costs the same wherever it stands and each distinct
word is coded once.

Nothing is capped. The trie is split by the last two bytes of its contexts: a part holds all contexts of two bytes and more
that end so, and codes the events there of all distinct words. Only contexts of one byte or none, which are at most 257 * 257
entries, go to every part. Documents are held as numbers into the word list of their chunk; word lists and distinct
phrases are shuffled and joined, never one row for each word of each document."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import drop_staged, join_by_hot_key, stage_table, staged_count

#: Longest context but for the whole word so far, which is a context up to DEEP bytes.
ORDER = 6
DEEP = 32
#: What each symbol gives up; method D's half did slightly worse on held-out text.
ESCAPE = 0.35
END = 256
SYMBOLS = 257
CHUNK_WORDS = 4_000_000
#: Distinct words that are made into events together, and for each part of the trie.
LOT_WORDS, PART_WORDS = 50_000, 30_000
#: Words of a phrase context; the share of contexts that start a phrase is 2 ** -RARE.
REACH, RARE = 4, 4
#: Classes of how often a phrase was seen after its context.
STATES = 4
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)]
#: An odd number and its inverse modulo 2**64.
BASE = 0x5851F42D4C957F2D
UNBASE = pow(BASE, -1, 1 << 64)
END_HASH = 0xD6E8FEB86659FD93


def events(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, next, owner): for each byte of each word, and the space after it, the key of its longest context and symbol,
    the next shorter context where that can't be told from the key, and the index of the word.

    A key holds the context's length, up to six bytes and the symbol; or, for a longer context, length 7 and 48 bits of
    a hash of it."""
    flat = np.frombuffer(b"".join(b" " + w + b" " for w in words), dtype=np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes + 1)
    at = np.ones(len(flat), dtype=bool)
    at[np.concatenate([[0], ends[:-1]])] = False  # the leading spaces are contexts, never symbols
    at = np.flatnonzero(at)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = at - np.repeat(ends - sizes - 1, sizes)  # 1 for the first byte
    length = np.minimum(place, ORDER)
    code = np.zeros(len(at), dtype=np.int64)
    for back in range(ORDER, 0, -1):
        use = back <= length
        code[use] = (code[use] << 8) | flat[at[use] - back]
    keys, after = key_of(length, code, flat[at]), np.zeros(len(at), dtype=np.int64)
    state, begin = np.zeros(len(words), dtype=np.uint64), ends - sizes - 1
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    live = np.arange(len(words))
    for p in range(1, DEEP + 1):  # the p bytes before a symbol at place p
        live = live[sizes[live] >= p]
        if not len(live):
            break
        state[live] = (state[live] ^ flat[begin[live] + p - 1].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        state[live] ^= state[live] >> np.uint64(29)
        if p > ORDER:
            i = first[live] + p - 1
            after[i] = keys[i] >> 9
            keys[i] = key_of(7, (state[live] >> np.uint64(16)).astype(np.int64), keys[i] & 511)
    return keys, after, owner


def key_of(length: np.ndarray | int, code: np.ndarray | int, symbol: np.ndarray | int) -> np.ndarray:
    return (np.asarray(length, dtype=np.int64) << 57) | (np.asarray(code, dtype=np.int64) << 9) | symbol


END_KEY = int(key_of(1, 32, END))


def shorter(context: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Context keys (without symbols) less their first byte, or `after` for hashed ones; the empty context stays."""
    length = context >> 48
    low = np.maximum(np.minimum(length, ORDER) - 1, 0)
    return np.where(length > ORDER, after, (low << 48) | (context & ((np.int64(1) << (8 * low)) - 1)))


class Trie:
    """Entries sorted by key (context << 9 | symbol), their counts, and what coding needs of each context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, after: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order].astype(np.float64)
        context = self.keys >> 9
        self.given = np.full(len(keys), ESCAPE)
        self.contexts, first = np.unique(context, return_index=True)
        bounds, m = np.append(first, len(context)), len(self.contexts)
        self.distinct = np.diff(bounds).astype(np.float64)
        self.total = np.add.reduceat(self.counts, first) if m else np.zeros(0)
        self.escape = np.add.reduceat(self.given, first) if m else np.zeros(0)
        # what is left in the shorter context once the symbols of this one are excluded
        longer = shorter(self.contexts, after[order][first]) if m else self.contexts
        self.up = np.searchsorted(self.contexts, longer)
        own = np.repeat(np.arange(m), np.diff(bounds))
        there, at = self.entry(self.up[own], self.keys & 511)
        there &= self.contexts[own] >> 48 > 0
        gone = lambda x: np.bincount(own, np.where(there, x[at], 0.0), minlength=m)
        self.left_total = self.total[self.up] - gone(self.counts) if m else self.total
        self.left_escape = self.escape[self.up] - gone(self.given) if m else self.total
        self.left_distinct = self.distinct[self.up] - np.bincount(own, there, minlength=m) if m else self.total

    def entry(self, node: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the symbol is in the node, and the place of its entry."""
        key = (self.contexts[node] << 9) | symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, at

    def cost(self, keys: np.ndarray, after: np.ndarray) -> np.ndarray:
        """log10 probability of each event (its longest context and its symbol, and the next context)."""
        out = np.zeros(len(keys))
        if not len(self.contexts):
            return out - np.log10(SYMBOLS)
        symbol, ctx = keys & 511, keys >> 9
        todo = np.arange(len(keys))
        node = np.full(len(keys), -1)
        while len(todo):  # the longest context that the trie has; the empty one is always there
            at = np.minimum(np.searchsorted(self.contexts, ctx[todo]), len(self.contexts) - 1)
            hit = self.contexts[at] == ctx[todo]
            node[todo[hit]] = at[hit]
            todo = todo[~hit]
            ctx[todo] = shorter(ctx[todo], after[todo])
        total, escape, distinct = self.total[node], self.escape[node], self.distinct[node]
        todo = np.arange(len(keys))
        while len(todo):
            found, at = self.entry(node[todo], symbol[todo])
            hit, at = todo[found], at[found]
            out[hit] += np.log10((self.counts[at] - self.given[at]) / total[hit])
            todo = todo[~found]
            some = todo[distinct[todo] > 0]  # with nothing left to choose from, the escape is certain
            out[some] += np.log10(escape[some] / total[some])
            end = self.contexts[node[todo]] >> 48 == 0
            out[todo[end]] -= np.log10(np.maximum(1.0, SYMBOLS - self.distinct[node[todo[end]]]))
            todo = todo[~end]
            total[todo], escape[todo], distinct[todo] = self.left_total[node[todo]], self.left_escape[node[todo]], self.left_distinct[node[todo]]
            node[todo] = self.up[node[todo]]
        return out


def local_trie(keys: np.ndarray, counts: np.ndarray, after: np.ndarray, low: tuple[np.ndarray, np.ndarray], suffix: int = 2) -> Trie:
    """The trie of training events that end in the same bytes (repeats are added up): order by order, a distinct entry adds
    one to the entry of the next shorter context. low: (keys, counts) of the contexts of fewer than `suffix` bytes."""
    done, above = [], (np.zeros(0, np.int64),) * 3
    for order in range(ORDER + 1, suffix - 1, -1):
        at = keys >> 57 == order
        k, n, x = (np.concatenate([own[at], up]) for own, up in zip((keys, counts, after), above, strict=True))
        k, first, place = np.unique(k, return_index=True, return_inverse=True)
        n, x = np.bincount(place, n, minlength=len(k)).astype(np.int64), x[first]
        done.append((k, n, x))
        above = ((shorter(k >> 9, x) << 9) | (k & 511), np.ones(len(k), np.int64), np.zeros(len(k), np.int64))
    return Trie(*(np.concatenate(z) for z in zip(*done, (*low, np.zeros(len(low[0]), np.int64)), strict=True)))


def parts_of(keys: np.ndarray, after: np.ndarray, parts: int) -> np.ndarray:
    """The part of each event: by the last two bytes of its context; those of one byte are in part 0."""
    order = keys >> 57
    pair = np.where(order > ORDER, after, keys >> 9) & 0xFFFF
    return np.where(order < 2, 0, ((pair * 0x9E3779B1) >> 12) % parts)


def lot_events(words: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, after, part, place, owner): the distinct events of a lot of words by part, and the place among them of each
    event of each word."""
    keys, after, owner = events(words)
    found, first, place = np.unique(keys, return_index=True, return_inverse=True)
    after = after[first]
    part = parts_of(found, after, parts)
    order = np.argsort(part, kind="stable")
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    return found[order], after[order], part[order], at[place], owner


def repeats(ids: np.ndarray, owner: np.ndarray, context: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(guess, state) of each word of a chunk's documents, one after the other: the index of the word that the document's
    last same pair-start was followed by, or -1; and how many guesses in a row came true just before, up to three.

    guess[i] is j < i with the same word before j as before i in the same document; the guess is word ids[j]. With context
    (a number of each word), j has the same one as i too."""
    n = len(ids)
    guess, state = np.full(n, -1), np.zeros(n, dtype=np.int64)
    if n < 2:
        return guess, state
    same = owner[1:] == owner[:-1]
    at = np.flatnonzero(same) + 1
    before = (owner[at].astype(np.int64) << 32) | ids[at - 1]
    order = np.argsort(before, kind="stable") if context is None else np.lexsort((context[at], before))
    twin = before[order][1:] == before[order][:-1]
    if context is not None:
        twin &= context[at][order][1:] == context[at][order][:-1]
    guess[at[order[1:][twin]]] = at[order[:-1][twin]]
    right = (guess >= 0) & (ids == ids[np.maximum(guess, 0)])
    breaks = np.flatnonzero(~right)
    last = np.full(n, -1)
    last[breaks] = breaks
    last = np.maximum.accumulate(last)
    run = np.arange(n) - last  # right guesses that end here
    state[1:] = np.where(same, np.minimum(run[:-1], 3), 0)
    return guess, state


def phrases(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, context, phrase) of the phrases of documents that stand one after the other as word hashes, each with
    END_HASH at its end: a phrase runs from a place whose context (the REACH words before) is chosen to the next one, or over
    the document's end."""
    n = len(h)
    if n <= REACH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    context = np.zeros(n - REACH, np.uint64)
    for i, m in enumerate(MIX):
        context = (context ^ (context >> np.uint64(31)) ^ h[REACH - 1 - i : n - 1 - i]) * m
    context ^= context >> np.uint64(29)
    context *= MIX[0]
    chosen = (context >> np.uint64(64 - RARE) == 0) & (owner[REACH:] == owner[: n - REACH])
    start = np.flatnonzero(chosen) + REACH
    last = np.append(np.flatnonzero(owner[1:] != owner[:-1]) + 1, n)  # the place after each document's end
    stop = np.minimum(np.append(start[1:], n)[: len(start)], last[np.searchsorted(last, start, side="right")]) if len(start) else start
    power = np.full(n, BASE, np.uint64)
    power[0] = 1
    back = np.full(n, UNBASE, np.uint64)
    back[0] = 1
    total = np.append(np.uint64(0), np.cumsum(h * np.multiply.accumulate(power)))
    own = (total[stop] - total[start]) * np.multiply.accumulate(back)[start]
    own = (own ^ (own >> np.uint64(32))) * MIX[1]
    return start, stop, context[start - REACH], own ^ (own >> np.uint64(29))


def rows_of(schema: pa.Schema, n: int, /, **columns) -> pa.RecordBatch:
    """A batch of n rows; columns that aren't given are null, and a scalar stands in every row."""
    made = []
    for f in schema:
        x = columns.get(f.name)
        made.append(pa.nulls(n, f.type) if x is None else x if isinstance(x, pa.Array) else pa.array([x] * n if np.isscalar(x) else x, f.type))
    return pa.RecordBatch.from_arrays(made, schema=schema)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def coded(docs: DataFrame, held: str = "_held") -> DataFrame:
    """Chunks of documents: rows of kind 0 (chunk, doc_id, held, ids, spots, at), spots being where phrases start and at the
    number in the chunk of the first of them; of kind 1 (chunk, word, at, n), n of them in training documents; of kind 2
    (at, n): n guesses of training documents in state at >> 1, right (at & 1) or wrong; and of kind 3 (chunk, held, at,
    context, phrase): the at-th phrase of the chunk's documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, schema = TaskContext.get().partitionId() << 32, None
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        hashes, count, learnt, met, n, guesses = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, 0, np.zeros(8, np.int64)

        def close() -> Iterator[pa.RecordBatch]:
            names = iter(number)
            for a in range(0, len(number), 50_000):
                own = [w.decode() for w in islice(names, 50_000)]
                yield rows_of(schema, len(own), chunk=chunk, kind=1, word=own, at=np.arange(a, a + len(own)), n=count[a : a + 50_000])

        for batch in batches:
            if schema is None:
                schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("doc_id", batch.schema.field(0).type), ("held", pa.bool_()), ("ids", pa.binary()), ("spots", pa.binary()), ("word", pa.string()), ("at", pa.int32()), ("n", pa.int64()), ("context", pa.int64()), ("phrase", pa.int64())])
            for a in range(0, batch.num_rows, 100):
                part, ids = batch.slice(a, 100), []
                outs = np.array(part.column(2).to_pylist(), dtype=bool)
                for text, out in zip(part.column(1), outs, strict=True):
                    got = np.fromiter(map(number.__getitem__, (text.as_py() or "").encode().lower().split()), dtype=np.int32)
                    ids.append(got)
                    n += len(got)
                    if not out:
                        learnt.append(got)
                if len(number) > len(hashes):
                    more = list(islice(number, len(hashes), None))
                    count = np.append(count, np.zeros(len(more), np.int64))
                    hashes = np.append(hashes, np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in more), np.uint64, len(more)))
                flat, owner = joined(ids)
                start, _, context, phrase = phrases(np.where(flat < 0, np.uint64(END_HASH), np.append(hashes, np.uint64(0))[flat]), owner)
                yield rows_of(schema, len(start), chunk=chunk, kind=3, held=outs[owner[start]], at=np.arange(met, met + len(start)), context=signed(context), phrase=signed(phrase))
                begin = np.cumsum([0] + [len(x) + 1 for x in ids])
                edges = np.searchsorted(start, begin)
                spots = [(start[a:b] - at).astype(np.int32).tobytes() for a, b, at in zip(edges, edges[1:], begin, strict=False)]
                firsts = met + edges[:-1]
                met += len(start)
                if learnt:
                    flat, owner = joined(learnt)
                    count += np.bincount(flat[flat >= 0], minlength=len(count))
                    guess, state = repeats(flat, owner)
                    guesses += np.bincount((2 * state + (flat == flat[np.maximum(guess, 0)]))[guess >= 0], minlength=8)
                    learnt = []
                yield rows_of(schema, part.num_rows, chunk=chunk, kind=0, doc_id=part.column(0), held=part.column(2), ids=[x.tobytes() for x in ids], spots=spots, at=firsts)
                if n >= CHUNK_WORDS:
                    yield from close()
                    number.clear()
                    hashes, count, met, n, chunk = hashes[:0], count[:0], 0, 0, chunk + 1
        if schema is not None:
            yield from close()
            yield rows_of(schema, 8, chunk=-1, kind=2, at=np.arange(8), n=guesses)

    return docs.select("doc_id", "text", held).mapInArrow(run, f"chunk long, kind int, doc_id {kind}, held boolean, ids binary, spots binary, word string, at int, n long, context long, phrase long")


def joined(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The documents' words one after the other, each document followed by -1, and the document of each."""
    return np.concatenate([np.append(x, -1) for x in ids]), np.repeat(np.arange(len(ids)), [len(x) + 1 for x in ids])


LOTS = pa.schema([("kind", pa.int32()), ("lot", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("after", pa.binary()), ("words", pa.binary()), ("low", pa.int64()), ("count", pa.int64())])


def lots(vocabulary: DataFrame, parts: int) -> DataFrame:
    """The events of (word, c) in lots of words: rows of kind 0 (lot, words, n) with the lot's words and counts; of kind 1
    (lot, part, keys, n, after), its distinct events of a part of the trie; of kind 2 (low), its distinct training entries
    of two-byte contexts; and of kind 3 (low, count), training events whose longest context is one byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, LOT_WORDS):
                own = batch.slice(a, LOT_WORDS)
                words, c = [w.encode() for w in own.column(0).to_pylist()], own.column(1).to_numpy()
                keys, after, part, place, owner = lot_events(words, parts)
                n = np.bincount(place, c[owner], minlength=len(keys)).astype(np.int64)
                yield rows_of(LOTS, 1, kind=0, lot=lot, part=-1, words=[b"\n".join(words)], n=[c.astype(np.int64).tobytes()])
                edges = np.searchsorted(part, np.arange(parts + 1))
                some = np.flatnonzero(np.diff(edges))
                pieces = [slice(edges[p], edges[p + 1]) for p in some]
                yield rows_of(LOTS, len(some), kind=1, lot=lot, part=some, keys=[keys[p].tobytes() for p in pieces], n=[n[p].tobytes() for p in pieces], after=[after[p].tobytes() for p in pieces])
                order, learnt = keys >> 57, n > 0
                pair = (np.where(order > ORDER, after, keys >> 9) & 0xFFFF) << 9 | (keys & 511)
                low = np.unique(pair[learnt & (order > 1)])
                yield rows_of(LOTS, len(low), kind=2, low=low)
                one = learnt & (order == 1)
                yield rows_of(LOTS, int(one.sum()), kind=3, low=keys[one] & 0x1FFFF, count=n[one])
                lot += 1

    return vocabulary.select("word", "c").mapInArrow(run, "kind int, lot long, part int, keys binary, n binary, after binary, words binary, low long, count long")


def low_entries(table: DataFrame, ends: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the contexts of one byte and none: at most 257 * 257 entries, whatever the corpus."""
    up = table.where("kind = 2").select("low").distinct().groupBy(F.col("low").bitwiseAND(F.lit(0x1FFFF)).alias("low")).agg(F.count(F.lit(1)).alias("count"))
    rows = table.where("kind = 3").select("low", "count").unionByName(up).groupBy("low").agg(F.sum("count")).collect()
    found = {int(k): int(n) for k, n in rows}
    if ends:
        found[END_KEY & 0x1FFFF] = ends
    one = np.array(sorted(found), dtype=np.int64)
    symbol, n = np.unique(one & 511, return_counts=True)
    return np.concatenate([(np.int64(1) << 57) | one, symbol]), np.concatenate([[found[int(k)] for k in one], n]).astype(np.int64)


def prices(vocabulary: DataFrame, ends: int) -> tuple[DataFrame, float]:
    """(word, c, cost): log10 of the trie's probability of each word of vocabulary (word, c), learnt from the c; and that of
    the end symbol, which occurs `ends` times."""
    spark = vocabulary.sparkSession
    parts = max(1, vocabulary.count() // PART_WORDS)
    start = staged_count()
    table = stage_table(lots(vocabulary, parts), "lots")
    low = low_entries(table, ends)
    sent = spark.sparkContext.broadcast(low)

    def price(own: pa.Table) -> pa.Table:
        keys, n, after = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in own.column(c)]) for c in ("keys", "n", "after"))
        seen = n > 0
        trie = local_trie(keys[seen], n[seen], after[seen], sent.value)
        found, first, place = np.unique(keys, return_index=True, return_inverse=True)
        cost = trie.cost(found, after[first])[place]
        ends = np.cumsum([len(x.as_buffer()) // 8 for x in own.column("keys")])
        return pa.table({"lot": own.column("lot"), "part": own.column("part"), "words": pa.nulls(own.num_rows, pa.binary()), "n": pa.array([x.tobytes() for x in np.split(cost, ends[:-1])], pa.binary())})

    def add(own: pa.Table) -> pa.Table:
        rows = sorted(own.to_pylist(), key=lambda r: r["part"])
        words, c = rows[0]["words"].split(b"\n"), np.frombuffer(rows[0]["n"], np.int64)
        cost = np.concatenate([np.frombuffer(r["n"], np.float64) for r in rows[1:]])
        _, _, _, place, owner = lot_events(words, parts)
        return pa.table({"word": pa.array([w.decode() for w in words], pa.string()), "c": c, "cost": np.bincount(owner, cost[place], minlength=len(words))})

    costs = table.where("kind = 1").select("lot", "part", "keys", "n", "after").groupBy("part").applyInArrow(price, "lot long, part int, words binary, n binary")
    every = table.where("kind = 0").select("lot", "part", "words", "n").unionByName(costs)
    out = every.groupBy("lot").applyInArrow(add, "word string, c long, cost double")
    end = Trie(*low, np.zeros(len(low[0]), np.int64)).cost(np.array([END_KEY]), np.array([0]))[0]
    out = stage_table(out, "prices")
    drop_staged(start, start + 1)
    return out, float(end)


def known_phrases(met: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(chunk, at, right, state) of the occurrences (chunk, held, at, context, phrase) whose context has a guess, the phrase of the majority of its occurrences in training but for the one that is coded; and the share of
    guesses that come true in each state, learnt from training."""
    start = staged_count()
    own = met.groupBy("context", "phrase").agg(F.count_if(~F.col("held")).alias("n"), F.count(F.lit(1)).alias("rows"))
    own = own.groupBy("context").agg(F.sum("n").alias("total"), F.max(F.struct("n", "phrase")).alias("best"), F.count_if(F.col("n") > 0).alias("kinds"), F.sum("rows").alias("rows"))
    own = stage_table(own.select("context", "total", F.col("best.n").alias("most"), F.col("best.phrase").alias("guess"), "kinds", "rows").where("total > 1 or total = 1 and rows > 1"), "contexts")
    rows = own.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    out = F.when(F.col("held"), 0).otherwise(1)
    other = ~F.col("held") & (F.col("kinds") == 2) & (F.col("total") == 2 * F.col("most"))  # of two equal ones, not the one coded
    right = (F.col("guess") == F.col("phrase")) & ~other
    seen = F.col("most") - F.when(right, out).otherwise(0)
    both = join_by_hot_key(met, own, "context", "rows", max(rows, 1)).withColumn("seen", seen).where((F.col("seen") > 0) & (2 * F.col("seen") > F.col("total") - out))
    both = stage_table(both.select("chunk", "held", "at", right.alias("right"), (F.least("seen", F.lit(STATES)) - 1).cast("int").alias("state")), "phrases")
    drop_staged(start, start + 1)
    tally = np.zeros((STATES, 2))
    for r in both.where("not held").groupBy("state", "right").agg(F.count(F.lit(1)).alias("n")).collect():
        tally[r["state"], int(r["right"])] = r["n"]
    return both.drop("held"), (tally[:, 1] + 0.5) / (tally.sum(axis=1) + 1)


def score(docs: DataFrame, *, held: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    held: SQL for a boolean of a row; rows where it's true are scored but not learnt from (null: learnt from). A text's
    tokens are its words, A-Z lowered, and an end. base_score adds log10((c + 1) / (N + V + 1)) over tokens, with the count
    c in training tokens, their number N and their distinct ones V; score is the model's log10 probability. A null or
    empty text is an end alone. Repeated rows count and are scored each time; an empty table gives an empty one; without
    training rows all symbols are alike. Other columns play no part."""
    marked = docs.select("doc_id", "text", F.coalesce(F.expr(held), F.lit(False)).alias("_held"))
    table = stage_table(coded(marked), "coded")
    lists = table.where("kind = 1").select("chunk", "word", "at", "n")
    start = staged_count()
    vocabulary = stage_table(lists.groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    own = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    ends = table.where("kind = 0 and not held").count()
    n_train, n_distinct = own[0] + ends, own[1] + (ends > 0)
    priced, end_cost = prices(vocabulary, ends)
    drop_staged(start, start + 1)
    guessed, phrase_right = known_phrases(table.where("kind = 3").select("chunk", "held", "at", "context", "phrase"))
    words = lists.select("chunk", "word", "at").join(priced.hint("merge"), "word").select(F.col("chunk").alias("of"), F.col("at").alias("place"), F.col("c").alias("count"), F.col("cost").alias("price"))
    known = words.unionByName(guessed.select(F.col("chunk").alias("of"), F.col("at").alias("place"), "right", "state"), allowMissingColumns=True)
    tally = np.zeros(8)
    for at, n in table.where("kind = 2").groupBy("at").agg(F.sum("n")).collect():
        tally[at] = n
    word_right = (tally[1::2] + 0.5) / (tally[0::2] + tally[1::2] + 1)
    scale = float(np.log10(n_train + n_distinct + 1))

    def add(chunk_docs: pa.Table, known: pa.Table) -> pa.Table:
        plain = known.column("right").is_null().to_numpy()
        place, count, price, right, state = (np.asarray(known.column(c).filter(pa.array(plain if c in ("count", "price") else ~plain))) if c != "place" else known.column(c).to_numpy() for c in ("place", "count", "price", "right", "state"))
        at, spot = place[plain], place[~plain]
        size = int(at.max()) + 1 if len(at) else 0
        base, cost, seen = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
        base[at], cost[at], seen[at] = np.log10(count + 1.0) - scale, price, count > 0
        cost = np.append(cost, end_cost)  # word -1 is the end
        told = np.full(int(spot.max()) + 1 if len(spot) else 0, -1)
        told[spot] = 2 * state.astype(np.int64) + right.astype(np.int64)
        ids = [np.frombuffer(x.as_buffer(), np.int32) for x in chunk_docs.column("ids")]
        spots = [np.frombuffer(x.as_buffer(), np.int32) for x in chunk_docs.column("spots")]
        firsts = chunk_docs.column("at").to_numpy()
        score = np.zeros(len(ids))
        for a in range(0, len(ids), 500):
            flat, owner = joined(ids[a : a + 500])
            guess, state = repeats(flat, owner)
            own, some = cost[flat], guess >= 0
            follows = flat[np.maximum(guess, 0)]
            miss = own + np.log10(1 - word_right[state]) - np.log10(np.maximum(1 - 10 ** cost[follows], 1e-9))
            own = np.where(some, np.where(follows == flat, np.log10(word_right[state]), miss), own)
            if len(told):
                begin = np.cumsum([0] + [len(x) + 1 for x in ids[a : a + 500]])
                start = np.concatenate([x + at for x, at in zip(spots[a : a + 500], begin, strict=False)])
                number = np.concatenate([first + np.arange(len(x)) for x, first in zip(spots[a : a + 500], firsts[a : a + 500], strict=True)])
                stop = np.minimum(np.append(start[1:], len(flat)), begin[np.searchsorted(begin, start, side="right")]) if len(start) else start
                what = np.where(number < len(told), told[np.minimum(number, len(told) - 1)], -1)
                start, stop, what = start[what >= 0], stop[what >= 0], what[what >= 0]
                came, p = what % 2 == 1, phrase_right[what // 2]
                covered = np.zeros(len(own) + 1, np.int64)
                covered[start[came]] += 1
                np.add.at(covered, stop[came], -1)
                own[np.cumsum(covered[:-1]) > 0] = 0
                own[start] += np.log10(np.where(came, p, 1 - p))
            score[a : a + 500] = np.bincount(owner, own)
        n_known = [int(seen[x].sum()) + (ends > 0) for x in ids]
        base_score = [float(base[x].sum() + np.log10(ends + 1.0) - scale) for x in ids]
        return pa.table({"doc_id": chunk_docs.column("doc_id"), "held_out": chunk_docs.column("held"), "n_tokens": pa.array([len(x) + 1 for x in ids], pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([n_train] * len(ids), pa.int64()), "base_score": pa.array(base_score, pa.float64()), "score": score})

    kind = docs.schema["doc_id"].dataType.simpleString()
    left = table.where("kind = 0").select("chunk", "doc_id", "held", "ids", "spots", "at").groupBy("chunk")
    return left.cogroup(known.groupBy("of")).applyInArrow(add, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
