"""LM scoring by prediction by partial matching over the whole byte stream of a text.

A text is its words, A-Z lowered, each followed by one space, and an end; six spaces that are never coded stand before it.
Each byte, and the end, is predicted from the six bytes before it, whatever words they belong to, and after an escape from
five, four, ... and no bytes, with exclusion of the symbols of longer contexts. Escapes (method D), update exclusion, phrase
contexts of four words and the word that the document itself suggests are those of `ppm`, whose trie this uses. The
suggestion is the word that followed the same word and the same six bytes the last time, so what it costs in the trie is
known from there and is excluded exactly after a miss.

Nothing is capped. A chunk of documents is coded as its distinct events (six bytes and a symbol), which are dealt by the last
three bytes of the context to parts of the trie; a part gets all contexts of three bytes and more that end so from all chunks
and sends back what each event costs. Only contexts of two bytes and less go to every part."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm.common import give_back, stage_table
from rostrum.llm.ppm import END, END_HASH, ORDER, Trie, joined, known_phrases, local_trie, phrases, repeats, rows_of, signed

#: A chunk is closed after so many bytes; events are counted after each lot of bytes.
CHUNK_BYTES, LOT_BYTES = 32_000_000, 4_000_000
#: Keys of the longest list that are merged with the others' at once.
MERGED = 100_000
#: The trie has the square root of this many parts for each byte of text: 113 for 841 MB.
PART_SHARE = 1 / 65_536
#: Bytes of the shortest context that a part holds.
SUFFIX = 3
PAD = b" " * ORDER


def stream(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ends, sizes) of texts (words each followed by a space): the event of each byte and of each text's end; the
    places of the events that end a word, or are a text's end; and the number of events of each text.

    A key is the six bytes before, the last one first, and nine bits of symbol."""
    flat = np.frombuffer(b"".join([PAD + x + b" " for x in bodies]), np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1
    two = flat[:-1] | (flat[1:].astype(np.int64) << 8)
    four = two[:-2] | (two[2:] << 16)
    code = four[:-3] | (two[4:-1] << 32)  # at i: the bytes i to i + 5, the last one highest; it predicts i + 6
    after = np.cumsum(sizes + ORDER)
    own = np.ones(len(code), dtype=bool)
    for back in range(ORDER):  # what stands before a text but the first is never coded
        own[after[:-1] - ORDER + back] = False
    at = np.flatnonzero(own)
    symbol = flat[at + ORDER].astype(np.int64)
    last = np.cumsum(sizes) - 1
    ends = np.flatnonzero(symbol == 32)  # the place of a text's end holds a space too
    symbol[last] = END
    return (code[at] << 9) | symbol, ends, sizes


def plain_key(keys: np.ndarray) -> np.ndarray:
    """Keys as the trie has them: the context's length, its bytes with the last one lowest, the symbol."""
    code = ((keys >> 9) << 16).astype(">i8").view("<i8")
    return (np.int64(ORDER) << 57) | (code << 9) | (keys & 511)


def contexts(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The six bytes before each word, or end, of texts one after the other."""
    return keys[np.append(0, ends[:-1] + 1)] >> 9


def planes(x: np.ndarray) -> bytes:
    """Numbers packed: their first bytes, then their second ones and so on, as most of those are zero or alike."""
    return pressed(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def unplaned(x: pa.BinaryScalar, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpressed(x), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def pressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpressed(x: pa.BinaryScalar) -> pa.Buffer:
    data = x.as_buffer()
    return pa.decompress(data[8:], int.from_bytes(data[:8].to_pybytes(), "little"), codec="zstd")


def words_of(x: pa.BinaryScalar) -> list[bytes]:
    return unpressed(x).to_pybytes().split(b"\n")


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((keys >> (9 + 8 * (ORDER - SUFFIX))) * 0x9E3779B1 >> 12) & 0xFFFFFF) % parts


def coded(docs: DataFrame, parts: int, held: str, chunk_bytes: int, lot_bytes: int) -> DataFrame:
    """Chunks of documents: rows of kind 0, 2 and 3 as in `ppm.coded`; of kind 1 (chunk, at, ids, spots, n, context): a part of the
    chunk's words from number `at` on, how often each occurs in training, the sum of that and how many do; of kind 4 (chunk, at, ids, spots): the chunk's distinct
    events in part `at` of the trie and how often they occur in training; and of kind 5 (n): distinct training entries of
    three-byte contexts, as (context << 9 | symbol)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, schema = TaskContext.get().partitionId() << 32, None
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        hashes, count, met, tally = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, np.zeros(8, np.int64)
        lot, lots, n, size = [], [], 0, 0

        def counted() -> None:
            every = np.concatenate(lot)
            lot.clear()
            every.sort()
            learnt = (every & 1 > 0).view(np.int8)
            every >>= 1
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            lots.append((every[first], np.add.reduceat(learnt, first, dtype=np.int32)))
            if sum(len(k) for k, _ in lots[1:]) > len(lots[0][0]):
                lots[:] = [merged(*zip(*lots, strict=True))]

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal hashes, count
            names = iter(number)
            for a in range(0, len(number), 50_000):
                n = count[a : a + 50_000]
                yield rows_of(schema, 1, chunk=chunk, kind=1, at=a, ids=[pressed(b"\n".join(islice(names, 50_000)))], spots=[planes(n)], n=int(n.sum()), context=int((n > 0).sum()))
            number.clear()  # before the events are put in order, which takes as much again
            hashes, count = hashes[:0].copy(), count[:0].copy()
            if lot:
                counted()
            keys, uses = merged(*zip(*lots, strict=True))
            lots.clear()
            low = np.unique(((keys >> (9 + 8 * (ORDER - SUFFIX)) << 9) | (keys & 511))[uses > 0])
            yield rows_of(schema, len(low), chunk=chunk, kind=5, n=low)
            for p, own in of_parts(keys, parts):
                yield rows_of(schema, 1, chunk=chunk, kind=4, at=int(p), ids=[planes(np.diff(keys[own], prepend=0))], spots=[planes(uses[own].astype(np.int64))])

        for batch in batches:
            if schema is None:
                schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("doc_id", batch.schema.field(0).type), ("held", pa.bool_()), ("ids", pa.binary()), ("spots", pa.binary()), ("at", pa.int32()), ("n", pa.int64()), ("context", pa.int64()), ("phrase", pa.int64())])
            for a in range(0, batch.num_rows, 100):
                part, ids, bodies = batch.slice(a, 100), [], []
                outs = np.array(part.column(2).to_pylist(), dtype=bool)
                for text in part.column(1):
                    words = (text.as_py() or "").encode().lower().split()
                    ids.append(np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words)))
                    bodies.append(b" ".join([*words, b""]))
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
                keys, ends, sizes = stream(bodies)
                learnt = ~outs[owner]
                count += np.bincount(flat[learnt & (flat >= 0)], minlength=len(count))
                guess, state = repeats(flat, owner, contexts(keys, ends))
                tally += np.bincount((2 * state + (flat == flat[np.maximum(guess, 0)]))[learnt & (guess >= 0)], minlength=8)
                yield rows_of(schema, part.num_rows, chunk=chunk, kind=0, doc_id=part.column(0), held=part.column(2), ids=[x.tobytes() for x in ids], spots=spots, at=firsts)
                lot.append((keys << 1) | np.repeat(~outs, sizes))
                n, size = n + len(keys), size + len(keys)
                if size >= lot_bytes:
                    counted()
                    size = 0
                if n >= chunk_bytes:
                    yield from close()
                    met, n, size, chunk = 0, 0, 0, chunk + 1
        if schema is not None:
            if n:
                yield from close()
            yield rows_of(schema, 8, chunk=-1, kind=2, at=np.arange(8), n=tally)
            give_back()

    return docs.select("doc_id", "text", held).mapInArrow(run, f"chunk long, kind int, doc_id {kind}, held boolean, ids binary, spots binary, at int, n long, context long, phrase long")


def merged(keys: Sequence[np.ndarray], uses: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, of ascending lists, and the sums of what they come with. Keys are sorted a range at a time, so
    that little is held besides the lists and the result."""
    edges = max(keys, key=len)[MERGED::MERGED]
    cuts = [[0, *np.searchsorted(x, edges).tolist(), len(x)] for x in keys]
    found, sums = [], []
    for r in range(len(edges) + 1):
        own = [slice(c[r], c[r + 1]) for c in cuts]
        every = np.concatenate([x[at] for x, at in zip(keys, own, strict=True)])
        order = np.argsort(every)
        every = every[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
        found.append(every[first])
        sums.append(np.add.reduceat(np.concatenate([x[at] for x, at in zip(uses, own, strict=True)])[order], first))
    return np.concatenate(found), np.concatenate(sums)


def of_parts(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of its keys, ascending) for each part that ascending keys have."""
    part = part_of(keys, parts).astype(np.uint16 if parts < 1 << 16 else np.int32)
    order = np.argsort(part, kind="stable")
    size = np.bincount(part)
    yield from ((p, own) for p, own in enumerate(np.split(order, np.cumsum(size)[:-1])) if len(own))


def low_entries(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts), as the trie has them, of contexts of two bytes and less: at most 257 ** 3 entries whatever the corpus."""
    # three bytes, the last one highest, and the symbol: the first byte goes
    two = F.shiftright("n", 17).bitwiseAND(F.lit(0xFFFF)) * 512 + F.col("n").bitwiseAND(F.lit(511))
    rows = table.where("kind = 5").select("n").distinct().groupBy(two.alias("low")).agg(F.count(F.lit(1)).alias("count")).toArrow()
    low, n = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("low", "count"))
    last, symbol = low >> 17, low & 511
    keys, counts = [(np.int64(2) << 57) | (((low >> 9 & 0xFF) << 8 | last) << 9) | symbol], [n]
    one, n = np.unique(last << 9 | symbol, return_counts=True)
    none, m = np.unique(one & 511, return_counts=True)
    return np.concatenate([*keys, (np.int64(1) << 57) | one, none]), np.concatenate([*counts, n, m]).astype(np.int64)


def prices(table: DataFrame) -> DataFrame:
    """(chunk, part, cost) of the chunks' events: their log10 probabilities, as floats in the order of the keys."""
    sent = table.sparkSession.sparkContext.broadcast(low_entries(table))

    def price(own: pa.Table) -> pa.Table:
        pieces = [np.cumsum(unplaned(x)) for x in own.column("ids")]
        keys, n = merged(pieces, [unplaned(x) for x in own.column("spots")])
        every, seen = plain_key(keys), n > 0
        trie = local_trie(every[seen], n[seen], np.zeros(int(seen.sum()), np.int64), sent.value, SUFFIX)
        cost = trie.cost(every, np.zeros(len(every), np.int64)).astype(np.float32)
        return pa.table({"of": own.column("chunk"), "part": own.column("part"), "cost": pa.array([planes(cost[np.searchsorted(keys, x)]) for x in pieces], pa.binary())})

    return table.where("kind = 4").select("chunk", F.col("at").alias("part"), "ids", "spots").groupBy("part").applyInArrow(price, "of long, part int, cost binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, word, at, n) of the words in rows (chunk, at, ids, spots)."""
    for batch in batches:
        for chunk, at, ids, spots in zip(*(batch.column(i) for i in range(4)), strict=True):
            words, n = words_of(ids), unplaned(spots)
            places = np.arange(at.as_py(), at.as_py() + len(n), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk.as_py())), pa.array(words, pa.binary()).cast(pa.string()), pa.array(places), pa.array(n)], names=["chunk", "word", "at", "n"])


def corrected(lists: DataFrame) -> DataFrame:
    """(chunk, place, count, again) of the words of chunks (chunk, word, at, n) that training has in other chunks too: how often in
    all; again: this chunk has it in training, but isn't the first of those. The count of another word is the chunk's own."""
    every = Window.partitionBy("word")
    seen = lists.withColumn("count", F.sum("n").over(every)).withColumn("first", F.min(F.when(F.col("n") > 0, F.col("chunk"))).over(every))
    return seen.where("count != n").select("chunk", F.col("at").alias("place"), "count", F.expr("n > 0 and chunk != first").alias("again"))


class Bodies:
    """Texts from the numbers of their words in a chunk's list."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words

    def of(self, ids: np.ndarray) -> bytes:
        return b" ".join([*map(self.words.__getitem__, ids.tolist()), b""])


def score(docs: DataFrame, *, held: str, chunk_bytes: int = CHUNK_BYTES, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    held: SQL for a boolean of a row; rows where it's true are scored but not learnt from (null: learnt from). A text's
    tokens are its words, A-Z lowered, and an end. base_score adds log10((c + 1) / (N + V + 1)) over tokens, with the count
    c in training tokens, their number N and their distinct ones V; score is the model's log10 probability. A null or
    empty text is an end alone. Repeated rows count and are scored each time; an empty table gives an empty one; without
    training rows all symbols are alike. Other columns play no part."""
    marked = docs.select("doc_id", "text", F.coalesce(F.expr(held), F.lit(False)).alias("_held"))
    size = marked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, int((size * PART_SHARE) ** 0.5))
    table = stage_table(coded(marked, parts, "_held", chunk_bytes, lot_bytes), "coded")
    lists = table.where("kind = 1").select("chunk", "at", "ids", "spots")
    corrections = stage_table(corrected(lists.mapInArrow(unpacked, "chunk long, word string, at int, n long")), "corrections")
    own = table.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("context"), F.lit(0))).first()
    ends = table.where("kind = 0 and not held").count()
    n_train, n_distinct = own[0] + ends, own[1] - corrections.where("again").count() + (ends > 0)
    guessed, phrase_right = known_phrases(table.where("kind = 3").select("chunk", "held", "at", "context", "phrase"))
    words = lists.select(F.col("chunk").alias("of"), F.col("at").alias("place"), F.col("ids").alias("words"), F.col("spots").alias("uses"))
    words = words.unionByName(corrections.select(F.col("chunk").alias("of"), "place", "count"), allowMissingColumns=True)
    known = words.unionByName(guessed.select(F.col("chunk").alias("of"), F.col("at").alias("place"), "right", "state"), allowMissingColumns=True)
    known = known.unionByName(prices(table), allowMissingColumns=True)
    # the events' keys themselves stand in the table
    known = known.unionByName(table.where("kind = 4").select(F.col("chunk").alias("of"), F.col("at").alias("part"), F.col("ids").alias("keys")), allowMissingColumns=True)
    tally = np.zeros(8)
    for at, n in table.where("kind = 2").groupBy("at").agg(F.sum("n")).collect():
        tally[at] = n
    word_right = (tally[1::2] + 0.5) / (tally[0::2] + tally[1::2] + 1)
    scale = float(np.log10(n_train + n_distinct + 1))

    def add(chunk_docs: pa.Table, known: pa.Table) -> pa.Table:
        rows = {name: known.filter(known.column(name).is_valid()) for name in ("words", "count", "right", "cost", "keys")}
        at, spot = (rows[x].column("place").to_numpy() for x in ("count", "right"))
        lists = sorted(zip(*(rows["words"].column(x) for x in ("place", "words", "uses")), strict=True), key=lambda x: x[0].as_py())
        bodies = Bodies([w for _, x, _ in lists for w in words_of(x)])
        count = np.concatenate([np.zeros(0, np.int64), *[unplaned(x) for *_, x in lists]])
        count[at] = rows["count"].column("count").to_numpy()
        base, seen = np.log10(count + 1.0) - scale, (count > 0).astype(np.int64)
        told = np.full(int(spot.max()) + 1 if len(spot) else 0, -1)
        told[spot] = 2 * rows["right"].column("state").to_numpy().astype(np.int64) + rows["right"].column("right").to_numpy(zero_copy_only=False)
        keys = {p: np.cumsum(unplaned(x)) for p, x in zip(rows["keys"].column("part").to_pylist(), rows["keys"].column("keys"), strict=True)}
        paid = {p: unplaned(x, np.float32) for p, x in zip(rows["cost"].column("part").to_pylist(), rows["cost"].column("cost"), strict=True)}
        look = Lookup(np.concatenate([keys[p] for p in keys]), np.concatenate([paid[p] for p in keys]))
        del keys, paid, rows, known, lists
        ids = [np.frombuffer(x.as_buffer(), np.int32) for x in chunk_docs.column("ids")]
        spots = [np.frombuffer(x.as_buffer(), np.int32) for x in chunk_docs.column("spots")]
        firsts = chunk_docs.column("at").to_numpy()
        score = np.zeros(len(ids))
        for a in range(0, len(ids), 100):
            flat, owner = joined(ids[a : a + 100])
            events, last, _ = stream([bodies.of(x) for x in ids[a : a + 100]])
            guess, state = repeats(flat, owner, contexts(events, last))
            own, some = np.add.reduceat(look.cost(events), np.append(0, last[:-1] + 1)), guess >= 0
            g = np.maximum(guess, 0)
            right = some & (flat[g] == flat)
            # the guessed word costs here what it cost there: its contexts are the same
            miss = own + np.log10(1 - word_right[state]) - np.log10(np.maximum(1 - 10 ** own[g], 1e-9))
            own = np.where(some, np.where(right, np.log10(word_right[state]), miss), own)
            if len(told):
                begin = np.cumsum([0] + [len(x) + 1 for x in ids[a : a + 100]])
                start = np.concatenate([x + at for x, at in zip(spots[a : a + 100], begin, strict=False)])
                number = np.concatenate([first + np.arange(len(x)) for x, first in zip(spots[a : a + 100], firsts[a : a + 100], strict=True)])
                stop = np.minimum(np.append(start[1:], len(flat)), begin[np.searchsorted(begin, start, side="right")]) if len(start) else start
                what = np.where(number < len(told), told[np.minimum(number, len(told) - 1)], -1)
                start, stop, what = start[what >= 0], stop[what >= 0], what[what >= 0]
                came, p = what % 2 == 1, phrase_right[what // 2]
                covered = np.zeros(len(own) + 1, np.int64)
                covered[start[came]] += 1
                np.add.at(covered, stop[came], -1)
                own[np.cumsum(covered[:-1]) > 0] = 0
                own[start] += np.log10(np.where(came, p, 1 - p))
            score[a : a + 100] = np.bincount(owner, own)
        n_known = [int(seen[x].sum()) + (ends > 0) for x in ids]
        base_score = [float(base[x].sum() + np.log10(ends + 1.0) - scale) for x in ids]
        del look, bodies
        give_back()
        return pa.table({"doc_id": chunk_docs.column("doc_id"), "held_out": chunk_docs.column("held"), "n_tokens": pa.array([len(x) + 1 for x in ids], pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([n_train] * len(ids), pa.int64()), "base_score": pa.array(base_score, pa.float64()), "score": score})

    kind = docs.schema["doc_id"].dataType.simpleString()
    left = table.where("kind = 0").select("chunk", "doc_id", "held", "ids", "spots", "at").groupBy("chunk")
    return left.cogroup(known.groupBy("of")).applyInArrow(add, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


class Lookup:
    """Costs by key: tables of places by a hash, each for the keys that found their place taken in the one before."""

    def __init__(self, keys: np.ndarray, cost: np.ndarray) -> None:
        self.keys, self.paid, self.tables = keys, cost, []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            shift = np.uint64(64 - (2 * len(left)).bit_length())
            odd = np.uint64(pow(0x9E3779B97F4A7C15, 2 * len(self.tables) + 1, 1 << 64))
            table = np.zeros(1 << (64 - int(shift)), np.int32)
            slot = self.slot(keys[left], odd, shift)
            table[slot] = left
            left = left[table[slot] != left]
            self.tables.append((table, odd, shift))

    def slot(self, keys: np.ndarray, odd: np.uint64, shift: np.uint64) -> np.ndarray:
        return (keys.view(np.uint64) * odd >> shift).view(np.int64)

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """The costs of keys that are all there."""
        out, todo = np.zeros(len(keys)), None
        for how in self.tables:
            at = how[0][self.slot(keys, *how[1:])]
            hit = self.keys[at] == keys
            if todo is None:
                out, todo = self.paid[at].astype(np.float64), np.flatnonzero(~hit)
            else:
                out[todo[hit]] = self.paid[at[hit]]
                todo = todo[~hit]
            if not len(todo):
                break
            keys = keys[~hit]
        return out
