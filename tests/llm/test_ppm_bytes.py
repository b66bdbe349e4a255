"""The byte-stream model against a plain one that goes through each text byte by byte."""

import collections
import random
import tracemalloc

import numpy as np
import pytest

from rostrum.llm import ppm, ppm_bytes


def lowered(text):
    return (text or "").encode().lower().split()


def stream(text):
    return b" " * 6 + b"".join(w + b" " for w in lowered(text))


def plain_trie(texts):
    trie = collections.defaultdict(dict)
    for t in texts:
        s = [*stream(t), 256]
        for i in range(6, len(s)):
            c = bytes(s[i - 6 : i])
            trie[c][s[i]] = trie[c].get(s[i], 0) + 1
    for n in range(6, 0, -1):
        for c in [c for c in trie if len(c) == n]:
            for x in trie[c]:
                trie[c[1:]][x] = trie[c[1:]].get(x, 0) + 1
    return dict(trie)


def cost(trie, context, symbol):
    gone, p = set(), 1.0
    for c in (context[i:] for i in range(7)):
        own = {x: n for x, n in trie.get(c, {}).items() if x not in gone}
        if not own:
            continue
        total = sum(own.values())
        if symbol in own:
            return np.log10(p * (own[symbol] - 0.35) / total)
        p *= 0.35 * len(own) / total
        gone |= set(own)
    return np.log10(p / max(1, 257 - len(gone)))


def plain(rows, held):
    train = [t for (_, t), out in zip(rows, held, strict=True) if not out]
    trie = plain_trie(train)

    def prices(text):
        """(context, what it spells, cost) of each word and of the end."""
        s, at, out = stream(text), 6, []
        for w in [*[[*x, 32] for x in lowered(text)], [256]]:
            all_of = s + b"\0"
            out.append((s[at - 6 : at], w, sum(cost(trie, all_of[at + i - 6 : at + i], x) for i, x in enumerate(w))))
            at += len(w)
        return out

    def guesses(text):
        own = prices(text)
        last, run, out = {}, 0, []
        for i, (c, w, _) in enumerate(own):
            g = last.get((tuple(own[i - 1][1]), c)) if i else None
            out.append((g, min(run, 3)))
            run = run + 1 if g is not None and own[g][1] == w else 0
            if i:
                last[tuple(own[i - 1][1]), c] = i
        return own, out

    tally = np.zeros((4, 2))
    for t in train:
        own, got = guesses(t)
        for i, (g, state) in enumerate(got):
            if g is not None:
                tally[state, int(own[g][1] == own[i][1])] += 1
    right, scores = (tally[:, 1] + 0.5) / (tally.sum(axis=1) + 1), []
    for _, t in rows:
        own, got = guesses(t)
        total = 0.0
        for i, (g, state) in enumerate(got):
            if g is None:
                total += own[i][2]
            elif own[g][1] == own[i][1]:
                total += np.log10(right[state])
            else:
                # the guess spelt out here, in this context
                c, w, _ = own[i]
                there = sum(cost(trie, (c + bytes(own[g][1]))[j : j + 6], x) for j, x in enumerate(own[g][1]))
                total += own[i][2] + np.log10(1 - right[state]) - np.log10(max(1 - 10**there, 1e-9))
        scores.append(total)
    return scores


@pytest.mark.parametrize("held", ["doc_id % 7 = 2", "true", "false"])
def test_scores_are_those_of_contexts_that_cross_words(spark, held, monkeypatch):
    monkeypatch.setattr(ppm_bytes, "PART_SHARE", 1 / 100)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcÀé\0") for _ in range(rng.randint(1, 9)))
    texts = [None, "", " \n", "A b", "a B a b a b a b c", "x" * 30]
    for _ in range(15):
        own = [word() for _ in range(12)]
        texts.append(rng.choice([" ", "\n\t"]).join(rng.choice(own) for _ in range(40)))
    rows = list(enumerate(texts))
    out = [i % 7 == 2 if "%" in held else held == "true" for i, _ in rows]
    # the plain model has no phrases: no four words in a row stand twice in these
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in ppm_bytes.score(docs, held=held).collect()}
    for (i, _), want in zip(rows, plain(rows, out), strict=True):
        assert got[i] == pytest.approx(want, rel=1e-5, abs=1e-4), i


def test_the_word_before_tells_the_next(spark):
    """After "red " comes "fox", after "big " comes "dog": the words alone are as frequent either way."""
    rng = random.Random(1)
    pairs = ["red fox", "big dog"]
    rows = [(i, " ".join(rng.choice(pairs) for _ in range(3))) for i in range(300)] + [(1000, "red fox"), (1001, "red dog"), (1002, "big dog"), (1003, "big fox")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_query = {r.doc_id: r.score for r in ppm_bytes.score(docs, held="doc_id >= 1000").collect()}
    assert by_query[1000] > by_query[1001] + 1 and by_query[1002] > by_query[1003] + 1


def test_op3_uses_contexts_that_cross_words(spark, tmp_path):
    from rostrum.llm import queries

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["red fox", "big dog"]) for _ in range(3))) for i in range(400)] + [(1000 + i, ["red fox", "red dog"][i % 2]) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r for r in queries.QUERIES["op3_ppm"](spark, str(tmp_path)).collect() if r.held_out and r.doc_id >= 1000]
    fox, dog = ([r.score for r in got if r.doc_id % 2 == x] for x in (0, 1))
    assert fox and dog and min(fox) > max(dog)


def test_chunks_and_lots_do_not_change_scores(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("the quick brown fox jumps over a lazy dog again".split()) for _ in range(50)) for _ in range(250)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:5]])), "doc_id long, text string").repartition(2)
    one = {r.doc_id: r.score for r in ppm_bytes.score(docs, held="doc_id % 5 = 0").collect()}
    many = {r.doc_id: r.score for r in ppm_bytes.score(docs, held="doc_id % 5 = 0", chunk_bytes=9_000, lot_bytes=2_000).collect()}
    assert one == pytest.approx(many, rel=1e-6)


def test_repeats_in_the_same_context():
    ids, owner = np.array([1, 2, 1, 3, 1, 2]), np.zeros(6, int)
    guess, _ = ppm.repeats(ids, owner, np.array([0, 5, 0, 6, 0, 5]))
    assert guess.tolist() == [-1, -1, -1, -1, -1, 1]
    assert ppm.repeats(ids, owner)[0].tolist() == [-1, -1, -1, 1, -1, 3]


def test_keys_turn_into_the_tries(spark):
    keys, ends, sizes = ppm_bytes.stream([b"ab ", b"", b"\xc3\xa9 "])
    assert sizes.tolist() == [4, 1, 4] and ends.tolist() == [2, 3, 4, 7, 8]
    want = int(ppm.key_of(6, int.from_bytes(b"    ab", "big"), 32))
    assert ppm_bytes.plain_key(keys)[2] == want
    assert (np.sort(np.cumsum(np.diff(np.sort(keys), prepend=0))) == np.sort(keys)).all()


def test_words_of_one_chunk_are_not_sent_back(spark):
    """Only words that training has in another chunk too are sent to a chunk with their count; all counts are right."""
    rows = [(0, "a", 0, 2), (0, "b", 1, 3), (0, "c", 2, 0), (1, "b", 0, 1), (1, "d", 1, 0), (2, "b", 0, 0), (2, "e", 1, 4)]
    lists = spark.createDataFrame(rows, "chunk long, word string, at int, n long")
    assert sorted(map(tuple, ppm_bytes.corrected(lists).collect())) == [(0, 1, 4, False), (1, 0, 4, True), (2, 0, 4, False)]


def test_counts_do_not_depend_on_chunks(spark):
    texts = ["a b c é", "b c d é é", "", "z y x", None, "a é d only held", "held only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in ppm_bytes.score(docs.repartition(n), held="doc_id >= 5").collect()) for n in (4, 1)]
    assert got[0] == got[1]
    train = [w for t in texts[:5] for w in [*(t or "").split(), "end"]]
    known = lambda t: [train.count(w) for w in [*(t or "").split(), "end"]]
    scale = np.log10(len(train) + len(set(train)) + 1)
    want = [(i, len(known(t)), sum(c > 0 for c in known(t)), len(train), round(sum(np.log10(c + 1) - scale for c in known(t)), 9)) for i, t in enumerate(texts)]
    assert got[1] == want


def test_merging_holds_little_besides_its_lists():
    """Keys of long lists are merged a range at a time: a worker of op3_ppm has a share of its executor's memory only."""
    rng = np.random.default_rng(5)
    keys = [np.unique(rng.integers(0, 1 << 57, 900_000)), np.arange(0, 4_000_000, 5), np.arange(0, 4_000_000, 7), np.zeros(0, np.int64)]
    uses = [rng.integers(0, 3, len(x)).astype(np.int32) for x in keys]
    tracemalloc.start()
    found, sums = ppm_bytes.merged(keys, uses)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want, place = np.unique(np.concatenate(keys), return_inverse=True)
    assert (found == want).all() and (sums == np.bincount(place, np.concatenate(uses))).all()
    assert peak < 2.5 * (found.nbytes + sums.nbytes)
    assert [len(x) for x in ppm_bytes.merged(keys[3:], uses[3:])] == [0, 0]


def test_parts_have_all_their_keys_in_order():
    keys = np.unique(np.random.default_rng(6).integers(0, 1 << 57, 5_000))
    got = dict(ppm_bytes.of_parts(keys, 7))
    assert sorted(got) == list(range(7)) and all((ppm_bytes.part_of(keys[own], 7) == p).all() and (np.diff(own) > 0).all() for p, own in got.items())
    assert sum(map(len, got.values())) == len(keys)
