"""The corpus operators against brute force, on small tables with nulls, ties, repeats and clashing names."""

import collections
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from rostrum.llm import html_extract, licenses, mixing, packing, ppm, resampling, rules, search, simhash, wordpiece
from rostrum.llm.common import running_total

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _hash string, n int, chunk string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return (text or "").encode().split()


def corpus(n=160, seed=0):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(8, 60))) for _ in range(n)]
    for i in range(0, n, 9):
        texts[i] = texts[0]
    for i in range(4, n, 11):
        texts[i] = texts[4] + " " + rng.choice(vocab)
    texts[1], texts[2], texts[3] = "", None, " \n\t "
    texts[5] = "Don't Ünïcode stop ßharp İstanbul ΣΑΣ ²x a_b foo123 <|endoftext|> é  x naïve," * 3
    texts[6] = " ".join(rng.choice(vocab) for _ in range(6000))
    texts[7] = "x" * 5000
    return [(None if i == 8 else i // 2 if i in (20, 21) else i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), None, "h", 1, "c") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 5 != 0, 0) for i in range(0, 160, 2)] + [(None, True, 0), (9999, True, 1)], "doc_id long, q boolean, toxic int").select("doc_id", F.col("q").cast("int").alias("quality"), "toxic")


def test_running_total(spark):
    rows = [(g, random.Random(i).getrandbits(63) - (1 << 62), i, i % 7) for i in range(500) for g in ("x", "y")[: 1 + (i % 3 == 0)]]
    df = spark.createDataFrame(rows, "g string, h long, i int, v int")
    got = {(r.g, r.i): r.total for r in running_total(df, ["g"], "h", ["i"], F.col("v").cast("long"), "total", 16).collect()}
    for g in ("x", "y"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (((r[1] + (1 << 64)) % (1 << 64)) >> 60, r[1], r[2]))
        total = 0
        for r in own:
            assert got[g, r[2]] == total
            total += r[3]


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 3, 300) == pytest.approx([187.5, 75, 37.5])
    got = mixing.water_fill([10, 1000, 500], [5, 2, 1], 3, 1510)
    assert got[0] == 30 and sum(got) == pytest.approx(1510) and got[1] == pytest.approx(2 * got[2])
    assert mixing.water_fill([0, 0], [1, 2], 3, 0) == [0, 0]


def test_splitting_tree():
    quotas = [17, 0, 301, 5]
    counts = mixing.splitting_tree(quotas, 7, 1)
    assert counts.sum(axis=1).tolist() == quotas and (counts >= 0).all()
    assert counts.sum(axis=0).max() - counts.sum(axis=0).min() <= 3
    assert (counts == mixing.splitting_tree(quotas, 7, 1)).all()
    k = 97
    a = mixing.coprime(k, np.random.default_rng(0))
    assert sorted(a * b % k for b in range(k)) == list(range(k))


def test_mix(docs, empty):
    out = mixing.mix(docs, block_words=50, shard_words=300)
    got = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns and len(got) == 160
    source = collections.Counter()
    for r in got:
        source[r.source] += len(words(r.text))
    order = sorted(x for x in source if x is not None) + [None]
    target = dict(zip(order, mixing.water_fill([source[s] for s in order], [5, 2, 1], 3, sum(source.values())), strict=True))
    taken, seen = collections.Counter(), set()
    for r in got:
        assert r.mix_size == len(words(r.text)) and r.mix_source_size == source[r.source] and r.mix_target == pytest.approx(target[r.source])
        assert r.mix_taken == sum(p.n_words for p in r.mix_pieces) <= 3 * r.mix_size
        taken[r.source] += r.mix_taken
        seen |= {p.shard for p in r.mix_pieces}
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order) and len(seen) > 3
    again = mixing.mix(docs.repartition(5), block_words=50, shard_words=300)
    key = lambda r: (str(r.doc_id), r.text or "", r.mix_pieces)
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))
    assert mixing.mix(empty).count() == 0


def test_mixture_cuts_the_last_piece(docs):
    rows = mixing.mixture(docs, block_words=50, shard_words=300).collect()
    whole = {r.text for r in docs.collect()}
    n = collections.Counter()
    for r in rows:
        n[r.source] += len(words(r.text))
        assert r.text in whole or any(t and t.startswith(r.text) for t in whole)
    assert {s: x for s, x in n.items()} == {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum("mix_taken").alias("n")).collect() if r.n}


def fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_of(prints, roots=False):
    """Smallest id (or the root, one for each component) by brute force: prints is a list of (id, fingerprint)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    if roots:
        return [find(i) for i in range(len(prints))]
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(prints))]


@pytest.mark.parametrize("limit", [64, 1])
def test_simhash(docs, empty, limit):
    rows = docs.collect()
    prints = [(r.doc_id, fingerprint(r.text)) for r in rows]
    want = sorted(map(str, zip((d for d, _ in prints), (f"{p:016x}" for _, p in prints), component_of(prints), strict=True)))
    got = simhash.near_duplicates(docs, bucket_limit=limit).select("doc_id", simhash.hex16(F.col("fp")), "component_id").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    if limit == 64:
        assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("limit", [64, 2])
def test_links_of_chains_and_crowds(spark, limit):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b for b in base} | {base[0] ^ (1 << i) for i in range(40)} | {base[1] ^ (1 << i) ^ (1 << (63 - i)) for i in range(20)}
    x = base[2]
    for i in range(0, 60, 2):  # a chain whose ends are far apart
        x ^= (1 << i) | (1 << (i + 1))
        fps.add(x)
    fps |= {0, 1 << 63, (1 << 64) - 1}
    signed = lambda v: v - (1 << 64) * (v >> 63)
    found = simhash.components(simhash.near_pairs(spark.createDataFrame([(signed(v),) for v in fps], "fp long"), bucket_limit=limit)).collect()
    root = {r.node: r.root for r in found}
    want = component_of([(signed(v), v) for v in fps])
    assert [root.get(signed(v), signed(v)) for v in fps] == want


def test_keep_one(docs):
    kept = simhash.keep_one(docs).collect()
    rows = docs.collect()
    comps = component_of([(r.doc_id, fingerprint(r.text)) for r in rows])
    assert len(kept) == len(set(component_of([(r.doc_id, fingerprint(r.text)) for r in rows], roots=True))) and {r.doc_id for r in kept} == set(comps)


def repeated(w):
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_rule_measures(spark, docs, labels, empty):
    texts = ["a b c d e a b c d e", "a b c d e f", "a a a a a a a", "x\ny\nx\n \n\nx", "#* $%&|<> ok", "é è ê", None, "", "a b c d e x a b c d e y a b c d e"]
    df = docs.select("doc_id", "text", "lang", "n").unionByName(spark.createDataFrame([(1000 + i, t, None, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n int"))
    for r in rules.judge(df, labels).collect():
        t = r.text or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.rule_words, r.rule_chars, r.rule_symbols, r.rule_dup_lines, r.rule_repeats) == (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated(w)), t[:80]
        assert r.rule_base_failed == (len(w) < 10 or 100 * repeated(w) > 20 * len(w))
        assert r.rule_kept is False or not r.rule_base_failed
    assert rules.judge(empty, labels).count() == 0
    assert rules.judge(df, labels.limit(0)).where("rule_kept = rule_base_failed").count() == 0


def test_binomial_tail(spark):
    import math

    rows = [(k, n) for n in (1, 10, 300, 5000) for k in (0, 1, 3, 20) if k <= n]
    df = spark.createDataFrame(rows, "k long, n long").withColumn("p", rules.log_binomial_tail(F.col("k"), F.col("n"), 0.01))
    for k, n, p in df.collect():
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.01) + (n - i) * math.log(0.99)) for i in range(k + 1))
        assert p == (0 if k >= n * 0.01 and k else pytest.approx(math.log(exact), abs=1e-9)) or k == 0


def test_thresholds_control_the_risk(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    rows = [(i, " ".join(word() + ("%%%" if i % 10 == 0 and rng.random() < 0.6 else "") for _ in range(40)), "en") for i in range(4000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(4000)], "doc_id long, quality int")
    got = rules.judge(docs, labels).select("doc_id", "rule_kept", "rule_cuts").collect()
    bad = [r for r in got if r.doc_id % 10 == 0]
    good = [r for r in got if r.doc_id % 10]
    assert sum(r.rule_kept for r in bad) < 0.02 * len(bad) and sum(not r.rule_kept for r in good) < 0.03 * len(good)
    few = rules.judge(docs, labels.where("doc_id < 100")).where("not rule_kept").count()
    assert few == 0  # too few labels prove nothing


def test_importance(spark, docs, labels, empty):
    out = resampling.importance(docs, labels, keep_share=0.25)
    rows = out.collect()
    keys = sorted((r.dsir_key for r in rows), reverse=True)
    least = keys[round(0.25 * len(rows)) - 1]
    assert all(r.dsir_kept == (r.dsir_key >= least) for r in rows) and sum(r.dsir_kept for r in rows) >= 40
    assert all(r.dsir_weight == 0 for r in rows if not words(r.text))
    assert resampling.importance(empty, labels).count() == 0
    assert resampling.importance(docs, labels.limit(0)).where("not dsir_kept").count() == 0


def test_kth_largest(spark):
    rng = random.Random(2)
    x = [rng.getrandbits(64) - (1 << 63) for _ in range(300)] + [5] * 40 + [-(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in x], "v long")
    for k in (1, 2, 50, 171, 200, len(x)):
        assert resampling.kth_largest(df, "v", k) == sorted(x, reverse=True)[k - 1]
    assert resampling.kth_largest(df, "v", 0) is None and resampling.kth_largest(df, "v", len(x) + 1) is None


def test_pack(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack(docs, TOKENIZER, window=256).collect()
    by_seq = collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length > 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and (at == 256 or at & (at - 1) == 0)
    want = collections.Counter(np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for r in docs.collect())
    parts = collections.defaultdict(list)
    for r in rows:
        parts[r.doc_id, r.doc_tokens].append(r)
    unique = {r.doc_id for r in docs.groupBy("doc_id").count().where("count = 1 and doc_id is not null").collect()}
    for (doc, n), own in parts.items():
        if doc in unique:
            whole = b"".join(r.ids for r in sorted(own, key=lambda r: r.start))
            assert len(whole) == 4 * n and whole in want
    assert sum(r.length for r in rows) == sum(len(k) // 4 * v for k, v in want.items())
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_word_ids_equal_whole_texts():
    from tokenizers import Tokenizer

    t, ids = Tokenizer.from_file(TOKENIZER), packing.WordIds(TOKENIZER)
    for text in [r[1] or "" for r in corpus()] + ["İ Σς ΑΣ, ﬁ ½ ² x² _a a_ Ⅷ É é́ don't we'll 'S ͅa \x1c\x85 a b", "Große ÉLÈVE!! foo,,, 12 3.5 a1b"]:
        assert np.frombuffer(ids(text), np.uint32).tolist() == t.encode(text, add_special_tokens=False).ids, text[:60]


def test_tail_edges():
    for total in (0, 1, 255, 256, 1000, 4095):
        edges = packing.tail_edges(total, 256)
        sizes = np.diff([total - total % 256, *edges]).tolist()
        assert sum(sizes) == total % 256 and all(x & (x - 1) == 0 for x in sizes)


def test_ppm(spark, docs, empty):
    rows = {(r.doc_id, r.n_tokens): r for r in ppm.score(docs, held="doc_id % 7 = 2").collect()}
    train, ends = collections.Counter(), 0
    for r in docs.collect():
        if r.doc_id is None or r.doc_id % 7 != 2:
            train.update(w.lower() for w in words(r.text))
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + 1
    for r in docs.collect():
        w = [x.lower() for x in words(r.text)]
        got = rows[r.doc_id, len(w) + 1]
        assert got.train_tokens == n and got.n_known == sum(x in train for x in w) + 1 and got.held_out == (r.doc_id is not None and r.doc_id % 7 == 2)
        base = sum(np.log10((train[x] + 1) / (n + v + 1)) for x in w) + np.log10((ends + 1) / (n + v + 1))
        assert got.base_score == pytest.approx(base) and got.score < 0
    assert ppm.score(empty, held="false").count() == 0
    assert ppm.score(docs, held="true").where("isnan(score) or score >= 0 or n_known > 0").count() == 0


def plain_trie(counts, ends):
    """{context: {symbol: n}} of a PPM trie with update exclusion; the contexts of a word of more than six bytes are whole."""
    longest = collections.defaultdict(collections.Counter)
    for w, n in counts.items():
        seq = b" " + w + b" "
        for i in range(1, len(seq)):
            longest["whole" if 6 < i <= 32 else min(i, 6), seq[:i] if i <= 32 else seq[i - 6 : i]][seq[i]] += n
    longest[1, b" "][256] += ends
    trie, above = {}, {}
    for order in ["whole", 6, 5, 4, 3, 2, 1, 0]:
        own = collections.defaultdict(collections.Counter, {k: v for k, v in longest.items() if k[0] == order})
        for (o, c), symbols in above.items():
            for x in symbols:
                own[order, c[-6:] if o == "whole" else c[1:]][x] += 1
        trie |= own
        above = own
    return trie


def plain_cost(trie, context, symbol):
    chain = [("whole", context)] if 6 < len(context) <= 32 else []
    chain += [(n, context[len(context) - n :]) for n in range(min(6, len(context)), -1, -1)]
    chain = chain[next((i for i, c in enumerate(chain) if c in trie), len(chain)) :]
    gone, p = set(), 1.0
    for c in chain:
        own = {x: n for x, n in trie[c].items() if x not in gone}
        if not own:
            continue
        total = sum(own.values())
        if symbol in own:
            return np.log10(p * (own[symbol] - 0.35) / total)
        p *= 0.35 * len(own) / total
        gone |= set(own)
    return np.log10(p / max(1, 257 - len(gone)))


def plain_ppm(rows, held):
    """Scores by the definitions, one text after another."""
    texts = [[w.lower() for w in words(r.text)] + [None] for r in rows]
    train = [t for t, out in zip(texts, held, strict=True) if not out]
    trie = plain_trie(collections.Counter(w for t in train for w in t[:-1]), len(train)) if train else {}
    price = {w: sum(plain_cost(trie, (b" " + w + b" ")[:i], (b" " + w + b" ")[i]) for i in range(1, len(w) + 2)) for t in texts for w in t[:-1]}
    price[None] = plain_cost(trie, b" ", 256)

    def guesses(t):
        last, run, out = {}, 0, [(None, 0)]
        for i in range(1, len(t)):
            g = last.get(t[i - 1])
            out.append((g, min(run, 3)))
            run = run + 1 if g is not None and t[g] == t[i] else 0
            last[t[i - 1]] = i
        return out

    def pieces(t):
        h = np.array([ppm.END_HASH if w is None else xxhash.xxh64_intdigest(w, 42) for w in t], np.uint64)
        start, stop, _, _ = ppm.phrases(h, np.zeros(len(t), int))
        return [(a, b, tuple(t[a - 4 : a]), tuple(t[a:b])) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]

    tally = np.zeros((4, 2))
    for t in train:
        for w, (g, state) in zip(t, guesses(t), strict=True):
            if g is not None:
                tally[state, int(t[g] == w)] += 1
    follow = collections.defaultdict(collections.Counter)
    for t in train:
        for _, _, c, p in pieces(t):
            follow[c][p] += 1

    def phrase_guess(c, p, out):
        own = follow[c] if out else follow[c] - collections.Counter([p])
        best = max(own.items(), key=lambda x: x[1], default=(None, 0))
        return (best[0], min(best[1], 4) - 1) if 2 * best[1] > sum(own.values()) else None

    ours = np.zeros((4, 2))
    for t in train:
        for _, _, c, p in pieces(t):
            g = phrase_guess(c, p, False)
            if g:
                ours[g[1], int(g[0] == p)] += 1
    share = lambda x: (x[:, 1] + 0.5) / (x.sum(axis=1) + 1)
    word_right, phrase_right, scores, used = share(tally), share(ours), [], 0
    for t, out in zip(texts, held, strict=True):
        own = []
        for w, (g, state) in zip(t, guesses(t), strict=True):
            if g is None:
                own.append(price[w])
            elif t[g] == w:
                own.append(np.log10(word_right[state]))
            else:
                own.append(price[w] + np.log10(1 - word_right[state]) - np.log10(max(1 - 10 ** price[t[g]], 1e-9)))
        for a, b, c, p in pieces(t):
            g = phrase_guess(c, p, out)
            if g and g[0] == p:
                own[a:b] = [np.log10(phrase_right[g[1]])] + [0] * (b - a - 1)
                used += 1
            elif g:
                own[a] += np.log10(1 - phrase_right[g[1]])
        scores.append(sum(own))
    return scores, used


@pytest.mark.parametrize("held", ["doc_id % 7 = 2", "true", "false"])
def test_ppm_against_a_plain_one(spark, docs, held, monkeypatch):
    monkeypatch.setattr(ppm, "PART_WORDS", 7)
    rng = random.Random(9)
    more = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(120)) for _ in range(6)]
    more += [more[0], more[0], more[1] + " tail", "head " + more[2], more[3] + " " + more[3], "y" * 40 + " " + "y" * 40]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    rows = df.collect()
    out = [bool(r.doc_id is not None and r.doc_id % 7 == 2) if "%" in held else held == "true" for r in rows]
    want, used = plain_ppm(rows, out)
    got = sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in ppm.score(df, held=held).collect())
    assert used > 20 or held == "true"
    for x, y in zip(got, sorted((str(r.doc_id), len(words(r.text)) + 1, round(s, 6)) for r, s in zip(rows, want, strict=True)), strict=True):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], abs=1e-4), (x, y)


def test_ppm_is_a_distribution():
    vocabulary = [b"banana", b"ban", b"bandana", b"an", b"nab", b"longerthansevenbytes", b"longerthansixbytes"]
    keys, after, _ = ppm.events(vocabulary * 3)
    found, one, n = np.unique(keys, return_index=True, return_counts=True)
    found, after, n = np.append(found, ppm.END_KEY), np.append(after[one], 0), np.append(n, 4)
    entries, above = {}, {}
    for order in range(ppm.ORDER + 1, -1, -1):
        own = {int(k): [int(c), int(a)] for k, c, a in zip(found, n, after, strict=True) if k >> 57 == order}
        for k, a in above.items():
            up = (int(ppm.shorter(np.array([k >> 9]), np.array([a[1]]))[0]) << 9) | (k & 511)
            own.setdefault(up, [0, 0])[0] += 1
        entries |= own
        above = own
    trie = ppm.Trie(np.array(list(entries)), np.array([e[0] for e in entries.values()]), np.array([e[1] for e in entries.values()]))
    for i, c in enumerate(trie.contexts):
        every = (np.full(257, c) << 9) | np.arange(257)
        up = np.full(257, trie.contexts[trie.up[i]])
        assert (10 ** trie.cost(every, up)).sum() == pytest.approx(1)


def test_repeats():
    ids = np.array([1, 2, 1, 2, 1, 2, 3, -1, 1, 2, -1])
    owner = np.array([0] * 8 + [1] * 3)
    guess, state = ppm.repeats(ids, owner)
    assert guess.tolist() == [-1, -1, -1, 1, 2, 3, 4, -1, -1, -1, -1] and state.tolist() == [0, 0, 0, 0, 1, 2, 3, 0, 0, 0, 0]


def test_longest_match():
    rng = random.Random(3)
    vocab = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(40)}
    first, then = {v for v in vocab if v[0] != ord("c")} | {b"c"}, vocab - {b"a"}
    m = wordpiece.LongestMatch(first, then)

    def greedy(w):
        i = n = 0
        while i < len(w):
            pieces = first if i == 0 else then
            j = next((j for j in range(len(w), i, -1) if w[i:j] in pieces), None)
            if j is None:
                return 1
            i, n = j, n + 1
        return n

    for _ in range(3000):
        w = bytes(rng.choice(b"abcd" if rng.random() < 0.05 else b"abc") for _ in range(rng.randint(1, 14)))
        assert m.count(w) == greedy(w), w


def test_token_counts(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = wordpiece.token_counts(docs, path)
    assert got.count() == 160 and got.where("n_tokens < n_words").count() == 0 and got.where("n_words = 0").count() == 3
    assert wordpiece.token_counts(empty, path).count() == 0


@pytest.mark.parametrize(("block", "common", "shard"), [(64, 24, 1_000_000), (3, 4, 400)])
def test_search(spark, docs, empty, block, common, shard):
    big = (1 << 60) + 1  # lost in a double
    docs = docs.unionByName(docs.where("doc_id in (4, 15, 30)")).withColumn("doc_id", F.when(F.col("doc_id") == 30, F.lit(big)).otherwise(F.col("doc_id"))).repartition(2)
    asked = docs.where(f"doc_id % 10 = 0 or doc_id = {big}").select(F.col("doc_id").alias("query_id"), "text")
    rows = docs.collect()
    bags = [collections.Counter(w.lower() for w in words(r.text)) for r in rows]
    size = [sum(b.values()) for b in bags]
    mean, df = sum(size) / len(rows), collections.Counter(w for b in bags for w in b)
    got = collections.defaultdict(list)
    for r in search.top_k(docs, asked, 5, width=block, share=common, shard_words=shard).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    twice = {q for q, n in collections.Counter(r.query_id for r in asked.distinct().collect()).items() if n > 1}
    asked_rows = [q for q in asked.distinct().collect() if q.query_id not in twice]
    assert len(asked_rows) > 10 and big in got
    for q in asked_rows:
        scores = []
        for r, b, n in zip(rows, bags, size, strict=True):
            s = sum(c * np.log1p((len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * n / mean)) for w, c in collections.Counter(w.lower() for w in words(q.text)).items() if w in b)
            if s > 0:
                scores.append((r.doc_id, s))
        scores.sort(key=lambda x: (-round(x[1], 9), -1 if x[0] is None else x[0]))
        assert [(i, d) for i, d, _ in got[q.query_id]] == [(i, d) for i, (d, _) in enumerate(scores[:5], 1)]
        assert [x for _, _, x in got[q.query_id]] == pytest.approx([x for _, x in scores[:5]])
    assert search.top_k(empty, asked).count() == 0 and search.top_k(docs, asked.limit(0)).count() == 0


def test_licences(spark, empty):
    lines = ["Some prose.\nLicensed under CC BY-NC 4.0.\nMore.", "Released under the MIT License.", None, "", "He lost his driving license in May.", "All rights reserved.", "Licensed under the Apache License, Version 2.0.\nLicensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "permission " * 5000]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(lines)], "doc_id long, text string, line string, gram int")
    got = {(r.doc_id, r.line_no): r for r in licenses.scan(docs).collect()}
    assert got[0, 1].family == "CC-BY-NC" and got[1, 0].family == "MIT" and got[7, 0].family == "GPL" and (4, 0) not in got
    assert got[5, 0].family == "unknown" and not got[5, 0].confirmed and got[6, 0].family == got[6, 1].family == "Apache-2.0"
    assert licenses.scan(empty).count() == 0
    for line in ("Licensed under CC BY-NC 4.0.", "v2.1 the a-b.c x", ""):
        assert sorted(spark.range(1).select(licenses.grams(F.lit(line))).first()[0]) == licenses.grams_of(line)


def test_html(spark):
    cut = html_extract.trained().extract
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div><article><h1>A &amp; B</h1><p>First   line<br>goes on, and on.<p><b>Second</b> paragraph &lt;here&gt;&#33;</p><div class=ad>Buy now</div></article><section class="comments"><p>Nice post, thanks.</p></section><form><label>Mail</label></form><footer>&copy; 2020 site</footer>'
    assert cut(page) == "A & B\nFirst line goes on, and on.\nSecond paragraph <here>!"
    assert cut(None) == cut("") == cut("<script>alert('x')") == ""
    assert cut("<" * 2000) is not None and cut("<div>" * 3000 + "x") is not None
    wrong = total = 0
    for text, content in html_extract.labelled_pages(60, seed=77):
        got = [x for x in cut(text).split("\n") if x]
        total += len(content)
        wrong += len(set(got) ^ content)
    assert wrong < 0.08 * total
    pages = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "y"), (None, "v", "", "z")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.n_chars) for r in html_extract.main_text(pages).collect()) == [(0, 0), (1, len(cut(page))), (2, 0)]
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_marginals_are_exact():
    nodes = html_extract.parse("<div><p>one two.</p><ul><li>three</li></ul></div><p>four</p>")
    m = html_extract.Model({"tag=p": 0.7, "in=li": -0.4}, 0.1, (((-0.2, -1.5), (-1.1, -0.4)), ((-0.1, -2.0), (-2.5, -0.2))))
    one = [m.bias + sum(m.weights.get(x, 0.0) for x in f) for f in html_extract.features(nodes)]
    weight = np.zeros((len(nodes), 2))
    for bits in range(1 << len(nodes)):
        y = [bits >> i & 1 for i in range(len(nodes))]
        z = sum(o * k for o, k in zip(one, y, strict=True)) + sum(m.pairs[v.tag == "#"][y[v.parent]][k] for v, k in zip(nodes[1:], y[1:], strict=True))
        for i, k in enumerate(y):
            weight[i, k] += np.exp(z)
    assert m.marginals(nodes) == pytest.approx((weight[:, 1] / weight.sum(axis=1)).tolist())


def test_pipeline(spark):
    import corpus_pipeline
    from rostrum.llm import queries

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    pieces = out.collect()
    assert pieces and {"doc_id", "ids", "sequence_id"} <= set(out.columns)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert set(queries.QUERIES) == {f"op{n}_{x}" for n, x in zip(range(1, 14), ["mixing", "bm25_search", "ppm", "license_scan", "quality_rules", "html_text", "token_counts", "packing", "importance_resampling", "simhash", "line_dedup", "vector_codes", "periodic_runs"], strict=True)}


def test_held_out_rows_by_crc(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(50)], "doc_id long, text string")
    got = ppm.score(docs, held="pmod(crc32(cast(doc_id as string)), 7) = 2").collect()
    assert {r.doc_id for r in got if r.held_out} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2}


def test_columns_may_have_any_name(spark, labels):
    from rostrum.llm import similar

    names = ["_hash", "_source", "_index", "_take", "_before", "_passes", "_shards", "_piece", "_range", "_order", "_fp", "_rep", "_doc", "_rows", "fp", "root", "_lines", "_upper", "_stratum", "cuts", "key", "h", "a.b", "mix_note", "rule_note"]
    rows = [(i, f"some words of text number {i % 7} that go on for a while " * 2, "en", "s", *[f"{n}/{i}" for n in names]) for i in range(30)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    want = {r[0]: r[4:] for r in rows}
    own = [f"`{n}`" for n in names]
    calls = {"mix": mixing.mix(df), "mixture": mixing.mixture(df), "importance": resampling.importance(df, labels), "keep": resampling.keep(df, labels), "judge": rules.judge(df, labels), "rules.keep": rules.keep(df, labels, stratum="source"), "keep_one": simhash.keep_one(df), "similar": similar.keep_one(df)}
    for name, out in calls.items():
        assert [c for c in out.columns if c in df.columns] == df.columns, name
        got = out.select("doc_id", *own).collect()
        assert all(tuple(r)[1:] == want[r.doc_id] for r in got) and (got or name == "rules.keep"), name
    clash = df.withColumn("mix_taken", F.lit("mine")).withColumn("rule_kept", F.lit("mine"))
    assert dict(mixing.mix(clash).dtypes)["mix_taken"] == "bigint" and dict(rules.judge(clash, labels).dtypes)["rule_kept"] == "boolean"


def test_weights_by_brute_force(spark, docs, labels):
    """Each weight again from its definition, bucket by bucket."""
    rows = docs.collect()
    target = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, chosen = collections.Counter(), collections.Counter()

    def grams(text):
        h = [zlib.crc32(w.lower()) for w in words(text)]
        return [x % resampling.BUCKETS for x in h] + [(a * 0x9E3779B1 + b) % 2**64 % 0xFFFFFFFB % resampling.BUCKETS for a, b in zip(h, h[1:])]

    for r in rows:
        raw.update(grams(r.text))
        if r.doc_id is not None and r.doc_id in target:
            chosen.update(grams(r.text))
    n, t = sum(raw.values()) + resampling.BUCKETS, sum(chosen.values())

    def ratio(b):
        p = (raw[b] + 1) / n
        return np.log((chosen[b] + 50 * p) / (t + 50)) - np.log(p)

    got = sorted((r.dsir_weight for r in resampling.importance(docs, labels).collect()))
    assert got == pytest.approx(sorted(sum(ratio(b) for b in grams(r.text)) for r in rows), abs=1e-6)
