"""Common lines, vector codes and periodic runs against brute force, on small tables with nulls, ties, repeats and clashing names."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm import linededup, periodic, queries, vectors

DOCS = "doc_id long, text string, pos int, key string, gone int, n_lines string, runs string, copy int, last int, line string"


def with_extras(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, 1, "k", 2, "mine", "mine", 3, 4, "l") for i, t in rows], schema).repartition(3)


# common lines


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))


def brute_lines(rows, min_docs=3, min_chars=20):
    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= min_chars:
                holders[line_key(line)].add(i)
    least = lambda i: (i is not None, i)
    gone = {k: max(v, key=least) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if line_key(x) not in gone or gone[line_key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def line_rows(seed):
    rng = random.Random(seed)
    shared = [f"a line that documents share, number {k} ÄÖ" for k in range(12)] + ["x" * 19, "x" * 20, "é" * 20, " " * 20]
    rows = []
    for i in range(60):
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "\r", " \x0b"]) if rng.random() < 0.6 else f"own line {i} {rng.random()} of this document" for x in rng.choices(shared, k=rng.randint(0, 9))]
        rows.append((i, "\n".join(lines)))
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "\n".join([shared[0]] * 50)), (None, shared[1]), (None, shared[1] + "\nother"), rows[3], rows[3], (3, "another text of id 3, long enough\n" + shared[2]), (70, "\n".join(f"own {k}" + (f"\n{shared[k % 12]}" if k % 3 else "") for k in range(3000)))]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_common_lines(spark, seed):
    rows = line_rows(seed)
    out = linededup.drop_common_lines(with_extras(spark, rows))
    assert sorted(out.columns) == sorted([*(c.split()[0] for c in DOCS.split(", ")), "n_dropped"])
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str)
    assert got == brute_lines(rows)


def test_common_lines_without_broadcast(spark, monkeypatch):
    """Beyond the bounds for broadcasts the result is the same."""
    monkeypatch.setattr(linededup, "FEW_ROWS", 0)
    rows = line_rows(7)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linededup.drop_common_lines(with_extras(spark, rows)).collect()), key=str)
    assert got == brute_lines(rows)


def test_common_lines_other_bounds_and_empty(spark):
    rows = line_rows(8)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linededup.drop_common_lines(with_extras(spark, rows), min_docs=2, min_chars=1).collect()), key=str)
    assert got == brute_lines(rows, 2, 1)
    assert linededup.drop_common_lines(with_extras(spark, [])).count() == 0
    ids = spark.createDataFrame([(c, "the same line in all of them") for c in "abc"], "Doc_ID string, Text string")
    out = linededup.drop_common_lines(ids)
    assert out.columns[:2] == ["Doc_ID", "Text"] and {(r[0], r[1]) for r in out.collect()} == {("a", ""), ("b", ""), ("c", "the same line in all of them")}


def test_common_lines_plan_has_no_python(spark):
    out = queries.op11_line_dedup(spark, "/root/testdata/sf0.001")
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


# vector codes


def brute_codes(rows, rounds=2, parts=16, entries=64):
    """The contract in plain integers, every entry compared."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    start = list(first.values())[:entries]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in start] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            drawn = collections.defaultdict(list)
            for _, v, _ in kept:
                drawn[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(drawn[e]) for x in zip(*drawn[e], strict=True)] if e in drawn else c for e, c in enumerate(books[p])]
    out, totals = [], collections.Counter()
    for i, v, label in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
        totals[label] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((*r, totals[r[1]]) for r in out), key=str), digest


def vector_rows(seed, n=150, dims=32):
    rng = np.random.default_rng(seed)
    data = np.round(rng.normal(size=(n, dims)) * rng.choice([0.01, 1, 3], size=(n, 1)), 2).astype(np.float32)
    rows = [(int(i), [float(x) for x in v], int(i) % 4 if i % 9 else None) for i, v in enumerate(data)]
    rows[5] = (5, None, 1)
    rows[6] = (6, [None, *rows[6][1][1:]], 1)
    rows[7] = (7, [float("nan"), *rows[7][1][1:]], 1)
    rows[8] = (8, [float("-inf"), *rows[8][1][1:]], None)
    rows[9] = (9, [0.0] * dims, 2)
    rows[10] = (10, [0.0] * dims, 2)
    rows[20] = rows[21] = rows[22]
    rows[30] = (None, rows[30][1], 3)
    return [*rows, (3, rows[4][1], 3), (None, rows[2][1], 7)]


@pytest.mark.parametrize(("seed", "n"), [(0, 150), (1, 40), (2, 400)])
def test_vector_codes(spark, seed, n):
    rows = vector_rows(seed, n)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, error string, v string").repartition(3)
    books = vectors.train(df)
    got = sorted((tuple(r) for r in vectors.encode(books).select("vec_id", "label", "code", "error", "label_error").collect()), key=str)
    want, digest = brute_codes(rows)
    assert got == want and books.digest() == digest


def test_vector_codes_label_sums_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FEW_LABELS", 0)
    rows = vector_rows(4, 90, 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in vectors.encode(vectors.train(df)).select("vec_id", "label", "code", "error", "label_error").collect()), key=str)
    assert got == brute_codes(rows)[0]


def test_annulus_equals_all_entries():
    """Points on and beside entries, entries of equal norm, one entry: the nearest is the lowest of the nearest."""
    rng = np.random.default_rng(0)
    for width, count in itertools.product((1, 2, 4), (1, 2, 64)):
        entries = rng.integers(-6, 7, size=(count, width))
        points = np.concatenate([rng.integers(-8, 9, size=(300, width)), entries, np.zeros((1, width), dtype=np.int64)])
        gaps = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        index, least = vectors.nearest(points, entries)
        assert (least == gaps.min(axis=1)).all() and (index == gaps.argmin(axis=1)).all()


def test_vector_codes_of_nothing_and_of_odd_vectors(spark):
    schema = "vec_id string, embedding array<double>, label string"
    empty = vectors.encode(vectors.train(spark.createDataFrame([], schema)))
    assert empty.columns == ["vec_id", "label", "code", "error", "label_error"] and empty.count() == 0
    bad = vectors.encode(vectors.train(spark.createDataFrame([("a", None, None), ("b", [None] * 16, "x")], schema)))
    assert bad.count() == 0
    some = spark.createDataFrame([("a", [1.0] * 16, None), ("b", [2.0] * 16, None), ("c", [1.0] * 15, "z"), ("d", [], "z")], schema)
    assert {(r.vec_id, r.code, r.label_error) for r in vectors.encode(vectors.train(some)).collect()} == {("a", "00" * 16, 0), ("b", "01" * 16, 0)}
    with pytest.raises(ValueError, match="equal parts"):
        vectors.train(spark.createDataFrame([("a", [1.0] * 15, None)], schema))
    with pytest.raises(ValueError, match="too large"):
        vectors.train(spark.createDataFrame([("a", [1e30] * 16, None)], schema))


# periodic runs


def brute_runs(w, least):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(least, 2 * p) and not any(all(w[k] == w[k + q] for k in range(i, i + size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_of_all_short_texts():
    for letters, longest in ((1, 9), (2, 11), (3, 8)):
        for n in range(longest + 1):
            for w in itertools.product([b"b", b"a", b"c"][:letters], repeat=n):
                assert periodic.runs_of(list(w), 2) == brute_runs(w, 2), w


def repetitive(rng):
    w, n = [], rng.randint(1, 120)
    while len(w) < n:
        if w and rng.random() < 0.5:
            at, size = rng.randrange(len(w)), rng.randint(1, 12)
            w += w[at : at + size] * rng.randint(1, 4)
        else:
            w.append(str(rng.randrange(4)).encode())
    return w


def test_runs_of_repetitive_texts():
    rng = random.Random(2)
    for _ in range(1500):
        w = repetitive(rng)
        for least in (2, 12):
            assert periodic.runs_of(w, least) == brute_runs(w, least), w


class Seen(list):
    """Numbers that count how often they are looked at."""

    looked = 0

    def __getitem__(self, i):
        Seen.looked += 1
        return super().__getitem__(i)


@pytest.mark.parametrize("kind", ["one word", "two words in turn", "fibonacci", "random", "doubling"])
def test_runs_take_linear_time(kind):
    def looks(n):
        rng, a, b, ruler = random.Random(0), [0], [0, 1], [0]
        while len(b) < n:
            a, b = b, b + a
        while len(ruler) < n:
            ruler = ruler + [len(ruler)] + ruler
        w = {"one word": [0] * n, "two words in turn": [0, 1] * (n // 2), "fibonacci": b[:n], "random": [rng.randrange(2) for _ in range(n)], "doubling": ruler[:n]}[kind]
        Seen.looked = 0
        periodic.lyndon_runs(Seen([*w, -1]), 2, set())
        return Seen.looked

    assert looks(16000) < 16 * 16000 and looks(16000) < 9 * looks(2000)


def planted(i, words):
    h, n = zlib.crc32(str(i).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if k < a else words[a + (k - a) % p] for k, x in enumerate(words)]


def brute_row(i, text):
    w = planted(i, (text or "").encode().split())
    runs = brute_runs(w, 12) if len(set(w)) < len(w) else []
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_periodic_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(x.decode() + "é" for x in repetitive(rng))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "one"), (304, "a " * 500), (305, "  " * 20), (None, "a b " * 20), rows[4], (4, "x y z " * 9)]
    rows += [(i, t) for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 10 == 0 for t in (" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 90))), None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [brute_row(i, t) if i is not None else None for i, t in rows]
    own = [r for r in map(tuple, got.collect()) if r[0] is not None]
    assert sorted(own, key=str) == sorted(filter(None, want), key=str)


def test_collapse_of_odd_tables(spark):
    out = periodic.collapse(with_extras(spark, [(None, "a b c d " * 4 + "e"), (1, None), (1, None)]))
    assert sorted((str(r.doc_id), r.text, [tuple(x) for x in r.runs]) for r in out.collect()) == [("1", "", []), ("1", "", []), ("None", "a b c d e", [(0, 16, 4)])]
    assert dict(out.dtypes)["runs"].startswith("array") and dict(out.dtypes)["n_lines"] == "string"
    assert periodic.collapse(with_extras(spark, [])).count() == 0


def test_positions_that_are_large_and_words_that_repeat_far_apart():
    far = [b"%d" % k for k in range(30000)]
    assert periodic.runs_of(far + far) == [(0, 60000, 30000)]
    assert periodic.runs_of(far + [b"x"] + far) == []
    assert periodic.collapsed(far + far, [(0, 60000, 30000)]) == far
