"""The pipeline's near-duplicates against brute force."""

import random

import pytest

from rostrum.llm import similar


def five(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


def groups_of(rows):
    sets, root = [five(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def rows_of(seed):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(3000))
    texts = ["", None, " \n", "one two", "ONE two", "one two three four five"]
    passage = [word() for _ in range(40)]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
        texts.append(" ".join(passage + base[:15]))
    crowd = [word() for _ in range(120)]
    for _ in range(40):
        own = list(crowd)
        for _ in range(2):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    return list(enumerate(texts))


@pytest.mark.parametrize("crowd", [64, 1])
def test_keeps_one_of_all_texts_that_are_similar(spark, crowd):
    rows = rows_of(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in similar.keep_one(docs, crowd=crowd).collect()} == groups_of(rows)


def test_pipeline_stage_removes_copies_that_differ_in_a_few_words(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[: 40 * i] + ["x"] + words[40 * i + 1 :])) for i in range(5)] + [(5, " ".join(words[:150] + [f"y{i}" for i in range(50)])), (None, "alone a b c d e"), (None, "alone a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["0", "5", "None"]
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def near_copies(n, seed=3):
    """Copies of a text with a fifth of their own words each at the end, so that few are similar to another one, and the text."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join(base)]
    for i in range(n):
        k = rng.randint(1, 22)
        texts.append(" ".join(base[: 100 - k] + [f"o{i}x{j}" for j in range(k)]))
    return list(enumerate(texts))


def test_pairs_of_a_crowd_do_not_grow_with_its_square(spark, monkeypatch):
    made, own = {}, similar.stage_table

    def counting(df, name):
        made[name] = max(made.get(name, 0), (out := own(df, name)).count())
        return out

    rows = near_copies(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(similar, "stage_table", counting)
    assert {r.doc_id for r in similar.keep_one(docs).collect()} == groups_of(rows)
    assert made["meet"] < 4 * len(rows), made


def test_links_come_from_fingerprints_first(spark, monkeypatch):
    """Texts whose fingerprints are two bits apart at most are met through the multi-index; what is far is met anyway."""
    rows = [(i, " ".join([*(f"w{j}" for j in range(3000)), f"x{i}"])) for i in range(3)] + [(9, " ".join(f"z{j}" for j in range(30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, own = [], similar.printed_pairs

    def looking(sets):
        out = own(sets)
        seen.append(out.count())
        return out

    monkeypatch.setattr(similar, "printed_pairs", looking)
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == [0, 9]
    assert seen and seen[0] >= 2


def test_a_crowd_gets_leaders_however_many_other_rows_there_are(spark, monkeypatch):
    """Copies with four words changed, similar to their base and to few others: they are linked by a leader, not by pairs, though
    their pairs are few for each row of all prefixes."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(150):
        own = list(base)
        for j in rng.sample(range(5, 195), 4):
            own[j] = f"o{i}x{j}"
        texts.append(" ".join(own))
    made, own_stage = {}, similar.stage_table

    def counting(df, name):
        made[name] = max(made.get(name, 0), (out := own_stage(df, name)).count())
        return out

    monkeypatch.setattr(similar, "stage_table", counting)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in similar.keep_one(docs).collect()} == groups_of(rows)
    assert made["meet"] < 8 * len(rows), made


def test_a_shared_passage_is_one_bucket(spark):
    """Texts that share a passage are a row each under it, not one for each of its shingles."""
    passage = " ".join(f"p{i}" for i in range(400))
    rows = [(i, passage + " " + " ".join(f"o{i}x{j}" for j in range(20))) for i in range(12)]
    marked = spark.createDataFrame(rows, "_fp long, text string")
    _, shared = similar.buckets(marked, similar.LEAST, similar.WIDTH)
    got = shared.collect()
    assert len(got) == 12 and len({r.h for r in got}) == 1 and all(r.w > 40 and r.left == r.w for r in got)
