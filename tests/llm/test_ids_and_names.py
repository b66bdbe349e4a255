"""Ids of any type and columns of any name and case go through every operator unchanged."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rostrum.llm import html_extract, licenses, linededup, mixing, packing, periodic, ppm, resampling, rules, search, similar, simhash, vectors, wordpiece

BIG = 2**53 + 1
RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
TEXT = "some words of text number {} that go on for a while, under the MIT license. Released under the MIT License."

CALLS = {
    "op1": lambda d, lab: mixing.mix(d),
    "op2": lambda d, lab: search.top_k(d, d.select(F.col("doc_id").alias("query_id"), "text")),
    "op3": lambda d, lab: ppm.score(d, held="false"),
    "op4": lambda d, lab: licenses.scan(d),
    "op5": lambda d, lab: rules.judge(d, lab),
    "op5 by position": lambda d, lab: rules.judge(d, lab, "region"),
    "op7": lambda d, lab: wordpiece.token_counts(d, RANKS),
    "op8": lambda d, lab: packing.pack(d, TOKENIZER),
    "op9": lambda d, lab: resampling.importance(d, lab),
    "op10": lambda d, lab: simhash.near_duplicates(d),
    "op11": lambda d, lab: linededup.drop_common_lines(d),
    "op13": lambda d, lab: periodic.collapse(d),
    "near copies": lambda d, lab: similar.keep_one(d),
}


def table(spark, ids, kind):
    rows = [(k, TEXT.format(i), "en", "s", "r", i) for i, k in enumerate(ids)]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string, region string, _lines int")


@pytest.mark.parametrize("name", CALLS)
def test_ids_stay_as_they_are(spark, name):
    for ids, kind in (([BIG, None, BIG + 2, -1, BIG + 4], "long"), (["b", None, "a", "", "ß"], "string")):
        labels = spark.createDataFrame([(k, 1, 0) for k in ids[:3]], f"doc_id {kind}, quality int, toxic int")
        out = CALLS[name](table(spark, ids, kind), labels)
        assert dict(out.dtypes)["doc_id"] == {"long": "bigint"}.get(kind, kind)
        got = {r.doc_id for r in out.select("doc_id").collect()}
        assert got == set(ids) or name == "near copies" and got <= set(ids) and got


def test_pages_and_vectors_keep_ids(spark):
    pages = spark.createDataFrame([(BIG, None, "<p>some text</p>"), (None, "u", None)], "page_id long, url string, html string")
    assert {(r.page_id, r.url) for r in html_extract.main_text(pages).collect()} == {(BIG, None), (None, "u")}
    rows = spark.createDataFrame([(BIG, [1.0] * 16, None), (None, [2.0] * 16, 1)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id for r in vectors.encode(vectors.train(rows)).collect()} == {BIG, None}


@pytest.mark.parametrize("name", ["op1", "op5", "op5 by position", "op9", "op11", "op13", "near copies"])
def test_names_of_any_case_stay(spark, name):
    docs = table(spark, [1, 2, 3], "long").toDF("Doc_ID", "Text", "LANG", "Source", "Region", "_lines")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [c for c in CALLS[name](docs, labels).columns if c in docs.columns] == docs.columns


def test_measure_keeps_what_is_called_like_its_own(spark):
    out = rules.measure(table(spark, [1, 2], "long").withColumn("_upper", F.lit("mine")))
    assert {(r._lines, r._upper) for r in out.collect()} == {(0, "mine"), (1, "mine")} and "rule_scores" in out.columns
