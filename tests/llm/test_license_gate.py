"""The gate of the licence scan loses no line that would be confirmed."""

from rostrum.llm import licenses


def test_confirms_lines_without_the_word_licence(spark):
    lines = ["This work is available under Apache 2.0.", "Released under the 3-Clause BSD.", "Distributed under the MIT.", "The band released a record."]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert {k: r.family for k, r in got.items()} == {0: "Apache-2.0", 1: "BSD", 2: "MIT"} and all(r.confirmed for r in got.values())
