"""Licence scans of sentences that the classifier hasn't seen: held-out accuracy, prose around licences, wrapped lines."""

from rostrum.llm import licenses

HELD_OUT = {
    "MIT": ["Released under the MIT License.", "This software is made available under the MIT license.", "The code is MIT licensed.", "You may use it under the terms of the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Distributed under the Apache License, version 2.0.", "The sources are available under the Apache 2.0 license."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is distributed under the terms of the GNU General Public License.", "Released under the GPL v3."],
    "LGPL": ["This work is licensed under the GNU Lesser General Public License, version 3.", "Distributed under the LGPL v2.1."],
    "AGPL": ["Licensed under the GNU Affero General Public License.", "The server is licensed under the AGPL v3."],
    "BSD": ["Distributed under the BSD License.", "This project is licensed under the 3-Clause BSD License."],
    "MPL": ["This work is licensed under the Mozilla Public License, version 2.0.", "Licensed under the MPL 2.0."],
    "CC-BY": ["This work is licensed under CC BY 4.0.", "Text is licensed under a Creative Commons Attribution 3.0 License."],
    "CC-BY-SA": ["Content is licensed under CC BY-SA 4.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This text is licensed under CC BY-NC 4.0."],
    "CC0": ["This text is dedicated to the public domain under CC0 1.0."],
    "unknown": ["All rights reserved.", "Licensed under the Widget Vendor License.", "Copyright 1999 The Town."],
    None: ["Er fuhr mit der Bahn.", "The version of this work that was released is available under the bridge.", "Ten copies of the library book were distributed.", "The foundation published a general notice in June."],
}
PROSE = "We spent the better part of a long and rainy summer writing it, helped by friends and strangers in equal measure, and now at last it is released under the MIT License."
WRAPPED = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the\n"Software"), to deal in the Software without restriction, including the rights\nto use it.'


def test_held_out_families(spark):
    want = [(k, x) for k, v in HELD_OUT.items() for x in v]
    seen = {tuple(licenses.grams_of(x)) for v in licenses.TEMPLATES.values() for x in v}
    assert not [x for _, x in want if tuple(licenses.grams_of(x)) in seen]  # what the features can't tell apart isn't held out
    got = {r.doc_id: r.family for r in licenses.scan(spark.createDataFrame([(i, x) for i, (_, x) in enumerate(want)], "doc_id long, text string")).collect()}
    wrong = [(x, k, got.get(i)) for i, (k, x) in enumerate(want) if got.get(i) != k]
    named = [w for w in wrong if w[2] not in (None, "unknown")]
    assert not named, named
    assert len(wrong) <= 0.1 * len(want), wrong


def test_prose_and_wrapped_lines(spark):
    docs = spark.createDataFrame([(0, PROSE), (1, "A first sentence. " + PROSE + " Another one follows."), (2, WRAPPED), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).where("confirmed").collect()}
    assert {k: r.family for k, r in got.items()} == {0: "MIT", 1: "MIT", 2: "MIT"} and got[1].sentence_no == 1 and got[2].line_no == 0
