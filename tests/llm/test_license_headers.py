"""Licenses as they stand in files, and the scan against word by word matching."""

import re
import textwrap

import duckdb
import pytest

from tabspark.llm import licenses
from tests.llm.helpers import TRICKY, tricky_docs

WORDS = dict((name, words) for name, words in licenses.SENTENCES)
MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
       "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
       "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
       "permit persons to whom the Software is furnished to do so, subject to the following conditions:")
GPL = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
       "License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any "
       "later version.")
APACHE = ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
          "with the License. You may obtain a copy of the License at", "", "    http://www.apache.org/licenses/LICENSE-2.0", "",
          "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
          "on an \"AS IS\" BASIS."]


def _comment(lines, leader):
    wrapped = [x for line in lines for x in (textwrap.wrap(line, 70) or [""])]
    body = "\n".join(f"{leader} {x}".rstrip() for x in wrapped)
    return f"/*\n{body}\n */\nint main;" if leader == " *" else f"{body}\nimport os"


CASES = [(_comment(["Copyright (c) 2020 X", "", MIT], leader), "MIT") for leader in (" *", "#", "//", ";;", "--")]
CASES += [(_comment(["Copyright (c) 2020 X", MIT], leader), "MIT") for leader in (" *", "#")]
CASES += [(_comment([GPL], leader), "GPL-3.0-or-later") for leader in (" *", "#", "//")]
CASES += [(_comment(APACHE, leader), "Apache-2.0") for leader in (" *", "#")]
CASES += [
    ("This project is licensed under the MIT License.", "MIT"),
    ("Released under" + " " * 5000 + "the MIT license.", "MIT"),
    ("# License\n\nDistributed under the MIT License. See LICENSE.", "MIT"),
    ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0-or-later"),
    ("// SPDX-License-Identifier: Apache-2.0\nx", "Apache-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy", "MPL-2.0"),
    ("unlicensed under the mit licenses", None), ("we like the MIT license", None),
    ("licensed under the. MIT license", None), ("Copyright X. All rights reserved.", "proprietary"),
]


def test_headers_as_they_stand_in_files(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(docs).collect()}
    assert found == {i: name for i, (_, name) in enumerate(CASES)}


def plain_ids(text, sentences=licenses.SENTENCES):
    """Word by word: the longest known sentence at each place, then on behind it."""
    low = re.sub(licenses._END, lambda m: (m[1] or "") + "\x01", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for part in low.split("\x01"):
        words, at = re.findall("[a-z0-9]+", part), 0
        while at < len(words):
            fits = [(len(s.split()), name) for name, s in sentences if words[at:at + len(s.split())] == s.split()]
            if fits:
                found.append(max(fits)[1])
            at += max(fits)[0] if fits else 1
    return ",".join(found)


@pytest.mark.parametrize("extra", [False, True])
def test_ids_equal_word_by_word_matching_and_sql(spark, extra):
    docs = tricky_docs(spark, extra)
    more = [(100 + i, t, None, None, None) for i, (t, _) in enumerate(CASES)]
    more += [(200 + i, f"x {s}. {s} {s}\n\n{s[:-1]}", None, None, None) for i, (_, s) in enumerate(licenses.SENTENCES)]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, docs.select(
        "doc_id", "text", "lang", "source", "n_chars").schema))
    rows = sorted((tuple(r) for r in licenses.scan_licenses(docs).collect()), key=repr)
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    assert all(r[3] == plain_ids(texts[r[0]]) for r in rows if r[0] is not None)
    assert len(rows) == len(TRICKY) + 3 + len(more)
    con = duckdb.connect()
    table = docs.select("doc_id", "text").toPandas()
    con.register("documents", table)
    con.execute("CREATE VIEW d AS SELECT 1")
    wanted = con.execute(licenses.oracle()).fetchall()
    clean = [tuple(None if v != v else int(v) if i == 0 and v is not None else v for i, v in enumerate(r)) for r in wanted]
    assert sorted(clean, key=repr) == rows


def test_triggers_cover_every_sentence():
    chosen = licenses.triggers(licenses.SENTENCES)
    assert all(set(words.split()) & set(chosen) for _, words in licenses.SENTENCES) and len(chosen) < 12
