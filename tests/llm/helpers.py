"""Inputs that every operator must take, and plain versions of what operators compute."""

from __future__ import annotations

import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TRICKY = [
    None, "", " ", "\n\n", "a", "two words", "é漢😀 mixed   blanks\t\tand\nlines", "x" * 3000, "word " * 2500,
    "same line\nsame line\nsame line\nother", "# $ % & | < > * symbols!!", "<|endoftext|> is text here",
    "NUL \0 inside \x1c and　wide blank", "one two three one two three one two three",
]


def tricky_docs(spark, extra: bool = False):
    """Rows with nulls in every column, empty and long texts, and repeated rows."""
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(TRICKY)]
    rows += [rows[6], (None, "no id", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for name in ("score", "spans", "ids", "fp", "digest", "start", "label", "v", "k", "grp", "kept"):
            docs = docs.withColumn(name, F.lit("clash"))
    return docs


def words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
