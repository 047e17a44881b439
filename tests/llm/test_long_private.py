"""Texts with very many spans: right places, and time in proportion to the text."""

import time

import pytest
from pyspark.sql import functions as F

from tabspark.llm import pii
from tests.llm.helpers import DOCS
from tests.llm.test_rules_licenses_private import base_spans


def _text(n):
    parts = ["user.%d@mail%d.example.org, +49 30 %07d é漢😀" % (i, i % 7, 1234567 + i) if i % 3 else
             "host 10.%d.2.%d\n" % (i % 256, i % 199) for i in range(n)]
    return " ".join(parts)


def _docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS).coalesce(1)


def test_many_spans_stand_where_they_are(spark):
    text = _text(700) + "x" * 3000 + " last@one.org"
    found = pii.find_private(_docs(spark, text)).first()["spans"]
    own = [(s["kind"], s["start"], s["end"]) for s in found if s["kind"] in pii.BASE]
    assert sorted(own) == sorted(base_spans(text)) and len(own) > 1000
    scores = {s["kind"]: s["score"] for s in found}
    assert scores["ip"] == pytest.approx(0.9)


def test_redaction_of_many_and_overlapping_spans(spark):
    text = _text(500)
    docs = _docs(spark, text, "mail 1@2.3.4.5.6 and +49 30 1234567", "é" * 5000 + "a@b.cd" + "漢" * 5000, "a@b.cd", "none @")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_private(docs).collect()}
    for row in pii.redact(docs).collect():
        old = docs.filter(F.col("doc_id") == row["doc_id"]).first()["text"]
        at, out = 0, []
        for s in sorted(spans[row["doc_id"]], key=lambda s: (s["start"], -s["end"], s["kind"])):
            if s["start"] >= at:
                out += [old[at:s["start"]], f"[{s['kind'].upper()}]"]
            at = max(at, s["end"])
        assert row["text"] == "".join(out) + old[at:] and row["n_chars"] == len(row["text"])


def test_time_grows_with_the_spans_only(spark):
    def took(n):
        docs = _docs(spark, _text(n)).cache()
        docs.count()
        best = 1e9
        for _ in range(2):
            start = time.perf_counter()
            pii.redact(docs).agg(F.sum(F.length("text"))).first()
            pii.find_private(docs).agg(F.sum(F.size("spans"))).first()
            best = min(best, time.perf_counter() - start)
        return best

    took(100)
    assert took(9600) < 4.5 * took(2400)


def test_column_names_of_its_own_do_not_clash(spark):
    docs = _docs(spark, "write to a@b.cd").withColumn("redacted", F.lit(1)).withColumn("__redacted", F.lit(2))
    row = pii.redact(docs).first()
    assert (row["text"], row["redacted"], row["__redacted"]) == ("write to [EMAIL]", 1, 2)
