import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tabspark.llm import quality, simhash, toxicity
from tabspark.llm.queries import BYTE_BPE
from tests.llm.helpers import tricky_docs
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_rules_licenses_private import base_spans


def test_run_equals_the_plain_steps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good, clean = quality.train(docs, labels), toxicity.train(docs, labels)
    kept = {k: t for k, t in rows.items() if good.scores([t])[0] >= quality.THRESHOLD}
    kept = {k: t for k, t in kept.items() if clean.scores([t])[0] < toxicity.THRESHOLD}
    kept = {k: kept[k] for k in plain_kept(kept)[0]}
    plain = Tokenizer.from_file(BYTE_BPE)
    texts = {}
    for r in corpus_pipeline.run(spark, small).collect():
        tokens = np.frombuffer(r["tokens"], "<u4").tolist()
        assert len(tokens) + r["padding"] == 2048
        for p in r["pieces"]:
            texts.setdefault(p["doc_id"], {})[p["start"]] = tokens[p["offset"]:p["offset"] + p["length"]]
    assert set(texts) == set(kept)
    for k, parts in texts.items():
        ids = [i for at in sorted(parts) for i in parts[at]]
        assert ids[-1] == 1
        text = plain.decode(ids[:-1], skip_special_tokens=False)
        assert base_spans(text) == []
        if not base_spans(kept[k]) and "[SECRET]" not in text:
            assert text == kept[k]


@pytest.mark.parametrize("extra", [False, True])
def test_stages_take_tricky_rows(spark, small, extra):
    docs = tricky_docs(spark, extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, small)
        assert found.columns == docs.columns, name
        assert found.count() <= docs.count()
        assert stage(spark, docs.limit(0), small).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert sum(len(r["tokens"]) for r in packed.collect()) > 0
    assert simhash.RADIUS == 2
