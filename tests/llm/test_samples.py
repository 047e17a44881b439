"""The sample that classifiers are fitted on: the same members in the same order, however the rows lie."""

import numpy as np
import pytest

from tabspark.llm import quality, toxicity
from tabspark.llm.common import labelled_sample
from tests.llm.helpers import DOCS


@pytest.fixture(scope="module")
def tables(spark):
    """Ids that stand for two texts, texts of several ids, labels that contradict each other."""
    bad, good = "xqz wrp junk ", "the and of plain words "
    rows = []
    for i in range(300):
        text = (good if i % 3 else bad) * (2 + i % 5) + str(i // 4)
        rows.append((i, text, "en", "s", len(text)))
        if i % 7 == 0:
            rows.append((i, text + " another text", "en", "s", len(text) + 13))
    rows.append((301, "long " * 5000, "en", "s", 25000))
    labels = [(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(302)] + [(i, 0, 1) for i in range(0, 300, 11)]
    return (spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_sample_does_not_depend_on_partitions(tables):
    docs, labels = tables
    found = [labelled_sample(docs.repartition(n), labels.repartition(n), "quality", 60) for n in (1, 7)]
    assert found[0][0] == found[1][0]
    assert (found[0][1] == found[1][1]).all() and np.array_equal(found[0][2], found[1][2])
    assert len(found[0][0]) == len(set(zip(*found[0][:2], strict=True)))
    assert not any(t.endswith("another text") for t in found[0][0])


@pytest.mark.parametrize("train", [quality.train, toxicity.train])
def test_scores_do_not_depend_on_partitions(tables, train):
    docs, labels = tables
    texts = [r["text"] for r in docs.limit(40).collect()]
    a, b = (train(docs.repartition(n), labels.repartition(n)).scores(texts) for n in (1, 7))
    assert np.array_equal(a, b)


def test_length_of_texts_is_a_parameter(tables):
    docs, labels = tables
    has = [any(t.startswith("long ") for t in labelled_sample(docs, labels, "quality", 500, longest=n)[0])
           for n in (20_000, 30_000, None)]
    assert has == [False, True, True]
