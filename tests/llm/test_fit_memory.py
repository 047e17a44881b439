"""Fits run on the driver, beside Spark's own memory there: what they hold at once stays small."""

import random
import tracemalloc

import numpy as np

from tabspark.llm import quality, toxicity


def sample():
    rnd = random.Random(1)
    known = [f"word{i}" for i in range(2000)]
    texts = [" ".join(rnd.choices(known, k=500)) + (" vile" if i % 4 == 0 else "") for i in range(600)]
    y = np.array([i % 4 == 0 for i in range(600)], np.int64)
    return texts, y, np.ones(600)


def test_toxicity_fit_holds_few_bytes_a_word():
    texts, y, weights = sample()
    tracemalloc.start()
    try:
        toxicity.fit(texts, y, weights, rounds=2)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 200 * 300_000


def test_quality_fit_leaves_no_dictionary():
    quality._codes.cache_clear()
    quality.fit(*sample(), epochs=1)
    assert quality._codes.cache_info().currsize == 0


def test_features_of_a_sample_are_those_of_its_texts():
    texts = ["", *sample()[0][:300], " \n"]
    found, wanted = quality.sample_features(texts), quality.features(texts)
    for name in ("ends", "index", "count", "stats"):
        assert np.array_equal(getattr(found, name), getattr(wanted, name)), name
    assert len(quality.sample_features([]).ends) == 0
