import math

import numpy as np
import pytest

from tabspark.llm import embeddings


def shared_filters(dimension, most, pairs=300):
    """Filters that random pairs at the limit share where the largest label has ``most`` vectors; no such data is made."""
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((2, pairs, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93 ** 2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    codes = embeddings.codes_of(dimension, *embeddings.filters_of(dimension, most))
    lists = []
    for side in (x, y):
        rows, names = embeddings.exceeded(codes, side)
        lists.append([set(names[rows == i].tolist()) for i in range(pairs)])
    return np.array([len(a & b) for a, b in zip(*lists, strict=True)])


@pytest.mark.parametrize("dimension, most", [(64, 5000), (64, 10 ** 5), (64, 10 ** 7), (16, 10 ** 7), (8, 10 ** 6),
                                             (4, 10 ** 5), (3, 1000)])
def test_shared_filters_at_every_size(dimension, most):
    found = shared_filters(dimension, most)
    assert 6.5 < found.mean() < 11
    assert (found > 0).mean() >= 0.95


def test_cap_height_is_the_exact_tail():
    """In 3 dimensions the height is uniform; in 64 the tail is summed over the heights."""
    assert embeddings.cap_height(0.01, 3) == pytest.approx(0.98, abs=1e-6)
    for share in (0.03, 2.56e-5, 1e-8):
        t = embeddings.cap_height(share, 64)
        heights = np.linspace(-1, 1, 2_000_001)
        density = np.maximum(0, 1 - heights ** 2) ** 30.5
        assert density[heights >= t].sum() / density.sum() == pytest.approx(share, rel=1e-3)


def test_few_dimensions_meet_in_one_filter(spark):
    assert embeddings.filters_of(2, 10 ** 6) is None and embeddings.filters_of(1, 10) is None
    rng = np.random.default_rng(2)
    rows = [(i, 0, rng.standard_normal(2).tolist()) for i in range(90)]
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    wanted = (x @ x.T >= 0.93).sum(axis=1) - 1
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    found = embeddings.near_vectors(frame, block=16).orderBy("vec_id").collect()
    assert [r["n_links"] for r in found] == wanted.tolist()


def test_each_label_has_filters_of_its_own_size(spark):
    """A label of 5,000 vectors beside one of 20: the small one is exact, the large one finds its links."""
    rng = np.random.default_rng(9)

    def close(x, cosine):
        y = rng.standard_normal(64)
        y -= (y @ x) * x
        return cosine * x + math.sqrt(1 - cosine ** 2) * y / np.linalg.norm(y)

    x = rng.standard_normal((5020, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 400, 2):
        x[i + 1] = close(x[i], 0.9305)
    for i in range(5000, 5020, 2):
        x[i + 1] = close(x[i], 0.9301 if i % 4 else 0.9299)
    rows = [(i, int(i >= 5000), x[i].tolist()) for i in range(5020)]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(3)
    found = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(frame).collect()}
    small = (x[5000:] @ x[5000:].T >= 0.93).sum(axis=1) - 1
    assert [found[i] for i in range(5000, 5020)] == small.tolist() and small.sum() == 10
    assert sum(found[i] for i in range(0, 400)) >= 0.95 * 400
    assert all(found[i] == 0 for i in range(400, 5000))
