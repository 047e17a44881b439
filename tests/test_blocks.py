import numpy as np
import pytest

from tabspark.operators.models.blocks import (
    BLOCKS,
    distances,
    group_cells,
    merge_labels,
    nearest_pairs,
    rows_per_block,
    within,
)


def tables(shift=0.0, scale=1.0):
    random = np.random.default_rng(3)
    # Rounded, so that many distances are equal.
    return [random.normal(size=(n, 5)).round(1) * scale + shift for n in (300, 5000)]


@pytest.mark.parametrize("shift,scale", [(0.0, 1.0), (1e7, 1.0), (0.0, 1e-9), (0.0, 1e160)])
def test_screened_pairs_equal_all_distances(shift, scale):
    a, b = tables(shift, scale)
    with np.errstate(over="ignore"):
        d = distances(a, b)
    eps = 0.7 * scale
    near = np.zeros(d.shape, bool)
    for i, j, tile in within(a, b, eps):
        near[i:i + tile.shape[0], j:j + tile.shape[1]] = tile
    assert (near == (d <= eps)).all()
    rows, columns, found = nearest_pairs(a, b, 12)
    order = np.argsort(d, axis=1, kind="stable")[:, :12]
    best = np.take_along_axis(d, order, axis=1)
    at = np.nonzero(np.isfinite(best))
    assert (rows == at[0]).all() and (columns == order[at]).all() and (found == best[at]).all()


def test_a_row_is_not_its_own_neighbour():
    _, b = tables()
    names = np.arange(len(b)) * 3
    d = distances(b[:50], b)
    d[np.arange(50), np.arange(50)] = np.inf
    rows, columns, _ = nearest_pairs(b[:50], b, 4, names[:50], names)
    assert (columns.reshape(50, 4) == np.argsort(d, axis=1, kind="stable")[:, :4]).all()


def test_vectors_are_sent_once_a_block_and_not_once_a_cell():
    """256 cells of 2,344 rows: a vector that no bound excludes goes to some 40 groups."""
    pivots = np.random.default_rng(1).normal(size=(256, 64))
    rows = np.full(256, 2344)
    block = rows_per_block(rows.sum(), 64)
    groups = group_cells(pivots, rows, block)
    assert groups.max() + 1 <= 2 * BLOCKS
    assert np.bincount(groups, rows).max() <= block
    assert len(group_cells(np.empty(0), np.empty(0, int), 10)) == 0


def test_merged_labels_are_the_smallest_of_their_group():
    u, v = np.array([8, 7, 5, 2, 9]), np.array([7, 6, 4, 9, 3])
    assert merge_labels(np.arange(10), u, v).tolist() == [0, 1, 2, 2, 4, 4, 6, 6, 6, 2]
