"""Distances to pivots: right, and without a number for each component of each pair."""

import numpy as np

from gridlight.operators import neighbours
from tests.test_bounded_memory import peak


def test_distances_to_pivots():
    pick = np.random.default_rng(3)
    for n, m, d in ((0, 5, 3), (1, 1, 1), (300, 70, 33), (129, 4, 64)):
        x, y = pick.normal(size=(n, d)) * 50, pick.normal(size=(m, d)) * 50
        np.testing.assert_allclose(neighbours._far(x, y), np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)), rtol=1e-13)
        y[: min(n, m)] = x[: min(n, m)]
        assert (np.diag(neighbours._far(x, y)) == 0).all()


def test_distances_to_pivots_are_made_a_component_at_a_time():
    x, y = np.ones((1000, 33)), np.zeros((1024, 33))
    assert peak(lambda: neighbours._far(x, y)) < 20  # the distances are 8 MB; the differences of 512 rows were 138
