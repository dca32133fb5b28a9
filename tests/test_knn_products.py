"""Blocks compared by matrix products give the sums' distances to the last bit, ties and far offsets included."""

import time

import numpy as np

from loomgraph.operators import knn as N


def _sums(q, r, ids, k):
    block = np.zeros((len(q), len(r)))
    for d in range(q.shape[1]):
        diff = q[:, d][:, None] - r[:, d][None, :]
        block += diff * diff
    order = np.argsort(block, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(block, order, axis=1), ids[order]


def test_products_agree_with_sums():
    rng = np.random.default_rng(4)
    for offset, scale in ((0.0, 1.0), (1e6, 1e-3), (-3.0, 1e5)):
        r = offset + scale * rng.normal(size=(600, 64))
        r[100:200] = r[:100]  # ties go to the smaller id
        r[200:300] = r[:100] + 1e-9 * scale
        q = np.concatenate([r[:150], offset + scale * rng.normal(size=(50, 64))])
        ids = np.arange(600) * 3
        for k in (1, 5):
            want, got = _sums(q, r, ids, k), N._best(q, r, ids, k)
            assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_values_that_are_no_numbers_take_the_sums():
    r = np.random.default_rng(1).normal(size=(100, 20))
    r[7, 3] = np.inf
    q = r[:5] + 0.1
    assert (N._best(q, r, np.arange(100), 3)[1] == _sums(q, r, np.arange(100), 3)[1]).all()


def test_many_dimensions_cost_less_than_their_sums():
    rng = np.random.default_rng(2)
    q, r, ids = rng.normal(size=(1500, 64)), rng.normal(size=(2500, 64)), np.arange(2500)
    N._best(q, r, ids, 5)
    took = []
    for f in (N._best, _sums):
        began = time.process_time()
        f(q, r, ids, 5)
        took.append(time.process_time() - began)
    assert took[0] < took[1] / 2
