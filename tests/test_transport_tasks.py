"""Auctions and primal-dual steps inside a task against the joins."""

import random

import pytest

from loomgraph.operators import transport as X


def _problems(spark):
    rng = random.Random(9)
    arcs = [(m, a, b, rng.randrange(6)) for m in range(2) for a in range(14) for b in range(4) if rng.random() < 0.8]
    arcs += [(0, 30, 3, 5), (0, 30, 3, 2), (1, 31, 0, 4)]  # an arc that comes twice, rows with one column
    return spark.createDataFrame(arcs, "m int, a long, b long, unit_cost long").cache(), spark.createDataFrame([(0, 3), (1, 5), (2, 4), (3, 6)], "b long, capacity long").cache()


def _rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_no_window_runs_over_rows_of_a_small_problem(spark, monkeypatch):
    arcs, cols = _problems(spark)
    monkeypatch.setattr(X, "Window", None)
    got, rest, rounds = X.auction(arcs, cols, ["m"], step=1, exact=False)
    assert rounds > 1 and got.select("m", "a").distinct().count() + rest.count() == arcs.select("m", "a").distinct().count()
    assert len({r["m"] for r in X.settled(arcs, cols, ["m"]).prices.collect()}) == 2
    with pytest.raises(X.StillBidding):
        X.auction(arcs, cols, ["m"], step=1, exact=False, max_rounds=2)


def test_tasks_equal_the_joins(spark, monkeypatch):
    arcs, cols = _problems(spark)
    found = []
    for most in (X.ARCS, 0):
        monkeypatch.setattr(X, "ARCS", most)
        got, rest, rounds = X.auction(arcs, cols, ["m"], step=2, exact=False)
        one = X.settled(arcs.where("m = 0").drop("m"), cols)
        found.append((_rows(got), _rows(rest), rounds, _rows(one.assigned), _rows(one.prices.select("b", "price")), _rows(one.rest), one.steps))
    assert found[0] == found[1]
