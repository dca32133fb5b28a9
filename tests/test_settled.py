"""Assignments where rows outbid each other for many rounds."""

import itertools
import random

import numpy as np

from loomgraph.core.session import cut
from loomgraph.operators import transport as X
from loomgraph.plans import register as G


def _war(spark, rows=60, places=3):
    """Rows that all want the same places, which have room for one row more than there are."""
    rng = random.Random(3)
    arcs = [(a, b, b * 4 + rng.randrange(2)) for a in range(rows) for b in range(places)]
    arcs = spark.createDataFrame(arcs, "a long, b long, unit_cost long")
    return arcs, spark.createDataFrame([(b, rows // places + (b == 0)) for b in range(places)], "b long, capacity long")


def test_a_long_auction_is_left_and_the_optimum_proved(spark, monkeypatch):
    arcs, caps = _war(spark)
    seen = []
    monkeypatch.setattr(X, "settled", lambda *a, real=X.settled: seen.append(real(*a)) or seen[0])
    monkeypatch.setattr(X, "AUCTION_ROUNDS", 3)
    found = X.optimal(arcs, caps)
    r = X.certificate(arcs, caps, found).first()
    assert seen and found.rest.count() == 0
    assert (r["placed"], r["total"], r["negative"], r["loose"], r["over"]) == (60, r["dual"], 0, 0, 0)


def test_problems_settled_at_once_have_their_own_optimum_and_rest(spark):
    rng = random.Random(8)
    cap = [2, 1, 3, 2]
    rows = [(m, a, b, rng.randrange(top)) for m, top in enumerate((3, 6, 9)) for a in range(8) for b in range(4)]
    rows += [(3, a, b, c) for a, costs in enumerate([[5], [1], [2], [7, 7]]) for b, c in enumerate(costs)]  # three rows for two places
    arcs = spark.createDataFrame(rows, "m int, a long, b long, unit_cost long")
    caps = spark.createDataFrame(list(enumerate(cap)), "b long, capacity long")
    found = X.settled(cut(arcs), cut(caps), ["m"])
    assert {(r["m"], r["a"]) for r in found.rest.collect()} <= {(3, 0), (3, 1), (3, 2)} and found.rest.count() == 1
    costs = [[[r[3] for r in rows if r[:2] == (m, a)] for a in range(8)] for m in range(3)]
    picks = [p for p in itertools.product(range(4), repeat=8) if all(p.count(b) == cap[b] for b in range(4))]
    totals = {r["m"]: r["total"] for r in X.certificate(arcs, caps, found, ["m"]).collect()}
    assert [totals[m] for m in range(3)] == [min(sum(costs[m][a][b] for a, b in enumerate(p)) for p in picks) for m in range(3)]
    for r in X.certificate(arcs, caps, found, ["m"]).collect():
        assert r["total"] == r["dual"] or r["m"] == 3
        assert (r["loose"], r["over"]) == (0, 0)


def test_registration_leaves_a_long_auction(spark, monkeypatch):
    arcs, caps = _war(spark)
    monkeypatch.setattr(X, "AUCTION_ROUNDS", 2)
    got, rest = G.solve(arcs.withColumnRenamed("unit_cost", "cost"), caps, 9)
    assert got.count() == 60 and rest.count() == 0


def test_prices_keep_every_unit_of_large_costs():
    big = 1 << 59
    reach = np.full((3, 3), X.FAR)
    reach[0, 1], reach[1, 2] = big + 1, big + 2
    rise = X._raised(reach, np.array([1, 0, 0]), np.array([0, 0, 1]))
    assert rise.tolist() == [2 * big + 3, big + 2, 0]
    assert X._raised(reach, np.array([0, 0, 1]), np.array([1, 0, 0])) is None
