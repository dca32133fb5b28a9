"""Exact assignment against enumeration and its own certificate."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import registration as R
from loomgraph.operators import transport as X


def _best(cost, cap):
    rows, cols = len(cost), len(cap)
    picks = (p for p in itertools.product(range(cols), repeat=rows) if all(p.count(b) <= cap[b] for b in range(cols)) and all(cost[a][b] is not None for a, b in enumerate(p)))
    return min(sum(cost[a][b] for a, b in enumerate(p)) for p in picks)


def _frames(spark, costs, cap):
    arcs = spark.createDataFrame([(m, a, b, c) for m, cost in enumerate(costs) for a, row in enumerate(cost) for b, c in enumerate(row) if c is not None], "m int, a long, b long, unit_cost long")
    return arcs, spark.createDataFrame(list(enumerate(cap)), "b long, capacity int")


def test_many_problems_reach_their_optimum_at_once(spark):
    rng = random.Random(5)
    cap = [2, 1, 3, 2]
    # wide and narrow costs, ties, spare places in the fourth column, arcs that are not there
    costs = [[[rng.randrange(top) if rng.random() < fill else None for _ in cap] for _ in range(6)] for top, fill in ((1000, 1.1), (3, 1.1), (50, 1.1), (9, 1.1))]
    costs.append([[a * b for b in range(4)] for a in range(6)])
    arcs, caps = _frames(spark, costs, cap)
    found = X.optimal(arcs, caps, ["m"])
    assert found.rest.count() == 0
    rows = {r["m"]: r for r in X.certificate(arcs, caps, found, ["m"]).collect()}
    for m, cost in enumerate(costs):
        r = rows[m]
        assert r["placed"] == 6 and r["total"] == r["dual"] == _best(cost, cap)
        assert (r["negative"], r["loose"], r["over"]) == (0, 0, 0)


def test_rows_without_a_place_are_left_over(spark):
    arcs, caps = _frames(spark, [[[5, None], [1, None], [2, 7]]], [1, 2])
    found = X.optimal(arcs.drop("m"), caps)
    assert found.rest.count() == 1 and found.assigned.count() == 2
    with pytest.raises(ValueError, match="without a place"):
        X.ensemble(arcs.drop("m"), caps, 1, 2)


def test_members_are_optimal_and_differ(spark):
    # four rows and two places each can swap freely: six assignments of the same total
    arcs, caps = _frames(spark, [[[1, 1]] * 4], [2, 2])
    ties = X.ensemble(arcs.drop("m"), caps, 50, 8, "lexicographic")
    assert {r["objective"] for r in ties.select("objective").collect()} == {4}
    picks = {}
    for r in ties.collect():
        picks.setdefault(r["member"], []).append((r["a"], r["b"]))
    assert 1 < len(picks) <= 6 and len({tuple(sorted(p)) for p in picks.values()}) == len(picks)
    assert X.ensemble(arcs.drop("m"), caps, 0, 4, "base").select("member").distinct().count() == 1
    assert X.ensemble(arcs.drop("m"), caps, 50, 8, "lexicographic", keep=1).select("member").distinct().count() == 1
    noise = X.member_costs(arcs.drop("m").withColumn("unit_cost", F.col("unit_cost") + 100), 16, "perturb", 3)
    seen = {r["unit_cost"] for r in noise.collect()}
    assert seen <= set(range(98, 105)) and min(seen) < 101 < max(seen)


def test_the_band_is_absolute_plus_relative(spark):
    arcs, caps = _frames(spark, [[[10, 11], [10, 11]]], [1, 1])
    wide = X.ensemble(arcs.drop("m").withColumn("unit_cost", F.col("unit_cost") + F.when(F.col("a") == F.col("b"), 2).otherwise(0)), caps, 6, 12, "perturb", relative=1.0)
    tight = X.ensemble(arcs.drop("m").withColumn("unit_cost", F.col("unit_cost") + F.when(F.col("a") == F.col("b"), 2).otherwise(0)), caps, 6, 12, "perturb")
    assert wide.select("member").distinct().count() == 2 and tight.select("member").distinct().count() == 1
    assert {r["objective"] for r in tight.collect()} == {21}


@pytest.mark.parametrize("block", [1, 3, 64])
def test_farthest_points_are_the_greedy_order(spark, block):
    rng = random.Random(2)
    pts = [(i, float(rng.randrange(12)), float(rng.randrange(12))) for i in range(60)]
    df = spark.createDataFrame(pts, "node_id long, x double, y double")
    cx, cy = sum(p[1] for p in pts) / 60, sum(p[2] for p in pts) / 60
    want = [min(pts, key=lambda p: ((p[1] - cx) ** 2 + (p[2] - cy) ** 2, p[0]))]
    while len(want) < 20:
        rest = [p for p in pts if p not in want]
        want.append(max(rest, key=lambda p: (min((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 for q in want), -p[0])))
    got = R.farthest_points(df, ["x", "y"], 20, block)
    assert {r[0] for r in got.collect()} == {p[0] for p in want}


def test_capacity_modes(spark):
    obs = spark.createDataFrame([(i, float(i)) for i in range(5)], "node_id long, x double")

    def caps(mode, target):
        return [r["capacity"] for r in R.capacities(obs, obs.selectExpr("node_id", "x as mass"), target, mode, ["x"]).orderBy("node_id").collect()]

    assert caps("unit_upper", 4) == [1] * 5
    with pytest.raises(ValueError, match="cannot take 6"):
        caps("unit_upper", 6)
    assert caps("spatial_fps_exact", 3) == [1, 0, 1, 0, 1]
    assert sum(caps("spatial_fps_exact", 5)) == 5 and sum(caps("spatial_fps_exact", 8)) == 8 and min(caps("spatial_fps_exact", 8)) == 1
    assert sum(caps("uniform_exact", 7)) == 7 and caps("mass_exact", 10) == [0, 1, 2, 3, 4]
