"""Nothing is cut off in silence: numerals, loops, draws and null models at their limits."""

import math

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import seq as S
from loomgraph.operators import barcodes, components, reads, registration, stats, transport


def test_numerals_that_do_not_fit_are_errors(spark):
    ids = spark.createDataFrame([(0,), (255,), (None,)], "n long")
    assert [r[0] for r in ids.select(S.base4_encode("n", 4)).collect()] == ["AAAA", "TTTT", None]
    for bad in (256, 1500, -1):
        with pytest.raises(Exception, match="no base-4 numeral"):
            spark.createDataFrame([(bad,)], "n long").select(S.base4_encode("n", 4)).collect()


def test_critical_count_matches_the_product_and_raises_beyond_its_limit():
    def plain(p):
        left, n = 1.0, 0
        while left > 0.5:
            n += 1
            left *= 1 - n * p
        return n - 1

    for p in (0.3, 0.01, 1e-5, 3e-9):
        assert barcodes.critical_count(p) == plain(p)
        assert barcodes.critical_count(p, step=7 if p > 1e-6 else 1000) == plain(p)
    with pytest.raises(ValueError):
        barcodes.critical_count(1e-9, most=1000)


def test_loops_that_run_out_of_rounds_raise(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], "src long, dst long, w double")
    with pytest.raises(RuntimeError):
        components.components(chain, max_rounds=1)
    with pytest.raises(RuntimeError):
        components.kcore(chain, 2, max_rounds=3)
    arcs = spark.createDataFrame([(a, b, abs(a - b)) for a in range(4) for b in range(4)], "a long, b long, unit_cost long")
    caps = spark.createDataFrame([(b, 1) for b in range(4)], "b long, capacity int")
    with pytest.raises(RuntimeError):
        transport.auction(arcs, caps, max_rounds=1)


def test_rows_without_events_draw_none(spark):
    counts = spark.createDataFrame([(1, "a", 0), (1, "b", 3), (1, "c", 2)], "row long, feature string, n long")
    got = {r["feature"]: r["n"] for r in reads.rarefy(counts, "row", "feature", "n", 5).collect()}
    assert got == {"b": 3, "c": 2}


def test_permutations_without_a_pair_count_as_zero(spark):
    null = spark.createDataFrame([("x", 1, 4), ("x", 2, 2), ("y", 3, 1)], "pair string, perm int, value long")
    seen = spark.createDataFrame([("x", 3), ("z", 2)], "pair string, value long")
    t = {r["pair"]: r for r in stats.empirical_tails(*stats.whole_null(null, seen, "pair", 4), "pair").collect()}
    assert t["x"]["p_enrich"] == pytest.approx((1 + 1) / 5) and t["x"]["null_mean" if "null_mean" in t["x"] else "null_median"] == pytest.approx(1.0)
    assert t["y"]["observed"] == 0 and t["y"]["p_enrich"] == 1.0
    assert t["z"]["observed"] == 2 and t["z"]["p_enrich"] == pytest.approx(1 / 5)


def test_integer_costs_shift_scale_and_break_ties(spark):
    arcs = spark.createDataFrame([(0, 0, -1.0, 9), (0, 1, 0.5, 4), (1, 0, 1e-6 / 2 - 1, 7)], "a long, b long, cost double, s long")
    q = registration.quantise(arcs, 2).orderBy("a", "b")
    assert [r["unit_cost"] for r in q.collect()] == [0, 1_500_000, 0]  # halves go to even
    assert [r["unit_cost"] for r in registration.lexicographic(q, "s", 2).orderBy("a", "b").collect()] == [5, 1_500_000 * 11, 3]
    small = registration.lexicographic(q, "s", 2, top=2 * (1_500_000 * 5 + 2) + 1).orderBy("a", "b")
    assert [r["unit_cost"] for r in small.collect()] == [5 % 3, 1_500_000 * 5, 3 % 3]
    none = registration.quantise(arcs.withColumn("cost", F.lit(0.0)), 2)
    assert none.agg(F.max("unit_cost")).first()[0] == 0


def test_weights_and_floors_without_positive_values(spark):
    def weight(rows):
        return registration.adaptive_weight(spark.createDataFrame(rows, "cost double, penalty double")).first()[0]

    assert weight([(2.0, 4.0), (0.0, 0.0)]) == 0.5
    assert weight([(0.0, 4.0)]) == 0.25
    assert weight([(2.0, 0.0)]) == 0.0
    m = spark.createDataFrame([(1, 1.0, 0.5, 3.0), (2, math.nan, 0.5, 3.0), (3, 0.0, 0.0, 0.0)], "node_id long, cov_x_x double, cov_x_y double, cov_y_y double")
    got = {r["node_id"]: (r["cov_x_x"], r["cov_x_y"], r["cov_y_y"]) for r in registration.covariance_floor(m, ("x", "y"), 0.1).collect()}
    assert got == {1: (1.2, 0.5, 3.2), 2: (0.2, 0.0, 0.2), 3: (0.2, 0.0, 0.2)}
