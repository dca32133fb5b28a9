"""Pole pairs over whole tables, and pair sums against plain products."""

import itertools
import random

from pyspark.sql import functions as F

from loomgraph.operators import poles as P
from loomgraph.operators import registration as R
from loomgraph.plans import catalog
from loomgraph.plans import queries_registration as Q


def _tables(spark, folder):
    """60 points on a line, 12 hubs without a point; every hub detects its genes once, so no count reaches 6."""
    points = [(h, [h / 60, (h % 7) / 70], 0) for h in range(60)]
    where = {0: range(0, 12), 1: range(2, 14), 2: range(48, 60), 3: range(46, 58), 4: range(20, 30), 5: range(30, 40), 6: [*range(40, 45), *range(60, 72)], 7: range(25, 29)}
    lines = [(h, g, 1) for g, hubs in where.items() for h in hubs]
    spark.createDataFrame(points, "vec_id long, embedding array<double>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(h, h) for h in range(72)], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{folder}/lineitem.parquet")
    return where


def test_pole_pairs_take_every_detection(spark, tmp_path, monkeypatch):
    where = _tables(spark, str(tmp_path))
    monkeypatch.setattr(Q, "_ranked", lambda p, f: f)
    monkeypatch.setattr(P, "pole_pairs", lambda stats, fields, *rest: fields.select("gene", F.lit("p").alias("pair"), "node_id", "f", "abundance"))
    monkeypatch.setattr(P, "check_disjoint", lambda pairs: None)
    rows = catalog.queries()["pole_pairs"](spark, str(tmp_path)).collect()
    # genes of ten hubs and more, be they on points or not, each with its field around the points that detect it
    assert {r["gene"]: r["abundance"] for r in rows} == {f"g{g}": len(hubs) for g, hubs in where.items() if len(hubs) >= 10}
    for r in rows:
        assert 0 < r["f"] <= 1 and r["node_id"] < 60
    own = {(r["gene"], r["node_id"]) for r in rows}
    assert all((f"g{g}", h) in own for g, hubs in where.items() if len(hubs) >= 10 for h in hubs if h < 60)


def test_pair_sums_equal_plain_products(spark, monkeypatch):
    rng = random.Random(3)
    f = {(f"g{g}", n): rng.random() for g in range(9) for n in range(50) if rng.random() < 0.6}
    fields = spark.createDataFrame([(g, n, v) for (g, n), v in f.items()], "gene string, node_id long, f double")
    moments = R.field_moments(spark.range(50).select(F.col("id").alias("node_id")), fields)
    every = list(itertools.combinations(sorted({g for g, _ in f}), 2))
    for pairs, listed in ((every, 1 << 18), (every[:3], 2)):
        table = spark.createDataFrame(pairs, "a string, b string")
        monkeypatch.setattr(P, "LISTED", listed)
        got = {(r["a"], r["b"]): r["corr"] for r in P.pair_correlations(table, fields, moments).collect()}
        assert set(got) == set(pairs)
        for a, b in pairs:
            x, y = [f.get((a, n), 0.0) for n in range(50)], [f.get((b, n), 0.0) for n in range(50)]
            mx, my = sum(x) / 50, sum(y) / 50
            cov = sum(p * q for p, q in zip(x, y)) / 50 - mx * my
            sd = (sum((p - mx) ** 2 for p in x) / 50 * sum((q - my) ** 2 for q in y) / 50) ** 0.5
            assert abs(got[a, b] - cov / sd) < 1e-9
