"""Operators against plain restatements on small inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.core import skew
from loomgraph.core.order import average_ranks, dense_index, group_index, running_sum
from loomgraph.operators import annotate as A
from loomgraph.operators import components as C
from loomgraph.operators import cuts
from loomgraph.operators import embed as E
from loomgraph.operators import linear as L
from loomgraph.operators import pairing as P
from loomgraph.operators import registration as R
from loomgraph.operators import stats as S
from loomgraph.operators import transport as X
from loomgraph.operators.knn import knn


def test_order(spark):
    rng = random.Random(0)
    rows = [(i, rng.randrange(5), rng.randrange(20)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g int, v int").repartition(7)
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert {r.id: r.ix for r in dense_index(df, ["v", "id"], "ix").collect()} == want
    acc, total = {}, 0
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        acc[r[0]] = total
        total += r[2]
    assert {r.id: r.s for r in running_sum(df, ["v", "id"], "v", "s").collect()} == acc
    got = group_index(df, ["g"], [F.col("g"), F.col("v"), F.col("id")], "k")
    per = {g: sorted((r[2], r[0]) for r in rows if r[1] == g) for g in range(5)}
    assert all(per[r.g].index((r.v, r.id)) == r.k for r in got.collect())
    ranks = {r.id: r.rank for r in average_ranks(df, ["g"], "v", "rank").collect()}
    for i, g, v in rows:
        same = [x[2] for x in rows if x[1] == g]
        assert ranks[i] == sum(x < v for x in same) + (sum(x == v for x in same) + 1) / 2


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_skew_lookup_is_the_plain_join(spark, how):
    rows = spark.createDataFrame([(1, i) for i in range(300)] + [(k % 9, k) for k in range(90)] + [(None, 1)], "k int, v int")
    table = spark.createDataFrame([(k, f"t{k}") for k in (0, 1, 2, 5)], "k int, t string")
    hot = skew.hot_keys(rows, "k", rows=50)
    assert hot == [1]
    a = skew.lookup(rows, table, "k", how, hot).collect()
    b = rows.join(table, "k", how).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_knn_many_leaves_with_piles(spark):
    rng = np.random.default_rng(5)
    pts = np.round(rng.normal(size=(900, 2)), 3)
    pts[300:600] = [0.125, -0.5]  # a third of all points at one place
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "node_id long, x double, y double")
    got = {}
    for r in knn(df, 5, ["x", "y"], leaf_rows=32).collect():
        got.setdefault(r.node_id, []).append((r["rank"], r.nbr))
    for i in range(0, 900, 7):
        d = (pts[:, 0] - pts[i, 0]) ** 2 + (pts[:, 1] - pts[i, 1]) ** 2
        want = sorted((d[j], j) for j in range(900) if j != i)[:5]
        assert [n for _, n in sorted(got[i])] == [j for _, j in want]
    some = knn(df, 3, ["x", "y"], targets=df.where("node_id % 10 = 0"), leaf_rows=16)
    assert some.count() == 2700 and some.where("nbr % 10 <> 0").count() == 0


def test_components_and_core(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(500, k) for k in range(600, 640)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node_id: r.comp for r in C.components(df).collect()} == {n: find(n) for n in list(parent)}
    tri = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")
    assert sorted(r.node_id for r in C.kcore(tri, 2.0)[0].collect()) == [1, 2, 3]
    ring = spark.createDataFrame([(a, b, 1.0) for c in (0, 10) for a, b in itertools.permutations(range(c, c + 6), 2)] + [(5, 10, 0.1), (10, 5, 0.1)], "i long, j long, w double")
    blocks = {r.node_id: r.block for r in cuts.sparsest_cut_blocks(ring, 3, 0.2).collect()}
    assert {n for n, b in blocks.items() if b == 0} == set(range(6)) and {n for n, b in blocks.items() if b == 10} == set(range(10, 16))


def test_near_duplicates_across_blocks(spark):
    rng = random.Random(8)
    rows = []
    for umi, spread in ((1, 30_000), (2, 900), (3, 60)):
        for k in range(160):
            rows.append((umi, "c", f"f{k}", 4_096 - 30 + rng.randrange(spread), rng.randrange(9), float(rng.randrange(5))))
    df = spark.createDataFrame(rows, "umi int, contig string, fqn string, start long, reads long, score double")
    want = set()
    for umi in (1, 2, 3):
        group, anchor = [], None
        for r in sorted((r for r in rows if r[0] == umi), key=lambda r: r[3]) + [None]:
            if r is None or (anchor is not None and r[3] - anchor > 10):
                best = min(group, key=lambda g: (-g[4], -g[5], g[3], g[2]))
                want.add((umi, anchor, best[2], len(group)))
                group, anchor = [], None
            if r is not None:
                anchor = r[3] if anchor is None else anchor
                group.append(r)
    assert {(r.umi, r.anchor, r.fqn, r.n_members) for r in A.near_duplicates(df).collect()} == want


def test_intervals_are_half_open(spark):
    feats = spark.createDataFrame([("c", 10, 20, "a"), ("c", 20, 30, "b"), ("c", 5, 90_000, "z"), ("d", 10, 20, "q")], "contig string, lo long, hi long, gene string")
    pos = spark.createDataFrame([("c", p) for p in (10, 19, 20, 29, 30, 5000)], "contig string, start long")
    hits = {(r.start, r.gene) for r in A.overlaps(pos, feats).collect()}
    assert hits == {(10, "a"), (19, "a"), (20, "b"), (29, "b")} | {(p, "z") for p in (10, 19, 20, 29, 30, 5000)}


def test_pairing_rules(spark):
    counts = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 1, 3), (2, 1, 1, 4), (2, 3, 1, 4), (3, 1, 2, 1)], "uei int, umi0 int, umi1 int, n_reads long")
    assert sorted(r.uei for r in P.consensus_pairs(counts).collect()) == [1, 3]
    assoc = spark.createDataFrame([(1, 1, 3, 9), (1, 2, 2, 9), (2, 2, 1, 9), (3, 9, 5, 1)], "umi0 int, umi1 int, n_uei long, n_reads long")
    kept, _ = P.filter_associations(assoc, 2, 1, 3)
    assert sorted((r.umi0, r.umi1) for r in kept.collect()) == [(1, 1)]


def test_auction_is_optimal(spark):
    rng = random.Random(4)
    cost = [[rng.randrange(12) for _ in range(4)] for _ in range(6)]
    cap = [2, 2, 1, 2]
    best = min(
        sum(cost[a][b] for a, b in enumerate(pick))
        for pick in itertools.product(range(4), repeat=6)
        if all(pick.count(b) <= cap[b] for b in range(4))
    )
    arcs = spark.createDataFrame([(a, b, cost[a][b]) for a in range(6) for b in range(4)], "a long, b long, unit_cost long")
    caps = spark.createDataFrame(list(enumerate(cap)), "b long, capacity int")
    got, rest, _ = X.auction(arcs, caps)
    assert got.count() == 6 and rest.count() == 0
    assert got.agg(F.sum("unit_cost")).first()[0] == best
    assert [X.grow_candidates(k, 10_000) for k in (10, 200, 300)] == [42, 256, 600] and X.grow_candidates(300, 500) == 500


def test_blocked_rows_are_reported(spark):
    arcs = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 1, 0)], "a long, b long, unit_cost long")
    caps = spark.createDataFrame([(0, 1), (1, 1)], "b long, capacity int")
    got, rest, _ = X.auction(arcs, caps)
    assert got.count() == 2 and rest.count() == 1


def test_simplex_solver():
    v = np.array([[0.2, 0.3, 0.9], [5.0, -1.0, 0.0]])
    p = E.project_to_simplex(v)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all() and np.allclose(p[1], [1, 0, 0])
    corners = np.array([[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]])
    w = E.simplex_weights(corners, np.array([[0.9, 0.05]]))
    assert np.allclose(w.sum(), 1) and w[0, 1] > 0.8


def test_spectrum(spark):
    n = 24
    rng = np.random.default_rng(0)
    m = np.zeros((n, n))
    for i in range(n):
        for d, w in ((1, 3.0), (2, 1.0)):
            m[i, (i + d) % n] = m[(i + d) % n, i] = w + 0.2 * rng.random()
    edges = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j] > 0], "i long, j long, w double")
    _, values = L.leading_vectors([edges], 2, rounds=6)
    exact = np.sort(np.linalg.eigvals(m / m.sum(axis=1)[:, None]).real)[::-1][1:3]
    assert np.allclose(values, exact, atol=1e-4)


def test_likelihood_gradient(spark):
    rng = np.random.default_rng(1)
    n = 20
    pts = spark.createDataFrame([(i, *map(float, rng.normal(size=3))) for i in range(n)], "node_id long, v0 double, v1 double, v2 double")
    e = [(i, (i + 1) % n, 1.0) for i in range(n)]
    edges = spark.createDataFrame(e + [(b, a, w) for a, b, w in e], "i long, j long, w double")
    pairs = spark.createDataFrame([(i, (i * 7 + 3) % n, 1.5) for i in range(n) if i != (i * 7 + 3) % n], "i long, j long, weight double")
    f = E.Likelihood(edges, pts, ["v0", "v1", "v2"], pairs)
    x = rng.normal(size=(3, 2)) * 0.3
    value, grad = f(x)
    d = np.zeros_like(x)
    d[1, 0] = 1e-5
    assert np.isclose((f(x + d)[0] - f(x - d)[0]) / 2e-5, grad[1, 0], rtol=1e-4)
    _, low, _ = E.minimise(f, x, 5)
    assert low <= value


def test_procrustes(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 2))
    turn = np.array([[0.0, 1.0], [1.0, 0.0]])
    b = (a - [1, 2]) @ turn * 0.5
    df = spark.createDataFrame([tuple(map(float, (*p, *q))) for p, q in zip(a, b)], "a0 double, a1 double, b0 double, b1 double")
    fit = S.procrustes(df, ["a0", "a1"], ["b0", "b1"])
    assert fit["rmse"] < 1e-6 and abs(fit["scale"] - 2) < 1e-9


def test_shuffles_keep_the_labels(spark):
    slots = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "slot int, label string")
    p = S.shuffle_labels(slots, "slot", "label", 3).groupBy("perm", "label").count().collect()
    assert len(p) == 6 and all(r["count"] == 20 for r in p)


def test_farthest_points(spark):
    rng = np.random.default_rng(3)
    pts = rng.random((40, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "node_id long, x double, y double")
    chosen = [int(np.argmin(((pts - pts.mean(axis=0)) ** 2).sum(axis=1)))]
    low = np.full(40, np.inf)
    for _ in range(5):
        low = np.minimum(low, ((pts - pts[chosen[-1]]) ** 2).sum(axis=1))
        low[chosen] = -np.inf
        chosen.append(int(np.argmax(low)))
    assert {r.node_id for r in R.farthest_points(df, ["x", "y"], 6).collect()} == set(chosen)


@pytest.mark.parametrize("objective", ["map", "modularity"])
def test_communities_of_joined_cliques(spark, objective):
    from loomgraph.operators.communities import communities

    rows = [(a, b, 1.0) for c in (0, 10, 20) for a, b in itertools.permutations(range(c, c + 6), 2)]
    for a, b in ((5, 10), (15, 20), (25, 0)):
        rows += [(a, b, 1.0), (b, a, 1.0)]
    edges = spark.createDataFrame(rows, "i long, j long, w double")
    found = {}
    for r in communities(edges, objective, markov_time=1.0).collect():
        found.setdefault(r.label, set()).add(r.node_id)
    assert sorted(map(sorted, found.values())) == [list(range(c, c + 6)) for c in (0, 10, 20)]


def test_density_clusters_of_two_blobs(spark):
    from loomgraph.operators import density as D

    rng = np.random.default_rng(7)
    pts = np.vstack([rng.normal(size=(40, 2)) * 0.1, rng.normal(size=(40, 2)) * 0.1 + 3, [[1.5, 1.5], [-4.0, 5.0]]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "node_id long, x double, y double")
    reach = D.mutual_reachability(df, ["x", "y"], 45)
    forest = D.spanning_forest(reach)
    rows = forest.collect()
    assert len(rows) == 81
    # total weight against Kruskal
    parent = list(range(82))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    total = 0.0
    for r in sorted(reach.collect(), key=lambda r: (r.d, r.i, r.j)):
        a, b = find(r.i), find(r.j)
        if a != b:
            parent[a] = b
            total += r.d
    assert abs(total - sum(r.d for r in rows)) < 1e-9
    tight = D.spanning_forest(D.mutual_reachability(df, ["x", "y"], 6))
    labels = {r.node_id: r.label for r in D.density_clusters(tight, df.select("node_id"), 20).collect()}
    groups = [{labels[i] for i in range(0, 40)} - {-1}, {labels[i] for i in range(40, 80)} - {-1}]
    assert all(len(g) == 1 for g in groups) and groups[0] != groups[1]
