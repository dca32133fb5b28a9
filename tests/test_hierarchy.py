"""The density hierarchy against a recursive merge tree."""

import numpy as np
import pytest

from loomgraph.operators import hierarchy as H


def brute(edges, nodes, min_size, roots):
    """Labels from an explicit tree: merges in order, recursion over large parts."""
    group = {v: ("leaf", v) for v in nodes}
    members = {v: [v] for v in nodes}
    rep = {v: v for v in nodes}
    for i, j, d in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        a, b = rep[i], rep[j]
        node = ("merge", 1.0 / max(d, 1e-12), group.pop(a), group.pop(b))
        members[a] += members.pop(b)
        for v in members[a]:
            rep[v] = a
        group[a] = node

    def leaves(t):
        return [t[1]] if t[0] == "leaf" else leaves(t[2]) + leaves(t[3])

    def grow(t, birth):
        """(stability, points, reach, [children]) of the cluster whose head is t"""
        own, reach, left, kids = 0.0, 0.0, {}, []
        while True:
            _, lam, x, y = t
            nx, ny = len(leaves(x)), len(leaves(y))
            reach = max(reach, lam)
            if nx >= min_size and ny >= min_size:
                own += (nx + ny) * (lam - birth)
                kids = [grow(x, lam), grow(y, lam)]
                return own, left, reach, kids
            for part, n in ((x, nx), (y, ny)):
                if n < min_size:
                    own += n * (lam - birth)
                    left.update(dict.fromkeys(leaves(part), lam))
            if max(nx, ny) < min_size:
                return own, left, reach, kids
            t = x if nx >= min_size else y

    def everything(c):
        out = dict(c[1])
        for k in c[3]:
            out.update(everything(k))
        return out

    def choose(c, may):
        below = [choose(k, True) for k in c[3]]
        rest = sum(b[0] for b in below)
        if may and c[0] >= rest:
            return c[0], [c]
        return rest, [w for b in below for w in b[1]]

    tops = [grow(t, 0.0) for g, t in group.items() if t[0] == "merge" and len(members[g]) >= min_size]
    label = dict.fromkeys(nodes, -1)
    for c in tops:
        for w in choose(c, roots == "always" or len(tops) > 1)[1]:
            points = everything(w)
            if roots == "always" and w is c:
                points = {v: lam for v, lam in points.items() if lam >= w[2]}
            label.update(dict.fromkeys(points, min(points, default=-1)))
    return label


def random_forest(seed, n, pieces):
    rng = np.random.default_rng(seed)
    edges = []
    for v in range(pieces, n):
        edges.append((v - pieces * int(rng.integers(1, v // pieces + 1)), v, float(rng.integers(0, 40) / 8) if seed % 2 else float(rng.exponential())))
    return [(min(i, j), max(i, j), d) for i, j, d in edges]


@pytest.mark.parametrize("seed, n, pieces, min_size, roots, block", [(0, 120, 1, 4, "several", 1 << 18), (1, 90, 3, 3, "several", 48), (2, 80, 2, 5, "always", 24)])
def test_labels_equal_the_recursive_tree(spark, seed, n, pieces, min_size, roots, block):
    edges = random_forest(seed, n, pieces)
    nodes = [*range(n), 10**12]
    forest = spark.createDataFrame(edges, "i long, j long, d double")
    table = spark.createDataFrame([(v,) for v in nodes], "node_id long")
    got = {r.node_id: r.label for r in H.stable_labels(forest, table, min_size, roots, block).collect()}
    assert got == brute(edges, nodes, min_size, roots)


def test_ranges_give_the_same_merges(spark):
    edges = random_forest(4, 70, 2)
    forest = spark.createDataFrame(edges, "i long, j long, d double")

    def rows(block):
        return sorted((r.ref, r.d, *sorted([(r.a, r.n_a), (r.b, r.n_b)])) for r in H.merge_tree(forest, block).collect())

    whole = rows(1 << 18)
    assert whole == rows(20) and len(whole) == len(edges)


def test_empty_forest_is_noise(spark):
    forest = spark.createDataFrame([], "i long, j long, d double")
    table = spark.createDataFrame([(1,), (2,)], "node_id long")
    assert {(r.node_id, r.label) for r in H.stable_labels(forest, table, 2).collect()} == {(1, -1), (2, -1)}


def test_transport_clusters_by_component(spark):
    from loomgraph.operators import density as D

    rng = np.random.default_rng(11)
    weights = {}
    for base, n in ((0, 16), (100, 14), (200, 3)):
        for v in range(n):
            for u in range(v):
                if u == v - 1 or rng.random() < 0.4:
                    weights[base + u, base + v] = float(rng.uniform(0.05, 1.0))
    strength = {}
    for (i, j), w in weights.items():
        strength[i] = strength.get(i, 0) + w
        strength[j] = strength.get(j, 0) + w
    dist = {e: float(max(-np.log(w / np.sqrt(strength[e[0]] * strength[e[1]])), 1e-12)) for e, w in weights.items()}
    rows = {}
    for (i, j), d in dist.items():
        rows.setdefault(i, [1e-12]).append(d)
        rows.setdefault(j, [1e-12]).append(d)
    core = {}
    for base in (0, 100, 200):
        inside = {v: sorted(r) for v, r in rows.items() if base <= v < base + 100}
        place = max(2, min(4, len(inside), min(map(len, inside.values()))))
        core |= {v: r[place - 1] for v, r in inside.items()}
    expected = {(i, j): max(d, core[i], core[j]) for (i, j), d in dist.items()}

    directed = [(*(e if rng.random() < 0.5 else e[::-1]), w) for e, w in weights.items()] + [(0, 0, 5.0)]
    table = spark.createDataFrame(directed, "i long, j long, w double")
    both = spark.createDataFrame([(i, j, d) for (a, b), d in dist.items() for i, j in ((a, b), (b, a))], "i long, j long, d double")
    got = {(r.i, r.j): r.d for r in D.component_reachability(both, 3, 1e-12).collect()}
    assert got.keys() == expected.keys() and all(abs(got[e] - expected[e]) < 1e-9 for e in got)

    nodes = spark.createDataFrame([(v,) for v in [*rows, 999]], "node_id long")
    labels = {r.node_id: r.label for r in D.cluster_transport(table, nodes, 5, 3).collect()}
    assert labels.keys() == {*rows, 999} and labels[999] == -1 and {labels[v] for v in (200, 201, 202)} == {-1}
    left, right = ({labels[v] for v in rows if base <= v < base + 100} - {-1} for base in (0, 100))
    assert left and right and not left & right and sorted(left | right) == list(range(len(left | right)))
