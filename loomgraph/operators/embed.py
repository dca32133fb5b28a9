"""Geometry from the graph: rank basis, local transport, likelihood fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from loomgraph.core.session import cut
from loomgraph.core.skew import lookup
from loomgraph.operators import knn as N
from loomgraph.operators.graph import symmetrise
from loomgraph.operators.linear import columns, combine, gap_scale, gram, leading_vectors, orthonormalise, svd_left

# fixed values: limits of the simplex solver
RIDGE = 1e-2
SOLVER_STEPS = 100
SOLVER_TOL = 1e-6


def rank_columns(x: DataFrame, cols: Sequence[str], bins: int = 2_048) -> DataFrame:
    """Every column replaced by centred unit-length scores of its binned ranks.

    One aggregate finds the bin edges of all columns and one counts the bins;
    the tables of edges and mid-ranks have ``bins`` numbers per column.
    """
    from pyspark.ml.feature import Bucketizer

    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = x.agg(F.count(F.lit(1)), *[F.percentile_approx(c, cuts, F.lit(8 * bins)) for c in cols]).first()
    n = row[0]
    splits = [[float("-inf"), *sorted(set(float(e) for e in edges)), float("inf")] for edges in row[1:]]
    placed = Bucketizer(splitsArray=splits, inputCols=list(cols), outputCols=[f"b_{c}" for c in cols]).transform(x)
    stack = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"b_{c}").cast("int").alias("b")) for i, c in enumerate(cols)])
    counts = placed.select(F.inline(stack)).groupBy("c", "b").agg(F.count(F.lit(1)).alias("n")).toPandas()
    scale = np.sqrt(12.0 / (n * (float(n) * n - 1))) if n > 1 else 0.0
    out = []
    for i, c in enumerate(cols):
        per = np.zeros(len(splits[i]))
        mine = counts[counts["c"] == i]
        per[mine["b"].to_numpy()] = mine["n"].to_numpy()
        mid = np.cumsum(per) - per + 0.5 * (per + 1)
        table = F.lit([float(v) for v in scale * (mid - (n + 1) / 2)])
        out.append(F.get(table, F.col(f"b_{c}").cast("int")).alias(c))
    return placed.select("node_id", *out)


def rank_rotation_basis(x: DataFrame, cols: Sequence[str], k: int, rotations: int = 8, seed: int = 0, bins: int = 2_048, tol: float = 1e-2, patience: int = 2) -> DataFrame:
    """Basis shared by the rank scores of many random rotations of the columns.

    Each rotation adds its scores to the running basis; the leading left
    singular vectors of both together are kept.  The loop ends when the basis
    hardly turns for ``patience`` rotations.
    """
    rng = np.random.default_rng(seed)
    x = cut(x)
    basis, names, weights, calm = None, [], np.zeros(0), 0
    for _ in range(rotations):
        q, r = np.linalg.qr(rng.normal(size=(len(cols), len(cols))))
        q = q * np.sign(np.diag(r))
        scores = rank_columns(combine(x, cols, q, columns(len(cols), "r")), columns(len(cols), "r"), bins)
        if basis is None:
            both, all_cols = scores, columns(len(cols), "r")
        else:
            old = basis.select("node_id", *[(F.col(c) * float(w)).alias(f"p_{c}") for c, w in zip(names, weights)])
            both, all_cols = old.join(scores, "node_id"), [f"p_{c}" for c in names] + columns(len(cols), "r")
        both = cut(both)
        fresh, sing = svd_left(both, all_cols, k)
        fresh = cut(fresh)
        new_names = columns(len(sing), "u")
        if basis is not None:
            pairs = basis.select("node_id", *[F.col(c).alias(f"q_{c}") for c in names]).join(fresh, "node_id")
            m = pairs.agg(*[F.sum(F.col(f"q_{a}") * F.col(b)) for a in names for b in new_names]).first()
            overlap = np.linalg.svd(np.array(m).reshape(len(names), len(new_names)), compute_uv=False)
            calm = calm + 1 if 1 - overlap.min() < tol else 0
        basis, names, weights = fresh, new_names, sing
        if calm >= patience:
            break
    return basis.select("node_id", *[F.col(c).alias(f"v{i}") for i, c in enumerate(names)])


def interleave(raw: DataFrame, ranked: DataFrame, k: int, block: int) -> tuple[DataFrame, list[str]]:
    """Blocks of raw and rank columns in turn, made orthonormal in that order."""
    a = raw.select("node_id", *[F.col(f"v{i}").alias(f"a{i}") for i in range(k)])
    b = ranked.select("node_id", *[F.col(f"v{i}").alias(f"b{i}") for i in range(k)])
    order = [f"{s}{i}" for lo in range(0, k, block) for s in "ab" for i in range(lo, min(lo + block, k))]
    return orthonormalise(cut(a.join(b, "node_id")), order)


def project_to_simplex(v: np.ndarray) -> np.ndarray:
    """Nearest points with non-negative entries that sum to one, row by row."""
    u = -np.sort(-v, axis=1)
    over = np.cumsum(u, axis=1) - 1.0
    place = np.arange(1, v.shape[1] + 1)
    last = (u - over / place > 0).sum(axis=1)
    shift = over[np.arange(len(v)), last - 1] / last
    return np.maximum(v - shift[:, None], 0.0)


def simplex_weights(offsets: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Convex weights a minimising |a O - t|^2 + ridge |a|^2 for a batch (B, k, d)."""
    g = offsets @ offsets.transpose(0, 2, 1)
    size = np.maximum(np.trace(g, axis1=1, axis2=2) / g.shape[1], 1e-12)
    g = g + (RIDGE * size)[:, None, None] * np.eye(g.shape[1])
    q = np.einsum("bkd,bd->bk", offsets, target)
    step = 1.0 / np.maximum(np.abs(g).sum(axis=2).max(axis=1), 1e-12)
    x = np.full(q.shape, 1.0 / q.shape[1])
    y, t = x.copy(), 1.0
    for _ in range(SOLVER_STEPS):
        new = project_to_simplex(y - step[:, None] * (np.einsum("bij,bj->bi", g, y) - q))
        move = np.abs(new - x).max()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_next * (new - x)
        x, t = new, t_next
        if move < SOLVER_TOL:
            break
    return x


@pandas_udf(ArrayType(DoubleType()))
def _solve(target: pd.Series, offsets: pd.Series) -> pd.Series:
    out: list = [None] * len(target)
    sizes = np.array([len(o) for o in offsets])
    for k in np.unique(sizes):
        rows = np.flatnonzero(sizes == k)
        o = np.stack([np.stack(offsets.iloc[r]) for r in rows])
        w = simplex_weights(o, np.stack([np.asarray(target.iloc[r]) for r in rows]))
        for r, v in zip(rows, w):
            out[r] = v
    return pd.Series(out)


def local_transport(edges: DataFrame, neighbours: DataFrame, x: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each edge i-j spread over the neighbours of i as a convex combination.

    Edge rows are solved in Arrow batches on their own: a node with very many
    edges is just many rows.  The result is (P + P') / 2.
    """
    vec = cut(x.select("node_id", F.array(*cols).alias("z")))
    near = lookup(neighbours.select("node_id", "nbr", "rank"), vec.select(F.col("node_id").alias("nbr"), F.col("z").alias("zn")), "nbr")
    lists = near.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("rank", "nbr", "zn"))).alias("near"))
    lists = cut(lists.join(vec, "node_id").select(F.col("node_id").alias("i"), "z", F.transform("near", lambda s: s["nbr"]).alias("ids"), F.transform("near", lambda s: F.zip_with(s["zn"], "z", lambda p, q: p - q)).alias("offs")))
    e = lookup(edges.where("i <> j"), lists, "i")
    e = lookup(e, vec.select(F.col("node_id").alias("j"), F.col("z").alias("zj")), "j")
    solved = e.withColumn("target", F.zip_with("zj", "z", lambda p, q: p - q)).select("i", "w", "ids", _solve("target", "offs").alias("alpha"))
    parts = solved.select("i", F.explode(F.arrays_zip("ids", "alpha")).alias("p"), "w").select("i", F.col("p.ids").alias("j"), (F.col("w") * F.col("p.alpha")).alias("w"))
    p = parts.where("w > 0").groupBy("i", "j").agg(F.sum("w").alias("w"))
    return symmetrise(p, "mean")


class Likelihood:
    """Minus the log-likelihood of coefficients X (k x d) for coordinates E X.

    The edge term is a k x k matrix found once.  The partition term is a sum
    over weighted sample pairs, kept as rows of basis differences; an evaluation
    is one pass over them and returns k x d numbers per partition.
    """

    def __init__(self, edges: DataFrame, basis: DataFrame, cols: Sequence[str], pairs: DataFrame):
        self.cols = list(cols)
        k = len(self.cols)
        deg = edges.groupBy(F.col("i").alias("node_id")).agg(F.sum("w").alias("d"))
        self.diag = gram(basis.join(deg, "node_id"), self.cols, "d")
        a = basis.select(F.col("node_id").alias("i"), *[F.col(c).alias(f"a_{c}") for c in self.cols])
        b = basis.select(F.col("node_id").alias("j"), *[F.col(c).alias(f"b_{c}") for c in self.cols])
        e = lookup(lookup(edges, a, "i"), b, "j")
        row = e.agg(*[F.sum(F.col("w") * F.col(f"a_{p}") * F.col(f"b_{q}")) for p in self.cols for q in self.cols]).first()
        inner = np.array([v or 0.0 for v in row]).reshape(k, k)
        self.inner = (inner + inner.T) / 2
        self.links = 0.5 * float(edges.agg(F.sum("w")).first()[0] or 0.0)
        p = lookup(lookup(pairs.select("i", "j", "weight"), a, "i"), b, "j")
        self.pairs = cut(p.select("weight", F.array(*[F.col(f"a_{c}") - F.col(f"b_{c}") for c in self.cols]).alias("diff")))

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        k, d = len(self.cols), x.shape[1]
        held = self.pairs.sparkSession.sparkContext.broadcast(x)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, grad = 0.0, np.zeros((k, d))
            for pdf in batches:
                if len(pdf):
                    diff = np.stack(pdf["diff"].to_numpy())
                    y = diff @ held.value
                    w = pdf["weight"].to_numpy() * np.exp(-(y * y).sum(axis=1))
                    total += float(w.sum())
                    grad += diff.T @ (-2.0 * w[:, None] * y)
            yield pd.DataFrame({"total": [total], "grad": [grad.ravel()]})

        sums = self.pairs.mapInPandas(part, "total double, grad array<double>")
        row = sums.agg(F.sum("total"), *[F.sum(F.col("grad")[i]) for i in range(k * d)]).first()
        total = max(float(row[0] or 0.0), 1e-12)
        grad = np.array([v or 0.0 for v in row[1:]]).reshape(k, d)
        edge = self.inner - self.diag
        value = float(np.einsum("kd,kl,ld->", x, edge, x)) - self.links * np.log(total)
        slope = 2.0 * edge @ x - self.links / total * grad
        return -value, -slope


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 40, memory: int = 8, tol: float = 1e-5) -> tuple[np.ndarray, float, int]:
    """Limited-memory quasi-Newton descent on a small coefficient matrix."""
    value, grad = f(x)
    s_list: list[np.ndarray] = []
    y_list: list[np.ndarray] = []
    used = 0
    for _ in range(rounds):
        used += 1
        q = grad.ravel().copy()
        alphas = []
        for s, y in zip(reversed(s_list), reversed(y_list)):
            a = float(s @ q) / float(s @ y)
            alphas.append(a)
            q -= a * y
        if s_list:
            q *= float(s_list[-1] @ y_list[-1]) / float(y_list[-1] @ y_list[-1])
        else:
            q /= max(1.0, float(np.abs(q).max()))
        for (s, y), a in zip(zip(s_list, y_list), reversed(alphas)):
            q += s * (a - float(y @ q) / float(s @ y))
        step, moved = 1.0, False
        slope = -float(grad.ravel() @ q)
        for _ in range(12):
            trial = x - step * q.reshape(x.shape)
            v, g = f(trial)
            if np.isfinite(v) and v <= value + 1e-4 * step * slope:
                moved = True
                break
            step *= 0.4
        if not moved:
            break
        s, y = (trial - x).ravel(), (g - grad).ravel()
        if float(s @ y) > 1e-12:
            s_list, y_list = (s_list + [s])[-memory:], (y_list + [y])[-memory:]
        done = abs(value - v) <= tol * max(1.0, abs(v))
        x, value, grad = trial, v, g
        if done:
            break
    return x, value, used


def embed(edges: DataFrame, dim: int = 2, k: int = 6, final_k: int | None = None, neighbours: int | None = None, block_rounds: int = 6, rotations: int = 4, descents: int = 12, seed: int = 0, bins: int = 512) -> DataFrame:
    """Coordinates (node_id, x0, ...) of a symmetric weighted graph.

    Spectral basis, rank rotations, nearest neighbours, local transport graph,
    spectral basis of transport x graph x transport', and a likelihood fit over
    a growing number of columns.
    """
    first, values = leading_vectors([edges], k, block_rounds, seed=seed)
    first = cut(gap_scale(first, values))
    names = columns(len(values))
    ranked = rank_rotation_basis(first, names, len(values), rotations, seed, bins)
    rank_names = [c for c in ranked.columns if c != "node_id"]
    want = neighbours or max(2 * k, 10 * dim)
    near = cut(N.knn(ranked, want, rank_names))
    t = cut(local_transport(edges, near, ranked, rank_names))
    flipped = t.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")
    final, values = leading_vectors([t, edges, flipped], final_k or k, block_rounds, seed=seed + 1, shift=False)
    final = cut(final)
    names = columns(len(values))
    m = 2 * (dim + 1)
    sample = N.stratified_pairs(combine(final, names[:dim], np.eye(dim), columns(dim, "x")), columns(dim, "x"), m, seed)
    n_draws = (2**dim) * m
    pairs = sample.select("i", "j", F.when(F.col("stratum") == "near", 1.0).otherwise((n_draws - m) / float(m)).alias("weight"))
    pairs = pairs.unionByName(near.select(F.col("node_id").alias("i"), F.col("nbr").alias("j"), F.lit(1.0).alias("weight")))
    score = Likelihood(edges, final, names, cut(pairs))
    spread = np.sqrt(np.diag(gram(final, names)) / max(1, final.count()))
    x = np.zeros((len(names), dim))
    for c in range(dim):
        x[c, c] = 1.0 / max(float(spread[c]), 1e-12)
    size = dim
    while True:
        def part(head: np.ndarray, size: int = size) -> tuple[float, np.ndarray]:
            full = np.zeros_like(x)
            full[:size] = head
            v, g = score(full)
            return v, g[:size]

        x[:size], _, _ = minimise(part, x[:size].copy(), descents)
        if size >= len(names):
            break
        size = min(len(names), 2 * size)
    return combine(final, names, x, columns(dim, "x"))
