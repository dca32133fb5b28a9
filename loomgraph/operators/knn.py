"""Exact nearest neighbours as a partitioned two-round join.

Space is cut into leaves of similar size by a k-d split table learned from a
bounded sample.  Round one answers each query inside its own leaf, which gives
a radius; round two sends the query only to the leaves whose bounding box lies
within that radius.  A task compares blocks of one leaf and returns the best
``k`` per query, so candidate pairs never become rows.

Points at one place share a query, and only the first ``k + 1`` ids of a place
can ever be a neighbour; both make piles of identical points harmless.  Leaves
that attract many queries are split by query into chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from loomgraph.core.order import dense_index, lookup_groups
from loomgraph.core.session import cut
from loomgraph.core.skew import lookup

SAMPLE_ROWS = 50_000  # rows that shape the split table
MAX_LEAVES = 16_384  # bound of the split table and of the box table
MANY_DIMS = 16  # from here on blocks are compared by a matrix product first
CHUNK_QUERIES = 50_000  # queries of one leaf handled by one task


class Splits:
    """A k-d split table: arrays of axis, value and children, at most MAX_LEAVES."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis: list[int] = []
        self.value: list[float] = []
        self.child: list[tuple[int, int]] = []
        self.leaves = 0
        self._root = self._grow(sample, max(1, leaves))

    def _grow(self, pts: np.ndarray, leaves: int) -> int:
        spread = np.ptp(pts, axis=0) if len(pts) else np.zeros(1)
        if leaves <= 1 or len(pts) < 2 or not spread.max() > 0:
            self.leaves += 1
            return -self.leaves  # leaves are negative numbers
        axis = int(np.argmax(spread))
        value = float(np.median(pts[:, axis]))
        low = pts[:, axis] < value
        if not low.any():
            low = pts[:, axis] <= value
            value = float(np.nextafter(value, np.inf))
        here = len(self.axis)
        self.axis.append(axis)
        self.value.append(value)
        self.child.append((0, 0))
        half = leaves // 2
        self.child[here] = (self._grow(pts[low], half), self._grow(pts[~low], leaves - half))
        return here

    def tables(self) -> tuple:
        """Plain lists, which executors can read without this package."""
        return self._root, self.axis, self.value, self.child


def assign_leaves(tables: tuple, pts: np.ndarray) -> np.ndarray:
    root, axis, value, child = tables
    out = np.zeros(len(pts), dtype=np.int64)
    stack = [(root, np.arange(len(pts)))]
    while stack:
        node, rows = stack.pop()
        if node < 0:
            out[rows] = -node - 1
            continue
        low = pts[rows, axis[node]] < value[node]
        stack.append((child[node][0], rows[low]))
        stack.append((child[node][1], rows[~low]))
    return out


def _matrix(pdf: pd.DataFrame, cols: Sequence[str]) -> np.ndarray:
    return np.column_stack([pdf[c].to_numpy(dtype=np.float64) for c in cols]) if len(pdf) else np.zeros((0, len(cols)))


def _best_of_products(q: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``_best`` of one block: one matrix product bounds all distances, those within rounding of the k-th are then summed exactly."""
    qq, rr = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", r, r)
    near = qq[:, None] + rr[None, :]
    near -= 2.0 * (q @ r.T)
    slack = 4.0 * (q.shape[1] + 8) * np.finfo(float).eps * (qq + rr.max())
    edge = np.partition(near, k - 1, axis=1)[:, k - 1] + 2.0 * slack
    row, col = np.nonzero(near <= edge[:, None])
    exact = np.zeros(len(row))
    for d in range(q.shape[1]):
        diff = q[row, d] - r[col, d]
        exact += diff * diff
    order = np.lexsort((col, exact, row))  # ids are ascending in r
    start = np.searchsorted(row, np.arange(len(q)))
    pick = order[start[:, None] + np.arange(k)[None, :]]
    return exact[pick], ids[col[pick]]


def _best(q: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and ids of the k nearest rows of r for each row of q."""
    k = min(k, len(r))
    dist = np.empty((len(q), k))
    who = np.empty((len(q), k), dtype=np.int64)
    step = max(1, 4_000_000 // max(1, len(r)))
    if q.shape[1] >= MANY_DIMS and len(r) > 8 * k and np.isfinite(q).all() and np.isfinite(r).all():
        for lo in range(0, len(q), step):
            dist[lo : lo + step], who[lo : lo + step] = _best_of_products(q[lo : lo + step], r, ids, k)
        return dist, who
    for lo in range(0, len(q), step):
        block = np.zeros((len(q[lo : lo + step]), len(r)))
        for d in range(q.shape[1]):
            diff = q[lo : lo + step, d][:, None] - r[:, d][None, :]
            block += diff * diff
        # ids are ascending in r, so a stable sort breaks ties by id
        if len(r) > 8 * k:
            edge = np.partition(block, k - 1, axis=1)[:, k - 1]
            for i in range(len(block)):
                near = np.flatnonzero(block[i] <= edge[i])
                near = near[np.argsort(block[i][near], kind="stable")[:k]]
                dist[lo + i], who[lo + i] = block[i][near], ids[near]
        else:
            order = np.argsort(block, axis=1, kind="stable")[:, :k]
            dist[lo : lo + step] = np.take_along_axis(block, order, axis=1)
            who[lo : lo + step] = ids[order]
    return dist, who


def knn(
    points: DataFrame,
    k: int,
    coords: Sequence[str],
    targets: DataFrame | None = None,
    include_self: bool = False,
    leaf_rows: int = 2_048,
    probes: int | None = None,
) -> DataFrame:
    """(node_id, nbr, rank, dist): ``k`` nearest ``targets`` of every point.

    ``targets`` defaults to the points themselves, without the point itself
    unless ``include_self``.  Ties go to the smaller id.  With ``probes`` only
    that many nearest leaves are visited: an approximate answer for many
    dimensions, where boxes prune little.
    """
    coords = list(coords)
    same = targets is None
    refs_all = (points if same else targets).select("node_id", *coords)
    need = k + (1 if same and not include_self else 0)
    schema = "loc long, nbr long, d2 double"

    places = points.groupBy(*coords).agg(F.min("node_id").alias("loc"))
    w = Window.partitionBy(*coords).orderBy("node_id")
    refs = refs_all.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= need).drop("_r")

    n_refs = refs.count()
    if n_refs == 0:
        return points.select("node_id").limit(0).select("node_id", F.col("node_id").alias("nbr"), F.lit(0).alias("rank"), F.lit(0.0).alias("dist"))
    rows = refs.select(*coords).sample(min(1.0, 1.2 * SAMPLE_ROWS / n_refs), seed=11).limit(SAMPLE_ROWS).toPandas()
    rows = rows if len(rows) else refs.select(*coords).limit(SAMPLE_ROWS).toPandas()
    wanted = max(1, min(MAX_LEAVES, n_refs // max(leaf_rows, 4 * need)))
    splits = Splits(_matrix(rows, coords), wanted)
    sc = points.sparkSession.sparkContext
    table = sc.broadcast(splits.tables())

    @pandas_udf("long")
    def leaf_of(x: pd.DataFrame) -> pd.Series:
        return pd.Series(assign_leaves(table.value, _matrix(x, coords)))

    key = F.struct(*coords)
    refs = cut(refs.withColumn("leaf", leaf_of(key)))
    queries = cut(places.withColumn("leaf", leaf_of(key)))

    def first_round(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"loc": [], "nbr": [], "d2": []})
        r = r.sort_values("t_id")
        d, who = _best(_matrix(q, coords), _matrix(r, [f"t_{c}" for c in coords]), r["t_id"].to_numpy(), need)
        return pd.DataFrame({"loc": np.repeat(q["loc"].to_numpy(), d.shape[1]), "nbr": who.ravel(), "d2": d.ravel()})

    def chunked(q: DataFrame) -> DataFrame:
        """Join queries and references by leaf, splitting leaves with many queries."""
        load = q.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK_QUERIES).cast("int").alias("parts"))
        load = F.broadcast(load)  # at most MAX_LEAVES rows
        left = q.join(load, "leaf").withColumn("part", F.pmod(F.xxhash64("loc"), F.col("parts")).cast("int"))
        right = refs.join(load, "leaf").select(
            F.col("leaf").alias("t_leaf"),
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("t_part"),
            F.col("node_id").alias("t_id"),
            *[F.col(c).alias(f"t_{c}") for c in coords],
        )
        return left.groupBy("leaf", "part").cogroup(right.groupBy("t_leaf", "t_part")).applyInPandas(first_round, schema)

    found = chunked(queries)
    if splits.leaves > 1:
        found = cut(found)
        lows = [F.min(c).alias(f"lo_{c}") for c in coords]
        highs = [F.max(c).alias(f"hi_{c}") for c in coords]
        boxes = refs.groupBy("leaf").agg(*lows, *highs).toPandas()  # at most MAX_LEAVES rows
        box = sc.broadcast((boxes["leaf"].to_numpy(), _matrix(boxes, [f"lo_{c}" for c in coords]), _matrix(boxes, [f"hi_{c}" for c in coords])))
        radius = found.groupBy("loc").agg(F.when(F.count(F.lit(1)) >= need, F.max("d2")).alias("radius"))
        asked = queries.join(radius, "loc", "left")

        @pandas_udf("array<long>")
        def visits(x: pd.DataFrame, leaf: pd.Series, reach: pd.Series) -> pd.Series:
            ids, lo, hi = box.value
            pts = _matrix(x, coords)
            out = []
            for p, own, r in zip(pts, leaf.to_numpy(), reach.to_numpy(dtype=np.float64)):
                gap = np.maximum(np.maximum(lo - p, p - hi), 0.0)
                d2 = (gap * gap).sum(axis=1)
                hit = (ids != own) & ((d2 <= r * (1 + 1e-12)) | np.isnan(r))
                if probes is not None:
                    near = np.argsort(d2, kind="stable")[:probes]
                    mask = np.zeros(len(ids), dtype=bool)
                    mask[near] = True
                    hit &= mask
                out.append(ids[hit])
            return pd.Series(out)

        more = asked.select("loc", *coords, F.explode(visits(key, F.col("leaf"), F.col("radius"))).alias("leaf"))
        found = found.unionByName(chunked(more))
    wl = Window.partitionBy("loc").orderBy("d2", "nbr")
    best = found.withColumn("_p", F.row_number().over(wl)).where(F.col("_p") <= need)
    lists = best.groupBy("loc").agg(F.array_sort(F.collect_list(F.struct("d2", "nbr"))).alias("near"))
    near_of = queries.select(*coords, "loc").join(lists, "loc").drop("loc")
    members = lookup_groups(points.select("node_id", *coords), near_of, coords)
    near = F.col("near")
    if same and not include_self:
        near = F.filter("near", lambda s: s["nbr"] != F.col("node_id"))
    return members.select("node_id", F.posexplode(F.slice(near, 1, k)).alias("pos", "s")).select(
        "node_id", F.col("s.nbr").alias("nbr"), (F.col("pos") + 1).alias("rank"), F.sqrt("s.d2").alias("dist")
    )


def variable_k(neighbours: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first ``row_k`` neighbours of each row (wanted: node_id, row_k)."""
    return neighbours.join(wanted, "node_id").where("rank <= row_k").drop("row_k")


def smooth(neighbours: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Mean of a value over the neighbour list of each node."""
    v = values.select(F.col("node_id").alias("nbr"), column)
    return lookup(neighbours, v, "nbr").groupBy("node_id").agg(F.avg(column).alias(column))


def stratified_pairs(points: DataFrame, coords: Sequence[str], m: int, seed: int = 0) -> DataFrame:
    """Random partners per node: the ``m`` nearest and ``m`` evenly spread others.

    Each node draws 2^d * m numbers by hash; partners are looked up by a dense
    index, so every node is drawn equally often.
    """
    draws = (2 ** len(coords)) * m
    idx = cut(dense_index(points.select("node_id", *coords), ["node_id"], "ix"))
    n = idx.agg(F.count(F.lit(1)).alias("n"))
    r = F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")
    asked = idx.select(F.col("node_id").alias("i"), F.col("ix").alias("own"), *[F.col(c).alias(f"a_{c}") for c in coords], r).join(F.broadcast(n))
    asked = asked.withColumn("ix", F.pmod(F.xxhash64("i", "draw", F.lit(seed)), F.col("n")))
    asked = asked.where("ix <> own").dropDuplicates(["i", "ix"])
    other = idx.select("ix", F.col("node_id").alias("j"), *[F.col(c).alias(f"b_{c}") for c in coords])
    d2 = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in coords), F.lit(0.0))
    pairs = asked.join(other, "ix").select("i", "j", F.sqrt(d2).alias("dist"))
    w = Window.partitionBy("i").orderBy("dist", "j")
    placed = pairs.withColumn("p", F.row_number().over(w)).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("i")))
    stride = F.greatest(F.floor((F.col("c") - m) / m), F.lit(1))
    far = (F.col("p") > m) & (((F.col("p") - m - 1) % stride) == 0) & (F.floor((F.col("p") - m - 1) / stride) < m)
    return placed.where((F.col("p") <= m) | far).select("i", "j", "dist", F.when(F.col("p") <= m, "near").otherwise("far").alias("stratum"))
