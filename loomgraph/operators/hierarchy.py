"""Exact density hierarchy of a spanning forest: merge tree, condensed clusters, excess of mass.

A reference (ref) names a node of the merge tree: ``2 * node_id`` is a leaf and
``2 * rank + 1`` the merge made by the forest edge of that rank (edges ordered
by length, then ends).  No task sees more than ``BLOCK`` rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.core.order import dense_index
from loomgraph.core.session import cut
from loomgraph.core.skew import lookup
from loomgraph.operators.components import components

BLOCK = 1 << 18  # rows one task merges or selects at once
_SHORTEST = 1e-12  # density of coinciding points stays finite


def merge_tree(forest: DataFrame, block: int = BLOCK) -> DataFrame:
    """(ref, d, a, b, n_a, n_b): one row a forest edge, the two parts it joins and their leaves.

    Ranges of ranks are halved until a range has ``block`` edges.  At each
    halving the parts joined by the short half stand as single ends, named by
    their last merge, in the long half; ranges share no end, so one component
    search serves all of them.  Each last range is then merged in one task.
    """
    ranked = cut(dense_index(forest.select("i", "j", "d"), ["d", "i", "j"], "rank"))
    one = F.lit(1).cast("long")
    live = ranked.select("rank", "d", (F.col("i") * 2).alias("a"), (F.col("j") * 2).alias("b"), one.alias("n_a"), one.alias("n_b"))
    total, span = ranked.count(), block
    while span < total:
        span *= 2
    while span > block:
        short = F.col("rank") % span < span // 2
        low = live.where(short)
        label = cut(components(low, "a", "b").withColumnRenamed("node_id", "a"))
        last = lookup(low.select("a", "rank"), label, "a").groupBy("comp").agg(F.max("rank").alias("rank"))
        ends = low.select("a", F.col("n_a").alias("n")).unionByName(low.select(F.col("b").alias("a"), F.col("n_b").alias("n"))).distinct()
        leaves = lookup(label, ends, "a").groupBy("comp").agg(F.sum("n").alias("n"))
        part = last.join(leaves, "comp").select("comp", (F.col("rank") * 2 + 1).alias("part"), "n")
        named = cut(lookup(label, part, "comp").select("a", "part", "n"))
        x = lookup(live.where(~short), named.select("a", F.col("part").alias("pa"), F.col("n").alias("na")), "a", "left")
        x = lookup(x, named.select(F.col("a").alias("b"), F.col("part").alias("pb"), F.col("n").alias("nb")), "b", "left")
        up = x.select(
            "rank", "d", F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"),
            F.coalesce("na", "n_a").alias("n_a"), F.coalesce("nb", "n_b").alias("n_b"),
        )
        live = cut(low.unionByName(up))
        span //= 2
    merged = live.groupBy(F.floor(F.col("rank") / block).alias("range")).applyInPandas(
        _merge_range, "ref long, d double, a long, b long, n_a long, n_b long"
    )
    return cut(merged)


def _merge_range(rows: pd.DataFrame) -> pd.DataFrame:
    """Single-linkage merges of one range, in order of rank."""
    rows = rows.sort_values("rank")
    ends = np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()])
    names, first, code = np.unique(ends, return_index=True, return_inverse=True)
    size = np.concatenate([rows["n_a"].to_numpy(), rows["n_b"].to_numpy()])[first].tolist()
    name, up = names.tolist(), list(range(len(names)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    n = len(rows)
    refs = (rows["rank"].to_numpy() * 2 + 1).tolist()
    out = np.empty((n, 4), dtype=np.int64)
    for k, (x, y, ref) in enumerate(zip(code[:n].tolist(), code[n:].tolist(), refs)):
        x, y = root(x), root(y)
        if x == y:
            raise ValueError("the edges are not a forest")
        out[k] = name[x], name[y], size[x], size[y]
        if size[x] < size[y]:
            x, y = y, x
        up[y] = x
        size[x] += size[y]
        name[x] = ref
    return pd.DataFrame({"ref": refs, "d": rows["d"].to_numpy(), "a": out[:, 0], "b": out[:, 1], "n_a": out[:, 2], "n_b": out[:, 3]})


def _ends(links: pd.DataFrame) -> np.ndarray:
    """Where the chain of every pointer ends."""
    names, code = np.unique(np.concatenate([links["ref"].to_numpy(), links["ptr"].to_numpy()]), return_inverse=True)
    to = np.arange(len(names))
    to[code[: len(links)]] = code[len(links) :]
    for _ in range(64):
        if (to[to] == to).all():
            return names[to[code[: len(links)]]]
        to = to[to]
    raise RuntimeError("pointers run in a circle")


def _chased(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = list(batches)
    if held:
        links = pd.concat(held, ignore_index=True)
        yield links.assign(ptr=_ends(links))


def _jump(links: DataFrame, max_rounds: int = 64, block: int = BLOCK) -> DataFrame:
    """(ref, ptr) with every pointer moved to the end of its chain; ends point to themselves or outside.

    ``block`` pointers or fewer are chased in one task.
    """
    links = cut(links)
    if links.count() <= block:
        return cut(links.coalesce(1).mapInPandas(_chased, links.schema))
    for _ in range(max_rounds):
        ahead = links.select(F.col("ref").alias("ptr"), F.col("ptr").alias("next"))
        step = lookup(links, ahead, "ptr", "left").select("ref", F.coalesce("next", "ptr").alias("ptr"), (F.col("next") != F.col("ptr")).alias("moved"))
        step = cut(step)
        links = step.select("ref", "ptr")
        if not step.where("moved").limit(1).count():
            return links
    raise RuntimeError(f"pointers are not settled after {max_rounds} rounds")


def _children(tree: DataFrame, min_size: int) -> DataFrame:
    """(ref, n, up, density, split) of every child of a merge."""
    density = 1.0 / F.greatest("d", F.lit(_SHORTEST))
    split = (F.col("n_a") >= min_size) & (F.col("n_b") >= min_size)
    sides = F.array(F.struct(F.col("a").alias("ref"), F.col("n_a").alias("n")), F.struct(F.col("b").alias("ref"), F.col("n_b").alias("n")))
    x = tree.select(F.explode(sides).alias("side"), F.col("ref").alias("up"), density.alias("density"), split.alias("split"))
    return x.select("side.ref", "side.n", "up", "density", "split")


def condensed_clusters(tree: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Clusters (head, up, n, birth, stability, reach) and the head (ref, head) of every large merge.

    A merge of at least ``min_size`` leaves belongs to the cluster of the merge
    above unless that joins two large parts; there both parts are clusters of
    their own.  ``birth`` is the density at which a cluster parts from ``up``
    (0 and null at a root), ``stability`` sums (density of leaving - birth) over
    its leaves and ``reach`` is the largest density at which leaves left.
    """
    if min_size < 2:
        raise ValueError("min_size must be 2 or more")
    child = cut(_children(tree, min_size))
    large = tree.where(F.col("n_a") + F.col("n_b") >= min_size).select("ref", (F.col("n_a") + F.col("n_b")).alias("n"))
    above = child.where(F.col("n") >= min_size).select("ref", "up", "density", "split")
    large = cut(large.join(above, "ref", "left"))
    heads = _jump(large.select("ref", F.when(F.col("up").isNull() | F.col("split"), F.col("ref")).otherwise(F.col("up")).alias("ptr")))
    heads = heads.withColumnRenamed("ptr", "head")
    leaves = child.where(F.col("split") | (F.col("n") < min_size)).select(F.col("up").alias("ref"), "n", "density")
    gone = lookup(leaves, heads, "ref").groupBy("head").agg(F.sum(F.col("n") * F.col("density")).alias("mass"), F.max("density").alias("reach"))
    own = lookup(gone, large.select(F.col("ref").alias("head"), "n", "up", F.coalesce("density", F.lit(0.0)).alias("birth")), "head")
    named = lookup(own, heads.select(F.col("ref").alias("up"), F.col("head").alias("above")), "up", "left")
    stability = F.col("mass") - F.col("n") * F.col("birth")
    return cut(named.select("head", F.col("above").alias("up"), "n", "birth", stability.alias("stability"), "reach")), heads


def _select_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Best mass and winners of clusters of one block, children before their parents."""
    rows = rows.sort_values("head")
    below = dict(zip(rows["head"].tolist(), rows["below"].tolist()))
    best, wins = [], []
    for head, up, own, may in zip(rows["head"].tolist(), rows["up"].tolist(), rows["stability"].tolist(), rows["may"].tolist()):
        win = may and own >= below[head]
        best.append(own if win else below[head])
        wins.append(win)
        if up in below:
            below[up] += best[-1]
    return pd.DataFrame({"head": rows["head"], "up": rows["up"], "best": best, "wins": wins})


def excess_of_mass(clusters: DataFrame, may_win: Column, block: int = BLOCK) -> DataFrame:
    """(head, wins): clusters at least as stable as the best choice below them, where ``may_win`` holds.

    A cluster's head comes later in the order of merges than those below it, so
    blocks of ``block`` clusters in that order are done one after the other and
    each needs only the sums that earlier blocks left for its clusters.
    """
    flat = clusters.select("head", F.coalesce("up", F.lit(-1)).alias("up"), "stability", may_win.alias("may"))
    placed = cut(dense_index(flat, ["head"], "pos"))
    total, done = placed.count(), None
    for start in range(0, total, block):
        part = placed.where(F.col("pos").between(start, start + block - 1))
        if done is None:
            part = part.withColumn("below", F.lit(0.0))
        else:
            sums = done.groupBy(F.col("up").alias("head")).agg(F.sum("best").alias("below"))
            part = part.join(sums, "head", "left").fillna(0.0, ["below"])
        step = cut(part.groupBy(F.lit(0).alias("block")).applyInPandas(_select_block, "head long, up long, best double, wins boolean"))
        done = step if done is None else done.unionByName(step)
    if done is None:
        return clusters.select("head", F.lit(False).alias("wins"))
    return done.select("head", "wins")


def stable_labels(forest: DataFrame, nodes: DataFrame, min_size: int, roots: str = "several", block: int = BLOCK) -> DataFrame:
    """(node_id, label): the most stable clusters of the forest's hierarchy, named by their smallest node, -1 noise.

    ``roots`` says when a root, a cluster that is a whole component, may win:
    "several" if there is more than one, as if all joined at density 0;
    "always" for components taken one by one.  There a root that wins keeps
    only leaves that leave at its ``reach`` or denser.  Nodes without an edge and
    components below ``min_size`` are noise; an empty forest is all noise.
    """
    if roots not in ("several", "always"):
        raise ValueError(f"roots: several or always, not {roots}")
    tree = merge_tree(forest, block)
    clusters, heads = condensed_clusters(tree, min_size)
    single = roots == "several" and clusters.where("up is null").limit(2).count() < 2
    chosen = excess_of_mass(clusters, F.col("up").isNotNull() if single else F.lit(True), block)
    top = _highest(clusters.join(chosen, "head"))
    child = _children(tree, min_size)
    small = _jump(child.where(F.col("n") < min_size).select("ref", F.col("up").alias("ptr")))
    # the merge at which a leaf leaves is the first large one above it
    leaf = small.where(F.col("ref") % 2 == 0).select((F.col("ref") / 2).cast("long").alias("node_id"), F.col("ptr").alias("ref"))
    density = tree.select("ref", (1.0 / F.greatest("d", F.lit(_SHORTEST))).alias("density"))
    placed = lookup(lookup(lookup(leaf, heads, "ref"), density, "ref"), top, "head")
    if roots == "always":
        placed = placed.where(~F.col("is_root") | (F.col("density") >= F.col("reach")))
    placed = cut(placed.select("node_id", "top"))
    names = placed.groupBy("top").agg(F.min("node_id").alias("label"))
    return nodes.select("node_id").join(lookup(placed, names, "top").select("node_id", "label"), "node_id", "left").fillna(-1, ["label"])


def _highest(clusters: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(head, top, is_root, reach): the highest winner at or above each cluster that has one."""
    state = cut(clusters.select("head", F.when(F.col("wins"), F.col("head")).alias("top"), F.col("up").alias("ptr")))
    for _ in range(max_rounds):
        if not state.where("ptr is not null").limit(1).count():
            break
        ahead = state.select(F.col("head").alias("ptr"), F.col("top").alias("higher"), F.col("ptr").alias("next"))
        state = cut(lookup(state, ahead, "ptr", "left").select("head", F.coalesce("higher", "top").alias("top"), F.col("next").alias("ptr")))
    else:
        raise RuntimeError(f"winners are not settled after {max_rounds} rounds")
    winner = clusters.select(F.col("head").alias("top"), F.col("up").isNull().alias("is_root"), "reach")
    return cut(lookup(state.where("top is not null"), winner, "top").select("head", "top", "is_root", "reach"))
