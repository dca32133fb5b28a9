"""Pseudobulk contrasts, depth draws, gene modules, local distortion."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from loomgraph.core.skew import lookup
from loomgraph.functions.num import t_two_sided
from loomgraph.operators import counts as M
from loomgraph.operators import knn as N
from loomgraph.operators.linear import svd_left


def natural_key(name: Column | str) -> list[Column]:
    """Sort keys that put c2 before c10: text part, then number."""
    c = F.col(name) if isinstance(name, str) else name
    return [F.regexp_replace(c, r"\d+.*$", ""), F.regexp_extract(c, r"(\d+)", 1).try_cast("long"), c]


def multinomial_draws(counts: DataFrame, row: str, feature: str, n: str, depth: int, seed: int = 0) -> DataFrame:
    """``depth`` events per row with replacement, in proportion to its counts.

    A row's list has one entry per feature of the vocabulary at most; the draw is
    seeded by the row, so a repeated task gives the same result.
    """
    lists = counts.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(feature, n))).alias("x"))
    lists = lists.select(row, F.transform("x", lambda s: s[feature]).alias("f"), F.transform("x", lambda s: s[n].cast("double")).alias("w"), F.abs(F.xxhash64(F.col(row), F.lit(seed))).alias("h"))

    @pandas_udf(ArrayType(LongType()))
    def draw(w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng(int(s)).multinomial(depth, np.asarray(v) / np.sum(v)) for v, s in zip(w, h)])

    drawn = lists.withColumn("k", draw("w", "h")).select(row, F.explode(F.arrays_zip("f", "k")).alias("p"))
    return drawn.select(row, F.col("p.f").alias(feature), F.col("p.k").alias(n)).where(F.col(n) > 0)


def pseudobulk(counts: DataFrame, cells: DataFrame, cell: str, gene: str, n: str) -> DataFrame:
    """Counts summed per (sample, cluster, gene)."""
    return lookup(counts, cells.select(cell, "sample", "cluster"), cell).groupBy("sample", "cluster", gene).agg(F.sum(n).alias("s"))


def paired_contrasts(bulk: DataFrame, gene: str, pseudocount: float = 0.5) -> DataFrame:
    """Cluster against rest, paired by sample: mean log2 CPM ratio, t and p.

    The rest of a sample is its total minus the cluster.  The grid of samples,
    clusters and genes is that of the summed table.
    """
    per_gene = bulk.groupBy("sample", gene).agg(F.sum("s").alias("all"))
    lib_in = bulk.groupBy("sample", "cluster").agg(F.sum("s").alias("lib_in"))
    lib = lib_in.groupBy("sample").agg(F.sum("lib_in").alias("lib_all"))
    genes = bulk.agg(F.countDistinct(gene).alias("k"))
    grid = lib_in.join(lib, "sample").join(per_gene, "sample")  # each cluster of a sample against its gene totals
    x = grid.join(bulk, ["sample", "cluster", gene], "left").na.fill(0, ["s"]).join(F.broadcast(genes))
    inside = (F.col("s") + pseudocount) / (F.col("lib_in") + pseudocount * F.col("k"))
    rest = (F.col("all") - F.col("s") + pseudocount) / (F.col("lib_all") - F.col("lib_in") + pseudocount * F.col("k"))
    r = x.withColumn("lfc", F.log2(inside / rest)).groupBy("cluster", gene).agg(F.avg("lfc").alias("log2fc"), F.stddev_samp("lfc").alias("sd"), F.count(F.lit(1)).alias("n_samples"))
    t = F.when(F.col("sd") > 0, F.col("log2fc") / (F.col("sd") / F.sqrt("n_samples"))).otherwise(0.0)
    return r.withColumn("t", t).withColumn("p", F.when(F.col("n_samples") < 2, 1.0).otherwise(t_two_sided("t", F.col("n_samples") - 1)))


def variable_gene_scores(counts: DataFrame, row: str, gene: str, n: str, genes: int, k: int) -> tuple[DataFrame, list[str]]:
    """Principal scores of the most variable genes after log normalisation.

    Columns are standardised and clipped at 10.  Only ``genes`` columns are made
    wide; the products reach the driver as a genes x genes table.
    """
    x = M.log_normalise(counts, row, n)
    rows = counts.agg(F.countDistinct(row).alias("n_rows"))
    top = M.feature_moments(x, rows, gene, "value").orderBy(F.desc("variance"), gene).limit(genes).collect()
    names = [r[gene] for r in top]
    wide = x.groupBy(F.col(row).alias("node_id")).pivot(gene, names).agg(F.sum("value"))
    cols = []
    for i, r in enumerate(top):
        z = (F.coalesce(F.col(f"`{r[gene]}`"), F.lit(0.0)) - float(r["mean"])) / float(max(r["variance"], 1e-12) ** 0.5)
        cols.append(F.least(z, F.lit(10.0)).alias(f"z{i}"))
    scores, sing = svd_left(wide.select("node_id", *cols), [f"z{i}" for i in range(len(names))], k)
    return scores.select("node_id", *[(F.col(f"u{i}") * float(s)).alias(f"pc{i}") for i, s in enumerate(sing)]), names


def gene_modules(corr: np.ndarray, groups: int) -> np.ndarray:
    """Average-linkage groups of a selected marker set (at most a few hundred genes)."""
    members = [[i] for i in range(len(corr))]
    dist = 1.0 - corr
    while len(members) > max(1, groups):
        best, pair = np.inf, (0, 1)
        for a in range(len(members)):
            for b in range(a + 1, len(members)):
                d = dist[np.ix_(members[a], members[b])].mean()
                if d < best:
                    best, pair = d, (a, b)
        members[pair[0]] += members.pop(pair[1])
    out = np.zeros(len(corr), dtype=int)
    for g, m in enumerate(sorted(members, key=min)):
        out[m] = g
    return out


def local_distortion(truth: DataFrame, estimate: DataFrame, t: Sequence[str], e: Sequence[str], sizes: Sequence[int], centres: int = 200, seed: int = 0) -> DataFrame:
    """Mean local Procrustes error over spread, per neighbourhood size.

    Centres are a hashed sample; a task handles one centre and its
    ``max(sizes)`` neighbours.
    """
    picked = truth.orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(centres)
    near = N.knn(picked, max(sizes), t, targets=truth)
    both = truth.select("node_id", *t).join(estimate.select("node_id", *e), "node_id").withColumnRenamed("node_id", "nbr")
    rows = lookup(near.select(F.col("node_id").alias("centre"), "nbr", "rank"), both, "nbr")
    ts, es, ks = list(t), list(e), sorted(sizes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        out = []
        for k in ks:
            a, b = pdf[ts].to_numpy()[:k], pdf[es].to_numpy()[:k]
            a, b = a - a.mean(axis=0), b - b.mean(axis=0)
            u, s, vt = np.linalg.svd(b.T @ a)
            fitted = b @ (u @ vt) * (s.sum() / max((b * b).sum(), 1e-300))
            out.append((int(pdf["centre"].iloc[0]), k, float(np.sqrt(((a - fitted) ** 2).sum() / k)), float(np.sqrt((a * a).sum() / k))))
        return pd.DataFrame(out, columns=["centre", "size", "rmsd", "spread"])

    per = rows.groupBy("centre").applyInPandas(fit, "centre long, size int, rmsd double, spread double")
    return per.groupBy("size").agg(F.avg(F.col("rmsd") / F.col("spread")).alias("ratio"), F.avg("spread").alias("spread"))


def first_crossing(curve: DataFrame, level: float) -> float | None:
    """Spread at which the error ratio first falls to ``level``, interpolated."""
    rows = curve.orderBy("size").collect()  # one row per size
    for a, b in zip([None, *rows], rows):
        if b["ratio"] <= level:
            if a is None:
                return float(b["spread"])
            f = (a["ratio"] - level) / max(a["ratio"] - b["ratio"], 1e-300)
            return float(a["spread"] + f * (b["spread"] - a["spread"]))
    return None
