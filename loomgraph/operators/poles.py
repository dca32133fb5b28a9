"""Choosing pairs of spatially opposed genes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.core.order import dense_index
from loomgraph.core.session import cut
from loomgraph.core.skew import lookup
from loomgraph.operators.registration import EPS, assign_to_poles, correlation_to

SLICE = 50_000  # genes compared against at a time
LISTED = 1 << 18  # pairs that a task holds a sum for; more are joined
CELLS = 1 << 21  # numbers of a block of fields, and of its pairs, that a task holds


def bounded_pairs(stats: DataFrame, coords: Sequence[str], most: int) -> DataFrame:
    """The ``most`` gene pairs with the largest separation x locality weight.

    That product bounds the pair score from above.  Tasks compare their genes
    with one slice of the gene table at a time and return their best pairs only.
    """
    peaks = [f"peak_{c}" for c in coords]
    idx = cut(dense_index(stats.select("gene", "locality_rank", "scale", *peaks), ["gene"], "ix"))
    n = idx.count()
    spark = stats.sparkSession
    out = None
    for lo in range(0, n, SLICE):
        part = idx.where((F.col("ix") >= lo) & (F.col("ix") < lo + SLICE)).orderBy("ix").toPandas()  # at most SLICE rows
        held = spark.sparkContext.broadcast((part["gene"].to_numpy(), part["ix"].to_numpy(), part["locality_rank"].to_numpy(), part[peaks].to_numpy()))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            genes, ix, rank, xy = held.value
            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    row = r._asdict()
                    p = np.array([row[c] for c in peaks])
                    sep = np.sqrt(((xy - p) ** 2).sum(axis=1)) / (row["scale"] + EPS)
                    bound = sep * np.sqrt(rank * row["locality_rank"])
                    ok = np.flatnonzero(ix > row["ix"])
                    take = ok[np.argsort(-bound[ok], kind="stable")[:most]]
                    rows.append(pd.DataFrame({"a": row["gene"], "b": genes[take], "bound": bound[take], "separation": sep[take]}))
                frame = pd.concat(rows) if rows else pd.DataFrame({"a": [], "b": [], "bound": [], "separation": []})
                yield frame.nlargest(most, "bound")

        found = idx.mapInPandas(best, "a string, b string, bound double, separation double")
        out = found if out is None else out.unionByName(found)
    return out.orderBy(F.desc("bound"), "a", "b").limit(most)


def pair_correlations(pairs: DataFrame, fields: DataFrame, moments: DataFrame) -> DataFrame:
    """Field correlation of the listed pairs (absent entries are 0).

    Fields meet once per node: a task lays a few nodes' fields side by side and
    returns one sum per pair, so no row per pair and node is formed.  More than
    ``LISTED`` pairs are joined.
    """
    cross = _joined_sums(pairs, fields) if pairs.limit(LISTED + 1).count() > LISTED else _block_sums(pairs, fields)
    ma = moments.select(F.col("gene").alias("a"), F.col("m").alias("ma"), F.col("sd").alias("sa"), "n")
    mb = moments.select(F.col("gene").alias("b"), F.col("m").alias("mb"), F.col("sd").alias("sb"))
    x = pairs.join(cross, ["a", "b"], "left").join(ma, "a").join(mb, "b")
    cov = F.coalesce("c", F.lit(0.0)) / F.col("n") - F.col("ma") * F.col("mb")
    return x.withColumn("corr", F.when((F.col("sa") > 0) & (F.col("sb") > 0), cov / (F.col("sa") * F.col("sb"))).otherwise(0.0))


def _joined_sums(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    a = fields.select(F.col("gene").alias("a"), "node_id", F.col("f").alias("fa"))
    b = fields.select(F.col("gene").alias("b"), "node_id", F.col("f").alias("fb"))
    return pairs.select("a", "b").join(a, "a").join(b, ["b", "node_id"]).groupBy("a", "b").agg(F.sum(F.col("fa") * F.col("fb")).alias("c"))


def _block_sums(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    """(a, b, c): sums of products over the nodes, at most ``LISTED`` pairs."""
    spark = pairs.sparkSession
    listed = pairs.select("a", "b").distinct().orderBy("a", "b").toPandas()  # at most LISTED rows
    named = np.unique(listed[["a", "b"]].to_numpy().reshape(-1).astype(str)) if len(listed) else np.zeros(0, str)
    code = {g: i for i, g in enumerate(named)}
    ends = (np.array([code[g] for g in listed["a"]], np.int64), np.array([code[g] for g in listed["b"]], np.int64))
    numbers = spark.createDataFrame([(str(g), i) for g, i in code.items()], "gene string, code int")
    held = spark.sparkContext.broadcast(ends)
    wide = max(1, len(named))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = held.value
        total = np.zeros(len(left))
        for batch in batches:
            values = batch.column(0)
            flat, start = values.flatten(), values.offsets.to_numpy().astype(np.int64)
            start = start - start[0]
            codes, f = flat.field("code").to_numpy(), flat.field("f").to_numpy()
            step = max(1, CELLS // wide)
            for lo in range(0, len(batch), step):
                hi = min(lo + step, len(batch))
                rows = np.repeat(np.arange(hi - lo), np.diff(start[lo : hi + 1]))
                block = np.zeros((wide, hi - lo))
                np.add.at(block, (codes[start[lo] : start[hi]], rows), f[start[lo] : start[hi]])
                if len(left) * 8 >= wide * wide:  # most pairs are listed: one product for all
                    total += (block @ block.T)[left, right]
                else:
                    many = max(1, CELLS // (hi - lo))
                    for at in range(0, len(left), many):
                        total[at : at + many] += np.einsum("pn,pn->p", block[left[at : at + many]], block[right[at : at + many]])
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["pair", "c"])

    x = lookup(fields.select("gene", "node_id", "f").where("node_id is not null"), numbers, "gene")
    each = x.groupBy("node_id").agg(F.collect_list(F.struct("code", "f")).alias("values")).select("values")
    sums = each.mapInArrow(summed, "pair long, c double").groupBy("pair").agg(F.sum("c").alias("c"))
    order = spark.createDataFrame([(str(r.a), str(r.b), i) for i, r in enumerate(listed.itertuples(index=False))], "a string, b string, pair long")
    return order.join(sums, "pair").drop("pair")


def anchor_pair(stats: DataFrame, fields: DataFrame, moments: DataFrame, coords: Sequence[str], first: int = 1_024) -> dict:
    """The pair with the largest separation x sqrt(rank rank) x (1 - overlap).

    Exact: pairs are taken in order of their upper bound until the next bound
    cannot beat the best score found.  The result is oriented along the first
    principal axis of the peaks.
    """
    most = first
    while True:
        pairs = cut(bounded_pairs(stats, coords, most))
        scored = pair_correlations(pairs, fields, moments).withColumn("overlap", F.greatest("corr", F.lit(0.0)))
        scored = scored.withColumn("score", F.col("bound") * (1 - F.col("overlap")))
        best = scored.agg(F.min(F.struct((-F.col("score")).alias("neg"), "a", "b", "separation", "overlap")).alias("t")).first()["t"]
        last = pairs.agg(F.count(F.lit(1)).alias("n"), F.min("bound").alias("low")).first()
        if best is None:
            raise ValueError("at least two genes are needed for a pole pair")
        if last["n"] < most or last["low"] <= -best["neg"]:
            break
        most *= 8
    peaks = [f"peak_{c}" for c in coords]
    d = len(peaks)
    row = stats.agg(*[F.covar_pop(p, q) for p in peaks for q in peaks]).first()
    axis = np.linalg.eigh(np.array(row).reshape(d, d))[1][:, -1]
    axis = -axis if axis[0] < 0 else axis
    ends = {r["gene"]: float(np.dot([r[p] for p in peaks], axis)) for r in stats.where(F.col("gene").isin(best["a"], best["b"])).collect()}
    a, b = (best["a"], best["b"]) if ends[best["a"]] <= ends[best["b"]] else (best["b"], best["a"])
    return {"a": a, "b": b, "score": -best["neg"], "separation": best["separation"], "overlap": best["overlap"]}


def pole_pairs(stats: DataFrame, fields: DataFrame, moments: DataFrame, coords: Sequence[str], pairs: int = 3, per_side: int = 3) -> DataFrame:
    """Disjoint pole pairs, greedily: (pair, side, gene, place)."""
    spark = stats.sparkSession
    used: list[str] = []
    rows: list[tuple] = []
    for p in range(pairs):
        left = stats.where(~F.col("gene").isin(used)) if used else stats
        if left.limit(2).count() < 2:
            break
        f = fields.join(left.select("gene"), "gene", "left_semi")
        m = moments.join(left.select("gene"), "gene", "left_semi")
        pick = anchor_pair(left, f, m, coords)
        ca, cb = correlation_to(f, m, pick["a"], "corr_a"), correlation_to(f, m, pick["b"], "corr_b")
        chosen = assign_to_poles(left, ca, cb, (pick["a"], pick["b"]), per_side).collect()  # 2 x per_side rows
        used.extend(r["gene"] for r in chosen)
        rows.extend((f"pair{p:02d}", r["side"], r["gene"], int(r["place"])) for r in chosen)
    return spark.createDataFrame(rows, "pair string, side string, gene string, place int")


def check_disjoint(pairs: DataFrame) -> None:
    """Every gene belongs to one side of one pair."""
    twice = pairs.groupBy("gene").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"genes used more than once: {[r['gene'] for r in twice]}")
