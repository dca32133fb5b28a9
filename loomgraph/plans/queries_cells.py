"""Catalog: pseudobulk, depth draws, scores, distortion, registration."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.core.catalog import query
from loomgraph.operators import cells as C
from loomgraph.sources import tables as T


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


BULK = """bulk AS (SELECT CAST(n_regionkey AS BIGINT) AS sample, c_mktsegment AS cluster, gene, CAST(sum(n) AS BIGINT) AS s
  FROM hub_counts JOIN customer ON hub = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def _bulk(spark, folder):
    n = T.table(spark, folder, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("sample"))
    c = T.table(spark, folder, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return C.pseudobulk(T.hub_counts(spark, folder), c.select(F.col("c_custkey").alias("hub"), "sample", F.col("c_mktsegment").alias("cluster")), "hub", "gene", "n")


@query("pseudobulk_sums", f"WITH {T.HUB}, {BULK} SELECT sample, cluster, gene, s FROM bulk", ("AGG39",))
def pseudobulk_sums(spark, folder):
    return _bulk(spark, folder)


@query("pseudobulk_cpm", f"""WITH {T.HUB}, {BULK}, g AS (SELECT sample, gene, sum(s) AS a FROM bulk GROUP BY ALL), li AS (SELECT sample, cluster, sum(s) AS li FROM bulk GROUP BY ALL),
la AS (SELECT sample, sum(li) AS la FROM li GROUP BY 1), k AS (SELECT count(DISTINCT gene) AS k FROM bulk),
x AS (SELECT li.cluster, g.gene, log2(((coalesce(s, 0) + 0.5) / (li + 0.5 * k)) / ((a - coalesce(s, 0) + 0.5) / (la - li + 0.5 * k))) AS lfc
  FROM li JOIN la USING (sample) JOIN g USING (sample) LEFT JOIN bulk b ON b.sample = li.sample AND b.cluster = li.cluster AND b.gene = g.gene, k)
SELECT cluster, gene, round(avg(lfc), 6) AS log2fc, count(*) AS n_samples, round(avg(lfc) / (stddev_samp(lfc) / sqrt(count(*))), 4) AS t FROM x GROUP BY ALL""", ("AGG39",))
def pseudobulk_cpm(spark, folder):
    return C.paired_contrasts(_bulk(spark, folder), "gene").select("cluster", "gene", F.round("log2fc", 6).alias("log2fc"), "n_samples", F.round("t", 4).alias("t"))


@query("multinomial_depth", None, ("SRT8",))
def multinomial_depth(spark, folder):
    d = C.multinomial_draws(T.hub_counts(spark, folder), "hub", "gene", "n", 40, seed=2)
    return d.groupBy("hub").agg(F.sum("n").alias("total"))


@query("variable_gene_scores", None, ("LA21", "LA19"))
def variable_gene_scores(spark, folder):
    return C.variable_gene_scores(T.hub_counts(spark, folder), "hub", "gene", "n", 20, 3)[0]


@query("natural_sort_keys", "SELECT DISTINCT 'g' || CAST(l_partkey % 50 AS VARCHAR) AS gene, 'g' AS head, l_partkey % 50 AS number FROM lineitem", ("SRT13",))
def natural_sort_keys(spark, folder):
    g = T.hub_counts(spark, folder).select("gene").distinct()
    head, number, _ = C.natural_key("gene")
    return g.select("gene", head.alias("head"), number.alias("number"))


@query("local_distortion", None, ("ST19",))
def local_distortion(spark, folder):
    p = T.points(spark, folder, 4)
    return C.local_distortion(p, p, ("x0", "x1"), ("x2", "x3"), (8, 16, 32), centres=40)


@query("register_on_slice", None, ("RG21", "RG22", "RG23", "RG27", "T26", "T27"))
def register_on_slice(spark, folder):
    from loomgraph.plans.register import register

    n = T.table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), (F.col("n_nationkey") / 25.0).alias("f"), (F.col("n_nationkey") % 5).cast("double").alias("sx"), F.floor(F.col("n_nationkey") / 5).cast("double").alias("sy"))
    s = T.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("node_id"), ((F.col("s_acctbal") + 1000) / 11000).alias("f"))
    half = s.select(F.col("node_id").alias("i"), (F.col("node_id") + 1).alias("j"), F.lit(1.0).alias("w")).join(s.select(F.col("node_id").alias("j")), "j", "left_semi")
    edges = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    caps = n.select("node_id").join(F.broadcast(s.agg((F.floor(F.count(F.lit(1)) / 25) + 4).alias("capacity"))))
    out = register(s, n, edges, caps, ["f"], ["sx", "sy"], k=8, refine=1, resolution=10, step=2)
    return out.final.select("node_id", "slice")
