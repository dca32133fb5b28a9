"""Catalog: neighbours, ranks, spatial statistics, permutations, meta-analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.core.catalog import query
from loomgraph.functions import num
from loomgraph.operators import knn as N
from loomgraph.operators import ranks as K
from loomgraph.operators import stats as S
from loomgraph.plans.queries_graph import GEO, XY, _kgraph
from loomgraph.sources import tables as T


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


D2 = "(a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)"
NEAR6 = f"""near AS (SELECT a.node_id, b.node_id AS nbr, row_number() OVER (PARTITION BY a.node_id ORDER BY {D2}, b.node_id) AS rank, sqrt({D2}) AS dist
  FROM points a JOIN points b ON a.node_id <> b.node_id QUALIFY rank <= 6)"""
SELF6 = f"""near AS (SELECT a.node_id, b.node_id AS nbr, row_number() OVER (PARTITION BY a.node_id ORDER BY {D2}, b.node_id) AS rank
  FROM points a, points b QUALIFY rank <= 6)"""


@query("knn_exact", f"WITH {T.points_sql(2)}, {NEAR6} SELECT node_id, nbr, rank, round(dist, 9) AS dist FROM near", ("JN19", "GR26"))
def knn_exact(spark, folder):
    return N.knn(T.points(spark, folder, 2), 6, XY).withColumn("dist", F.round("dist", 9))


@query("knn_many_dims", """WITH p AS (SELECT vec_id, embedding FROM embeddings), d AS (SELECT a.vec_id AS node_id, b.vec_id AS nbr,
  (SELECT sum((CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) ** 2) FROM (SELECT unnest(a.embedding) AS x, unnest(b.embedding) AS y)) AS d2 FROM p a JOIN p b ON a.vec_id <> b.vec_id)
SELECT node_id, nbr, row_number() OVER (PARTITION BY node_id ORDER BY d2, nbr) AS rank, round(sqrt(d2), 6) AS dist FROM d QUALIFY rank <= 4""", ("JN19",))
def knn_many_dims(spark, folder):
    p = T.points(spark, folder, 64)
    return N.knn(p, 4, [f"x{i}" for i in range(64)]).withColumn("dist", F.round("dist", 6))


@query("knn_variable_k", f"WITH {T.points_sql(2)}, {NEAR6} SELECT n.node_id, nbr, rank FROM near n JOIN points p ON p.node_id = n.node_id WHERE rank <= 1 + label % 5", ("JN20",))
def knn_variable_k(spark, folder):
    p = T.points(spark, folder, 2)
    return N.variable_k(N.knn(p, 6, XY), p.select("node_id", (1 + F.col("label") % 5).alias("row_k"))).select("node_id", "nbr", "rank")


@query("knn_smooth", f"WITH {T.points_sql(3)}, {SELF6} SELECT n.node_id, round(avg(p.x2), 9) AS x2 FROM near n JOIN points p ON p.node_id = nbr GROUP BY 1", ("LA17", "JN21"))
def knn_smooth(spark, folder):
    p = T.points(spark, folder, 3)
    return N.smooth(N.knn(p, 6, XY, include_self=True), p, "x2").withColumn("x2", F.round("x2", 9))


@query("knn_ratio_support", f"""WITH {T.points_sql(2)}, lab AS (SELECT *, label % 3 AS ca, label % 4 AS cb FROM points WHERE label % 3 + label % 4 > 0),
near AS (SELECT a.node_id, b.ca, b.cb, row_number() OVER (PARTITION BY a.node_id ORDER BY {D2}, b.node_id) AS rank FROM points a, lab b QUALIFY rank <= 6)
SELECT node_id, CAST(sum(ca + cb) AS BIGINT) AS support, round(sum(ca) / (sum(ca + cb) + 1e-12), 6) AS ratio FROM near GROUP BY 1""", ("RG7",))
def knn_ratio_support(spark, folder):
    from loomgraph.operators.registration import ratio_from_labelled

    p = T.points(spark, folder, 2)
    counts = p.select("node_id", (F.col("label") % 3).alias("a"), (F.col("label") % 4).alias("b"))
    return ratio_from_labelled(p, counts, XY, 6).select("node_id", "support", F.round("ratio", 6).alias("ratio"))


@query("knn_event_counts", f"""WITH {T.points_sql(2)}, {SELF6}, c AS (SELECT n.node_id, p.label, count(*) AS c FROM near n JOIN points p ON p.node_id = nbr GROUP BY ALL),
e AS (SELECT x.label AS a, y.label AS b, CASE WHEN x.label = y.label THEN x.c * (x.c - 1) // 2 ELSE x.c * y.c END AS e FROM c x JOIN c y ON x.node_id = y.node_id AND x.label <= y.label)
SELECT a, b, CAST(sum(e) AS BIGINT) AS value, count(*) AS units FROM e WHERE e > 0 GROUP BY ALL""", ("AGG49",))
def knn_event_counts(spark, folder):
    p = T.points(spark, folder, 2)
    return S.neighbourhood_events(N.knn(p, 6, XY, include_self=True), p.select("node_id", "label"))


@query("relative_enrichment", f"""WITH {T.points_sql(2)}, {SELF6}, per AS (SELECT n.node_id, count(*) AS slots, count(*) FILTER (p.label = 1) AS f, count(*) FILTER (p.label = 2) AS s FROM near n JOIN points p ON p.node_id = nbr GROUP BY 1),
c AS (SELECT CASE WHEN x0 > 0 THEN 1 ELSE 0 END AS cluster, count(*) AS n_hubs, sum(slots) AS slots, sum(f) AS f, sum(s) AS s FROM per JOIN points USING (node_id) GROUP BY 1),
g AS (SELECT avg(CAST(label = 1 AS INT)) AS gf, avg(CAST(label = 2 AS INT)) AS gs FROM points)
SELECT cluster, n_hubs, CAST(slots AS BIGINT) AS slots, CAST(f AS BIGINT) AS first_hits, CAST(s AS BIGINT) AS second_hits,
  round(log2(((f + 0.5) / (slots * gf + 0.5)) / ((s + 0.5) / (slots * gs + 0.5))), 6) AS score FROM c, g""", ("AGG50",))
def relative_enrichment(spark, folder):
    p = T.points(spark, folder, 2)
    c = p.select("node_id", F.when(F.col("x0") > 0, 1).otherwise(0).alias("cluster"))
    e = S.relative_enrichment(N.knn(p, 6, XY, include_self=True), p.select("node_id", "label"), c, 1, 2)
    return e.withColumn("score", F.round("score", 6))


@query("stratified_pairs", None, ("JN22",))
def stratified_pairs(spark, folder):
    s = N.stratified_pairs(T.points(spark, folder, 2), XY, 4, seed=2)
    return s.groupBy("i", "stratum").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- ranks
FIELDS = """fields AS (SELECT o_orderkey AS node_id, 'price' AS field, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'cust', CAST(o_custkey AS DOUBLE) FROM orders)"""
AVG_RANK = "rank() OVER (PARTITION BY field ORDER BY value) + (count(*) OVER (PARTITION BY field, value) - 1) / 2.0"


def _fields(spark, folder):
    o = T.table(spark, folder, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"))
    return K.long_columns(o, "node_id", ["price", "cust"])


@query("rank_scores", f"""WITH {FIELDS}, r AS (SELECT *, {AVG_RANK} AS rank, CAST(count(*) OVER (PARTITION BY field) AS DOUBLE) AS n FROM fields)
SELECT node_id, field, rank, round(sqrt(12.0 / (n * (n * n - 1))) * (rank - (n + 1) / 2), 9) AS score FROM r""", ("WIN9", "WIN11"))
def rank_scores(spark, folder):
    return K.rank_scores(_fields(spark, folder)).select("node_id", "field", "rank", F.round("score", 9).alias("score"))


@query("binned_ranks", None, ("WIN10",))
def binned_ranks(spark, folder):
    o = T.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return K.binned_ranks(o, "o_totalprice", 256).select("o_orderkey", "rank")


SUPPORT = "s AS (SELECT *, CASE WHEN node_id % 4 = 0 THEN 0 ELSE 1 END AS support FROM fields)"


def _supported(spark, folder):
    return _fields(spark, folder).withColumn("support", F.when(F.col("node_id") % 4 == 0, 0).otherwise(1))


@query("masked_rank", f"""WITH {FIELDS}, {SUPPORT}, r AS (SELECT *, {AVG_RANK} AS rk FROM s WHERE support > 0)
SELECT node_id, field, round(rk / max(rk) OVER (PARTITION BY field), 9) AS out FROM r UNION ALL SELECT node_id, field, 0.5 FROM s WHERE support = 0""", ("WIN11",))
def masked_rank(spark, folder):
    return K.masked_ranks(_supported(spark, folder), "field", "value", "support").select("node_id", "field", F.round("out", 9).alias("out"))


@query("minmax_rescale", f"""WITH {FIELDS}, {SUPPORT}, l AS (SELECT field, min(value) AS lo, max(value) AS hi FROM s WHERE support > 0 GROUP BY 1)
SELECT node_id, field, CASE WHEN support > 0 THEN round((value - lo) / (hi - lo), 9) ELSE 0.5 END AS out FROM s JOIN l USING (field)""", ("WIN12",))
def minmax_rescale(spark, folder):
    return K.unit_rescale(_supported(spark, folder), "field", "value", "support").select("node_id", "field", F.round("out", 9).alias("out"))


@query("rank_rescale", f"""WITH {FIELDS}, {SUPPORT}, r AS (SELECT *, {AVG_RANK} AS rk FROM s WHERE support > 0), l AS (SELECT field, min(rk) AS lo, max(rk) AS hi FROM r GROUP BY 1)
SELECT node_id, field, round((rk - lo) / (hi - lo), 9) AS out FROM r JOIN l USING (field) UNION ALL SELECT node_id, field, 0.5 FROM s WHERE support = 0""", ("WIN13",))
def rank_rescale(spark, folder):
    return K.rank_rescale(_supported(spark, folder), "field", "value", F.col("support") > 0).select("node_id", "field", F.round("out", 9).alias("out"))


@query("rankit_scores", None, ("WIN14",))
def rankit_scores(spark, folder):
    return K.rankit(_fields(spark, folder), "field", "value").select("node_id", "field", F.round("out", 6).alias("out"))


@query("bh_fdr", """WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice / 600000 END AS p FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS rn, count(*) OVER () AS m FROM p WHERE p IS NOT NULL)
SELECT k, round(least(1, min(p * m / rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM r UNION ALL SELECT k, NULL FROM p WHERE p IS NULL""", ("WIN15",))
def bh_fdr(spark, folder):
    o = T.table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice") / 600000).alias("p"))
    return K.bh_fdr(o, "p", "k").select("k", F.round("q", 9).alias("q"))


@query("largest_remainder", """WITH m AS (SELECT o_custkey AS k, CAST(count(*) AS DOUBLE) AS m FROM orders GROUP BY 1), e AS (SELECT k, m / sum(m) OVER () * 20000 AS e FROM m),
f AS (SELECT k, e, CAST(floor(e) AS BIGINT) AS w, row_number() OVER (ORDER BY e - floor(e) DESC, k) AS rn FROM e)
SELECT k, round(e, 6) AS expected, w + CASE WHEN rn <= 20000 - (SELECT sum(w) FROM f) THEN 1 ELSE 0 END AS capacity FROM f""", ("WIN18", "RG9"))
def largest_remainder(spark, folder):
    m = T.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("m"))
    return K.largest_remainder(m, "k", "m", 20000).withColumn("expected", F.round("expected", 6))


@query("holdout_folds", None, ("WIN22",))
def holdout_folds(spark, folder):
    p = T.table(spark, folder, "part").select("p_partkey")
    return K.folds(p, "p_partkey", 5, seed=1, fold=2).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_selection", """WITH r AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS place, count(*) OVER () AS n FROM part),
mid AS (SELECT DISTINCT 30 + CAST(round(i * (n - 61) / 29.0) AS BIGINT) AS place FROM (SELECT DISTINCT n FROM r), range(0, 30) t(i))
SELECT p_partkey, place, CASE WHEN place < 30 THEN 'external_high' WHEN place >= n - 30 THEN 'external_low' ELSE 'middle_stratified' END AS selection
FROM r WHERE place < 30 OR place >= n - 30 OR place IN (FROM mid)""", ("WIN23",))
def stratified_selection(spark, folder):
    p = T.table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return K.stratified_selection(p, "p_retailprice", "p_partkey", 90).select("p_partkey", "place", "selection")


# ---------------------------------------------------------------- spatial statistics
@query("morans_i", f"""WITH {GEO}, z AS (SELECT node_id, x0 - avg(x0) OVER () AS z FROM points)
SELECT round((SELECT count(*) FROM z) / sum(w) * sum(w * a.z * b.z) / (SELECT sum(z * z) FROM z), 6) AS moran_i FROM kg JOIN z a ON a.node_id = i JOIN z b ON b.node_id = j""", ("ST1",))
def morans_i(spark, folder):
    p, g = _kgraph(spark, folder)
    return S.morans_i(g, p.select("node_id", F.col("x0").alias("z"))).select(*r6("moran_i"))


MORAN_X = "x AS (SELECT node_id, gene, n FROM hub_counts JOIN points ON hub = node_id)"


@query("gene_autocorrelation", f"""WITH {GEO}, {T.HUB}, {MORAN_X}, g AS (SELECT DISTINCT gene FROM x), f AS (SELECT node_id, gene, coalesce(n, 0) AS v FROM points CROSS JOIN g LEFT JOIN x USING (node_id, gene)),
m AS (SELECT gene, avg(v) AS m, var_pop(v) AS s2, count(*) AS n FROM f GROUP BY 1), z AS (SELECT node_id, gene, v - m AS z FROM f JOIN m USING (gene)),
e AS (SELECT a.gene, sum(w) AS s0, sum(w * a.z * b.z) AS zz, sum(w * (a.z - b.z) ** 2) / sum(w) AS en FROM kg JOIN z a ON a.node_id = i JOIN z b ON b.node_id = j AND a.gene = b.gene GROUP BY 1)
SELECT gene, round(n / s0 * zz / (n * s2), 6) AS moran_i, round(en / s2, 6) AS dirichlet, round(-log2(en / s2 / (2.0 * n / (n - 1))), 6) AS smoothness FROM e JOIN m USING (gene)""", ("ST2", "ST4", "ST5"))
def gene_autocorrelation(spark, folder):
    p, g = _kgraph(spark, folder)
    x = T.hub_counts(spark, folder).withColumnRenamed("hub", "node_id").join(p.select("node_id"), "node_id", "left_semi")
    return S.feature_autocorrelation(g, x, p, "gene", "n").select("gene", *r6("moran_i", "dirichlet", "smoothness"))


@query("dirichlet_energy", f"""WITH {GEO} SELECT round(sum(w * (a.x0 - b.x0) ** 2) / sum(w), 9) AS energy FROM kg JOIN points a ON a.node_id = i JOIN points b ON b.node_id = j WHERE i < j""", ("ST4", "RG19"))
def dirichlet_energy(spark, folder):
    p, g = _kgraph(spark, folder)
    return S.dirichlet_energy(g, p.select("node_id", F.col("x0").alias("z"))).select(F.round("energy", 9).alias("energy"))


@query("pair_distances", None, ("ST3", "ST5"))
def pair_distances(spark, folder):
    p = T.points(spark, folder, 2)
    return S.sampled_pair_distance(p, XY, "label", 8, seed=4).select("label", F.round("mean_dist", 6).alias("mean_dist"), "n_pairs")


@query("spearman_pearson", """WITH r AS (SELECT o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS ry FROM orders)
SELECT 'pearson' AS how, round(corr(x, y), 6) AS r, count(*) AS n FROM r UNION ALL SELECT 'spearman', round(corr(rx, ry), 6), count(*) FROM r""", ("ST7", "LA18"))
def spearman_pearson(spark, folder):
    o = T.table(spark, folder, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    out = None
    for how in ("pearson", "spearman"):
        c = S.correlation(o, "x", "y", how).select(F.lit(how).alias("how"), F.round("r", 6).alias("r"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@query("correlation_p", None, ("ST7",))
def correlation_p(spark, folder):
    o = T.table(spark, folder, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    return S.correlation(o, "x", "y", "spearman").select(*r6("r", "p"), "n")


@query("ols_residuals", """WITH m AS (SELECT regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a FROM orders)
SELECT o_orderkey, round(o_totalprice - a - b * o_custkey, 3) AS resid FROM orders, m""", ("ST6",))
def ols_residuals(spark, folder):
    o = T.table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("c"))
    return S.residualise(o, "o_totalprice", ["c"], "resid").select("o_orderkey", F.round("resid", 3).alias("resid"))


@query("vector_metrics", """WITH d AS (SELECT l_discount * 5 AS p, l_tax * 5 AS t FROM lineitem), m AS (SELECT count(*) AS n, avg(abs(p - t)) AS mae, sqrt(avg((p - t) ** 2)) AS rmse, avg(p - t) AS bias,
  avg(abs(0.5 - t)) AS neutral_mae, sqrt(avg((0.5 - t) ** 2)) AS neutral_rmse, corr(p, t) AS pearson FROM d)
SELECT n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(neutral_mae, 6) AS neutral_mae, round(neutral_rmse, 6) AS neutral_rmse, round(pearson, 6) AS pearson,
  round(neutral_mae - mae, 6) AS mae_gain, round(neutral_rmse - rmse, 6) AS rmse_gain FROM m""", ("ST8",))
def vector_metrics(spark, folder):
    d = T.table(spark, folder, "lineitem").select((F.col("l_discount") * 5).alias("p"), (F.col("l_tax") * 5).alias("t"))
    return S.vector_metrics(d, "p", "t").select("n", *r6("mae", "rmse", "bias", "neutral_mae", "neutral_rmse", "pearson", "mae_gain", "rmse_gain"))


@query("logit_fractions", "SELECT gene, round(ln(p / (1 - p)), 6) AS logit FROM (SELECT gene, greatest(least(d, 1 - 1e-4), 1e-4) AS p FROM (SELECT l_partkey AS gene, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS d FROM lineitem GROUP BY 1))", ("PRJ29",))
def logit_fractions(spark, folder):
    d = T.table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("d"))
    return d.select("gene", F.round(num.logit("d"), 6).alias("logit"))


# ---------------------------------------------------------------- meta-analysis
META = """b AS (SELECT c_mktsegment AS sample, gene, c_nationkey < 12 AS cs, n >= 4 AS hit FROM hub_counts JOIN customer ON hub = c_custkey),
g AS (SELECT sample, gene, count(*) FILTER (cs AND hit) AS case_x, count(*) FILTER (cs) AS case_n, count(*) FILTER (NOT cs AND hit) AS ctrl_x, count(*) FILTER (NOT cs) AS ctrl_n FROM b GROUP BY ALL),
eff AS (SELECT *, ln(((case_x + 0.5) * (ctrl_n - ctrl_x + 0.5)) / ((case_n - case_x + 0.5) * (ctrl_x + 0.5))) AS lor,
  1 / (case_x + 0.5) + 1 / (case_n - case_x + 0.5) + 1 / (ctrl_x + 0.5) + 1 / (ctrl_n - ctrl_x + 0.5) AS var FROM g)"""


def _effects(spark, folder):
    c = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("hub"), F.col("c_mktsegment").alias("sample"), (F.col("c_nationkey") < 12).alias("cs"))
    rows = T.hub_counts(spark, folder).join(c, "hub").withColumn("hit", F.col("n") >= 4)
    return S.stratum_effects(rows, "sample", "gene", "cs", "hit")


@query("stratum_log_odds", f"WITH {T.HUB}, {META} SELECT sample, gene, case_x, case_n, ctrl_x, ctrl_n, round(lor, 6) AS lor, round(var, 6) AS var FROM eff", ("PRJ30", "ST11", "ST12"))
def stratum_log_odds(spark, folder):
    return _effects(spark, folder).withColumn("lor", F.round("lor", 6)).withColumn("var", F.round("var", 6))


@query("meta_log_odds", f"""WITH {T.HUB}, {META} SELECT gene, round(sum(lor / var) / sum(1 / var), 6) AS meta_lor, round(1 / sum(1 / var), 6) AS meta_var,
round(sum(lor / var) / sqrt(sum(1 / var)), 6) AS z, count(*) AS n_samples FROM eff GROUP BY 1""", ("ST9", "ST11", "ST12"))
def meta_log_odds(spark, folder):
    return S.fixed_effect(_effects(spark, folder), "gene").select("gene", *r6("meta_lor", "meta_var", "z"), "n_samples")


@query("meta_p_values", None, ("ST9",))
def meta_p_values(spark, folder):
    return K.bh_fdr(S.fixed_effect(_effects(spark, folder), "gene"), "p", "gene").select("gene", *r6("p", "q"))


@query("signflip_exact", f"""WITH {T.HUB}, {META}, s AS (SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS k FROM (SELECT DISTINCT sample FROM eff)),
o AS (SELECT gene, sum(lor / var) / sqrt(sum(1 / var)) AS obs, count(*) AS n FROM eff GROUP BY 1),
m AS (SELECT gene, mask, sum(CASE WHEN (mask >> k) & 1 = 1 THEN -1 ELSE 1 END * lor / var) / sqrt(sum(1 / var)) AS z FROM eff JOIN s USING (sample), (SELECT unnest(range(0, 32)) AS mask) GROUP BY ALL)
SELECT gene, max(n) AS n_samples, round(count(*) FILTER (abs(z) >= abs(obs) - 1e-9) / 32.0, 6) AS p FROM m JOIN o USING (gene) GROUP BY 1""", ("ST10",))
def signflip_exact(spark, folder):
    return S.sign_flip(_effects(spark, folder), "gene", "sample").withColumn("p", F.round("p", 6))


@query("matched_case_control", """WITH c AS (SELECT c_nationkey AS k, c_acctbal > 4000 AS cs, count(*) AS n FROM customer GROUP BY ALL),
m AS (SELECT k, coalesce(min(n) FILTER (cs), 0) AS a, coalesce(min(n) FILTER (NOT cs), 0) AS b FROM c GROUP BY 1)
SELECT c.k, c.cs, least(a, b) AS n FROM c JOIN m USING (k) WHERE least(a, b) > 0""", ("JN25", "SRT14"))
def matched_case_control(spark, folder):
    c = T.table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), (F.col("c_acctbal") > 4000).alias("cs"))
    return S.matched_sample(c, ["k"], "cs", "c_custkey", seed=9).groupBy("k", "cs").agg(F.count(F.lit(1)).alias("n"))


@query("nmi", """WITH c AS (SELECT c_nationkey AS a, c_mktsegment AS b, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c),
ra AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1)
SELECT round((SELECT sum(n / t * ln(n * t / (na * nb))) FROM c JOIN ra USING (a) JOIN rb USING (b), t) / (((SELECT -sum(na / t * ln(na / t)) FROM ra, t) + (SELECT -sum(nb / t * ln(nb / t)) FROM rb, t)) / 2), 9) AS nmi""", ("ST18",))
def nmi(spark, folder):
    c = T.table(spark, folder, "customer").select(F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b"))
    return S.nmi(c, "a", "b").select(F.round("nmi", 9).alias("nmi"))


# ---------------------------------------------------------------- pairs on hubs
SLOTS = "slots AS (SELECT o_orderkey AS slot, o_custkey AS hub, o_orderstatus AS m1, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'P' WHEN '2' THEN 'F' ELSE 'O' END AS m2 FROM orders)"
STRATUM = "st AS (SELECT * FROM slots WHERE hub IN (SELECT hub FROM slots GROUP BY 1 HAVING count(*) = 8))"


def _slots(spark, folder):
    digit = F.substring("o_orderpriority", 1, 1)
    return T.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("slot"), F.col("o_custkey").alias("hub"), F.col("o_orderstatus").alias("m1"),
        F.when(digit == "1", "P").when(digit == "2", "F").otherwise("O").alias("m2"),
    )


@query("exact_k_stratum", f"WITH {SLOTS}, {STRATUM} SELECT slot, hub, m1, m2 FROM st", ("AGG48",))
def exact_k_stratum(spark, folder):
    return S.exact_k(_slots(spark, folder), "hub", 8).select("slot", "hub", "m1", "m2")


PRES = """mk AS (SELECT hub, m, count(*) AS c FROM (SELECT hub, m1 AS m FROM st UNION ALL SELECT hub, m2 FROM st WHERE m1 <> m2) GROUP BY ALL),
lb AS (SELECT hub, least(m1, m2) AS a, greatest(m1, m2) AS b, count(*) AS same FROM st GROUP BY ALL)"""


@query("pair_presence", f"""WITH {SLOTS}, {STRATUM}, {PRES} SELECT x.m AS a, y.m AS b, count(*) AS value FROM mk x JOIN mk y ON x.hub = y.hub AND x.m <= y.m
LEFT JOIN lb ON lb.hub = x.hub AND lb.a = x.m AND lb.b = y.m WHERE CASE WHEN x.m = y.m THEN x.c >= 2 ELSE x.c * y.c - coalesce(same, 0) > 0 END GROUP BY ALL""", ("AGG46",))
def pair_presence(spark, folder):
    return S.pair_presence(S.exact_k(_slots(spark, folder), "hub", 8), "hub", "slot", ("m1", "m2"))


@query("homo_presence", f"""WITH {SLOTS}, {STRATUM}, h AS (SELECT hub, m1 AS m, count(*) AS c FROM st WHERE m1 = m2 GROUP BY ALL)
SELECT x.m AS a, y.m AS b, count(*) AS value FROM h x JOIN h y ON x.hub = y.hub AND (x.m < y.m OR (x.m = y.m AND x.c >= 2)) GROUP BY ALL""", ("AGG47",))
def homo_presence(spark, folder):
    return S.homo_presence(S.exact_k(_slots(spark, folder), "hub", 8), "hub", ("m1", "m2"))


@query("slot_shuffle_null", None, ("SRT9", "SRT10", "ST14"))
def slot_shuffle_null(spark, folder):
    st = S.exact_k(_slots(spark, folder), "hub", 8).withColumn("label", F.struct("m1", "m2")).select("slot", "hub", "label")
    perm = S.shuffle_labels(st, "slot", "label", 50, seed=3).select("perm", "hub", "slot", "label.m1", "label.m2")
    null = S.pair_presence(perm, "hub", "slot", ("m1", "m2"), ["perm"]).select("perm", F.concat_ws("/", "a", "b").alias("pair"), "value")
    observed = S.pair_presence(st.select("hub", "slot", "label.*"), "hub", "slot", ("m1", "m2")).select(F.concat_ws("/", "a", "b").alias("pair"), "value")
    t = S.empirical_tails(*S.whole_null(null, observed, "pair", 50), "pair")
    return t.select("pair", "observed", *r6("null_median", "p_enrich", "p_deplete", "p_two_sided"))


NULLS = "nul AS (SELECT l_suppkey AS k, CAST(l_quantity AS DOUBLE) AS v FROM lineitem), ob AS (SELECT s_suppkey AS k, CAST(s_nationkey * 2 AS DOUBLE) AS o FROM supplier)"


@query("empirical_tails", f"""WITH {NULLS}, g AS (SELECT k, count(*) AS n, max(o) AS observed, count(*) FILTER (v >= o) AS ge, count(*) FILTER (v <= o) AS le, count(*) FILTER (v < o) AS lt,
  quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.025) AS q1, quantile_cont(v, 0.975) AS q2, avg(v) AS m, stddev_samp(v) AS s FROM nul JOIN ob USING (k) GROUP BY 1)
SELECT k, observed, round(med, 6) AS null_median, round(q1, 6) AS null_q025, round(q2, 6) AS null_q975, round(observed / med, 6) AS lift, round((1 + ge) / CAST(n + 1 AS DOUBLE), 6) AS p_enrich,
  round((1 + le) / CAST(n + 1 AS DOUBLE), 6) AS p_deplete, round((1 + lt) / CAST(n + 1 AS DOUBLE), 6) AS rank_percentile, round((observed - m) / s, 6) AS z FROM g""", ("ST14",))
def empirical_tails(spark, folder):
    null = T.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("value"))
    ob = T.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") * 2).cast("double").alias("value"))
    return S.empirical_tails(null, ob, "k").select("k", "observed", *r6("null_median", "null_q025", "null_q975", "lift", "p_enrich", "p_deplete", "rank_percentile", "z"))


@query("neighbourhood_z", None, ("ST15",))
def neighbourhood_z(spark, folder):
    p = T.points(spark, folder, 2)
    near = N.knn(p, 6, XY, include_self=True)
    labels = p.select("node_id", (F.col("label") % 3).alias("label"))
    perm = S.shuffle_labels(labels, "node_id", "label", 20, seed=1)
    null = S.neighbourhood_events(near, perm, ["perm"]).select("perm", F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string")).alias("pair"), "value")
    obs = S.neighbourhood_events(near, labels).select(F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string")).alias("pair"), "value")
    return S.empirical_tails(*S.whole_null(null, obs, "pair", 20), "pair").select("pair", "observed", *r6("z", "p_enrich"))


@query("sample_gene_summary", f"""WITH {T.HUB}, s AS (SELECT c_mktsegment AS sample, gene, avg(n) AS m FROM hub_counts JOIN customer ON hub = c_custkey GROUP BY ALL)
SELECT gene, count(DISTINCT sample) AS n_samples, round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(min(m), 6) AS lowest, round(max(m), 6) AS highest, round(sum(m), 6) AS total FROM s GROUP BY 1""", ("AGG42", "AGG45"))
def sample_gene_summary(spark, folder):
    c = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("hub"), F.col("c_mktsegment").alias("sample"))
    s = T.hub_counts(spark, folder).join(c, "hub").groupBy("sample", "gene").agg(F.avg("n").alias("m"))
    return s.groupBy("gene").agg(
        F.countDistinct("sample").alias("n_samples"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.median("m"), 6).alias("median"),
        F.round(F.min("m"), 6).alias("lowest"), F.round(F.max("m"), 6).alias("highest"), F.round(F.sum("m"), 6).alias("total"),
    )


@query("run_summaries", """WITH r AS (SELECT o_custkey % 7 AS run, o_orderstatus AS part, avg(o_totalprice) AS m, count(DISTINCT o_custkey) AS u FROM orders GROUP BY ALL)
SELECT a.run, round(a.m, 4) AS train, round(b.m, 4) AS heldout, round(b.m - a.m, 4) AS gap, a.u AS n_train FROM r a JOIN r b ON a.run = b.run AND a.part = 'F' AND b.part = 'O'""", ("AGG30", "JN24", "SNK13", "SRC16"))
def run_summaries(spark, folder):
    o = T.table(spark, folder, "orders").select((F.col("o_custkey") % 7).alias("run"), "o_custkey", "o_orderstatus", "o_totalprice")
    r = o.groupBy("run", "o_orderstatus").agg(F.avg("o_totalprice").alias("m"), F.countDistinct("o_custkey").alias("u"))
    a = r.where("o_orderstatus = 'F'").select("run", F.col("m").alias("train"), F.col("u").alias("n_train"))
    b = r.where("o_orderstatus = 'O'").select("run", F.col("m").alias("heldout"))
    j = a.join(b, "run").withColumn("gap", F.col("heldout") - F.col("train"))
    return j.select("run", *[F.round(c, 4).alias(c) for c in ("train", "heldout", "gap")], "n_train")


@query("trust_fields", """SELECT event_id, CASE WHEN regexp_matches(trim(split_part(props, ':', 2)), '^[0-9]+\\}$') THEN CAST(regexp_extract(props, ': ([0-9]+)', 1) AS DOUBLE) ELSE 0.0 END AS trust,
CASE WHEN event_type IN ('view', 'error') THEN '' ELSE event_type END AS part FROM events""", ("PRJ26", "PRJ27"))
def trust_fields(spark, folder):
    e = T.table(spark, folder, "events")
    raw = F.regexp_replace(F.split("props", ":")[1], r"[ }]", "")
    cell = F.element_at(F.split(F.concat_ws(";", F.when(F.col("event_type").isin("view", "error"), F.lit("nan")).otherwise(F.col("event_type")), F.lit("x")), ";"), 1)
    return e.select("event_id", F.coalesce(raw.try_cast("double"), F.lit(0.0)).alias("trust"), F.when(F.lower(cell).isin("nan", "none", "<na>"), "").otherwise(cell).alias("part"))


@query("complexity_bins", f"WITH {T.HUB}, c AS (SELECT hub, count(*) AS k FROM hub_counts GROUP BY 1) SELECT least(k // 8, 6) AS bin, count(*) AS n FROM c GROUP BY 1", ("PRJ31",))
def complexity_bins(spark, folder):
    c = T.hub_counts(spark, folder).groupBy("hub").agg(F.count(F.lit(1)).alias("k"))
    return c.groupBy(F.least(F.floor(F.col("k") / 8), F.lit(6)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
