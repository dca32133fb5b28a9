"""Catalog: edge tables, pruning, coarsening, labels, cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.core.catalog import query
from loomgraph.operators import components as C
from loomgraph.operators import cuts
from loomgraph.operators import graph as G
from loomgraph.operators import knn as N
from loomgraph.plans.queries_pairs import BASE, COMP, _graph, filter_sql
from loomgraph.sources import tables as T

XY = ("x0", "x1")


@query("bipartite_reindex", f"""WITH {T.EDGES}, a AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS i FROM (SELECT DISTINCT src FROM edges)),
b AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1 + (SELECT count(*) FROM a) AS j FROM (SELECT DISTINCT dst FROM edges))
SELECT src, dst, i, j, w FROM edges JOIN a USING (src) JOIN b USING (dst)""", ("GR5", "SRC8", "T19", "T20"))
def bipartite_reindex(spark, folder):
    _, e = G.reindex_bipartite(T.edges(spark, folder))
    return e.select("src", "dst", "i", "j", "w")


SYM = """shift AS (SELECT max(src) + 1 AS s FROM edges), half AS (SELECT src AS i, dst + s AS j, w FROM edges, shift),
sym AS (SELECT i, j, w FROM half UNION ALL SELECT j, i, w FROM half)"""


def _sym(spark, folder):
    return G.both_ways(C.bipartite_nodes(T.edges(spark, folder), "src", "dst"), "i", "j")


@query("symmetrised_degree", f"WITH {T.EDGES}, {SYM} SELECT i, sum(w) AS degree, count(*) AS n_nbr FROM sym GROUP BY 1", ("GR6", "SRC9"))
def symmetrised_degree(spark, folder):
    return G.degrees(_sym(spark, folder))


@query("row_normalised", f"""WITH {T.EDGES}, {SYM}, d AS (SELECT i, sum(w) AS d FROM sym GROUP BY 1)
SELECT i, j, round(w / d, 9) AS w FROM sym JOIN d USING (i)""", ("GR6",))
def row_normalised(spark, folder):
    return G.row_normalise(_sym(spark, folder)).select("i", "j", F.round("w", 9).alias("w"))


TOPK = "ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS pos FROM sym)"


@query("topk_prune", f"WITH {T.EDGES}, {SYM}, {TOPK} SELECT i, j, w, pos FROM ranked WHERE pos <= 5", ("WIN16",))
def topk_prune(spark, folder):
    return G.top_k(_sym(spark, folder), 5)


CUM = f"""{TOPK}, tot AS (SELECT i, sum(w) AS row_sum FROM sym GROUP BY 1),
acc AS (SELECT r.*, row_sum, coalesce(sum(w) OVER (PARTITION BY i ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ranked r JOIN tot USING (i) WHERE pos <= 8),
pruned AS (SELECT i, j, w, pos FROM acc WHERE b < 0.3 * row_sum OR pos <= 2)"""
UNION_MAX = "um AS (SELECT i, j, max(w) AS w FROM (SELECT i, j, w FROM pruned UNION ALL SELECT j, i, w FROM pruned) GROUP BY ALL)"


@query("cumweight_prune", f"WITH {T.EDGES}, {SYM}, {CUM} SELECT i, j, w, pos FROM pruned", ("WIN17",))
def cumweight_prune(spark, folder):
    return G.cumulative_prune(_sym(spark, folder), 0.3, 8, 2).select("i", "j", "w", "pos")


@query("union_max_symmetrise", f"WITH {T.EDGES}, {SYM}, {CUM}, {UNION_MAX} SELECT i, j, w FROM um", ("GR12", "SET7"))
def union_max_symmetrise(spark, folder):
    return G.prune_with_slack(_sym(spark, folder), 8, 0.3, 2)[0]


@query("prune_slack", f"""WITH {T.EDGES}, {SYM}, {CUM}, {UNION_MAX}, k AS (SELECT i, sum(w) AS kept FROM um GROUP BY 1)
SELECT i, greatest(row_sum - coalesce(kept, 0), 0) AS slack FROM tot LEFT JOIN k USING (i)""", ("GR12",))
def prune_slack(spark, folder):
    return G.prune_with_slack(_sym(spark, folder), 8, 0.3, 2)[1]


DIRECTED = "directed AS (SELECT c_custkey AS i, o_orderkey % 1500 AS j, CAST(count(*) AS DOUBLE) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def _directed(spark, folder):
    return T.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("i"), (F.col("o_orderkey") % 1500).alias("j")).agg(F.count(F.lit(1)).cast("double").alias("w"))


def _sym_sql(value):
    return f"WITH {DIRECTED} SELECT i, j, {value} AS w FROM (SELECT i, j, w FROM directed UNION ALL SELECT j, i, w FROM directed) WHERE i <> j GROUP BY ALL"


@query("symmetrise_sum", _sym_sql("sum(w)"), ("SET7", "GR31"))
def symmetrise_sum(spark, folder):
    return G.symmetrise(_directed(spark, folder), "sum")


@query("symmetrise_max", _sym_sql("max(w)"), ("SET7",))
def symmetrise_max(spark, folder):
    return G.symmetrise(_directed(spark, folder), "max")


@query("symmetrise_mean", _sym_sql("sum(w) / 2"), ("SET7", "GR31"))
def symmetrise_mean(spark, folder):
    return G.symmetrise(_directed(spark, folder), "mean")


@query("link_list", f"WITH {T.EDGES}, {SYM} SELECT CAST(i + 1 AS VARCHAR) || ' ' || CAST(j + 1 AS VARCHAR) || ' ' || CAST(w AS VARCHAR) AS value FROM sym WHERE i < j", ("SNK10",))
def link_list(spark, folder):
    return G.link_list(_sym(spark, folder))


# ---------------------------------------------------------------- labels
@query("split_labels_by_component", f"""WITH RECURSIVE {BASE}, {filter_sql(5, 2, 2)}, shift AS (SELECT max(umi0) + 1 AS s FROM filtered),
half0 AS (SELECT umi0 AS a, umi1 + s AS b FROM filtered, shift),
lab AS (SELECT DISTINCT node AS node_id, CASE WHEN node % 7 = 0 THEN -1 ELSE node % 2 END AS label FROM (SELECT a AS node FROM half0 UNION ALL SELECT b FROM half0)),
half AS (SELECT a, b FROM half0 JOIN lab x ON x.node_id = a JOIN lab y ON y.node_id = b WHERE x.label = y.label AND x.label >= 0),
sym AS MATERIALIZED (SELECT a, b FROM half UNION SELECT b, a FROM half UNION SELECT node_id, node_id FROM lab WHERE label >= 0),
prop(it, node, comp) AS (SELECT 0, a, a FROM sym WHERE a = b
  UNION ALL SELECT p.it + 1, s.a, min(p.comp) FROM prop p JOIN sym s ON s.b = p.node WHERE p.it < 40 GROUP BY p.it, s.a),
pieces AS (SELECT node AS node_id, comp, label, count(*) OVER (PARTITION BY comp) AS c FROM prop JOIN lab ON node_id = node WHERE it = 40),
num AS (SELECT node_id, dense_rank() OVER (ORDER BY label, comp) - 1 AS nl FROM pieces WHERE c >= 2)
SELECT node_id, coalesce(nl, -1) AS label FROM lab LEFT JOIN num USING (node_id)""", ("GR9",))
def split_labels_by_component(spark, folder):
    e = _graph(spark, folder, 5, 2, 2)
    nodes = e.select(F.col("i").alias("node_id")).unionByName(e.select(F.col("j").alias("node_id"))).distinct()
    labels = nodes.withColumn("label", F.when(F.col("node_id") % 7 == 0, -1).otherwise(F.col("node_id") % 2).cast("long"))
    return C.within_label_components(e, labels, "i", "j", min_size=2)


VOTE_GRAPH = """shift AS (SELECT max(l_suppkey) + 1 AS s FROM lineitem),
nb AS MATERIALIZED (SELECT DISTINCT l_suppkey AS a, l_partkey + s AS b FROM lineitem, shift),
both_ways AS MATERIALIZED (SELECT a, b FROM nb UNION SELECT b, a FROM nb),
lab AS (SELECT p_partkey + s AS node_id, CASE WHEN p_size > 40 THEN -1 ELSE CASE WHEN p_size > 12 THEN 0 ELSE 1 END END AS label FROM part, shift
  UNION ALL SELECT s_suppkey, -1 FROM supplier)"""


@query("noise_majority_vote", f"""WITH RECURSIVE {VOTE_GRAPH},
st(it, node_id, label) AS (SELECT 0, node_id, label FROM lab UNION ALL
  SELECT s.it + 1, s.node_id, CASE WHEN s.label = -1 THEN coalesce(v.label, -1) ELSE s.label END FROM (SELECT * FROM st) s LEFT JOIN (
    SELECT a, label FROM (SELECT a, label, n, sum(n) OVER (PARTITION BY a) AS t FROM (
      SELECT bw.a, z.label, count(*) AS n FROM both_ways bw JOIN st z ON z.node_id = bw.b WHERE z.label >= 0 GROUP BY bw.a, z.label) q1) q2 WHERE n > 0.5 * t) v
  ON v.a = s.node_id WHERE s.it < 6)
SELECT node_id, label FROM st WHERE it = 6""", ("GR10",))
def noise_majority_vote(spark, folder):
    li = T.table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct()
    shift = li.agg((F.max("l_suppkey") + 1).alias("s"))
    e = li.join(F.broadcast(shift)).select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + F.col("s")).alias("dst"))
    lab = F.when(F.col("p_size") > 40, -1).when(F.col("p_size") > 12, 0).otherwise(1).cast("long")
    p = T.table(spark, folder, "part").join(F.broadcast(shift)).select((F.col("p_partkey") + F.col("s")).alias("node_id"), lab.alias("label"))
    s = T.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("node_id"), F.lit(-1).cast("long").alias("label"))
    return C.curate_noise(e, p.unionByName(s))[0]


@query("relabel_contiguous", "SELECT p_partkey AS node_id, CASE WHEN p_size > 40 THEN -1 ELSE dense_rank() OVER (ORDER BY CASE WHEN p_size > 40 THEN 999 ELSE p_size * 3 % 50 END) - 1 END AS label FROM part", ("GR11",))
def relabel_contiguous(spark, folder):
    p = T.table(spark, folder, "part")
    return C.relabel_contiguous(p.select(F.col("p_partkey").alias("node_id"), F.when(F.col("p_size") > 40, -1).otherwise(F.col("p_size") * 3 % 50).cast("long").alias("label")))


def _kcore_sql(k, rounds=12):
    out = ["k0 AS MATERIALIZED (SELECT i, j, w FROM sym)"]
    for r in range(1, rounds + 1):
        out.append(f"d{r} AS MATERIALIZED (SELECT i FROM k{r - 1} GROUP BY i HAVING sum(w) >= {k})")
        out.append(f"k{r} AS MATERIALIZED (SELECT * FROM k{r - 1} WHERE i IN (FROM d{r}) AND j IN (FROM d{r}))")
    return ", ".join(out) + f" SELECT DISTINCT i AS node_id FROM k{rounds}"


@query("kcore_mask", f"WITH {T.EDGES}, {SYM}, {_kcore_sql(118)}", ("GR22", "JN27"))
def kcore_mask(spark, folder):
    e = C.bipartite_nodes(T.edges(spark, folder), "src", "dst").select(F.col("i").alias("src"), F.col("j").alias("dst"), "w")
    return C.kcore(e, 118.0, "w")[0]


# ---------------------------------------------------------------- coarsening
MEMBER = "member AS (SELECT s_suppkey AS node_id, CAST(s_nationkey AS BIGINT) AS super FROM supplier UNION ALL SELECT p_partkey + s, CAST(p_size + 100 AS BIGINT) FROM part, shift)"


def _member(spark, folder):
    s = T.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").cast("long").alias("super"))
    shift = T.table(spark, folder, "lineitem").agg((F.max("l_suppkey") + 1).alias("s"))
    p = T.table(spark, folder, "part").join(F.broadcast(shift)).select((F.col("p_partkey") + F.col("s")).alias("node_id"), (F.col("p_size") + 100).cast("long").alias("super"))
    return s.unionByName(p)


@query("coarsen_graph", f"""WITH {T.EDGES}, {SYM}, {MEMBER} SELECT a.super AS si, b.super AS sj, sum(w) AS w FROM sym
JOIN member a ON a.node_id = i JOIN member b ON b.node_id = j WHERE a.super <> b.super GROUP BY ALL""", ("AGG26", "GR30"))
def coarsen_graph(spark, folder):
    return G.coarsen(_sym(spark, folder), _member(spark, folder))


@query("coarsen_counts", f"""WITH {T.HUB} SELECT CAST(c_nationkey AS BIGINT) AS super, gene, count(*) AS n FROM hub_counts JOIN customer ON hub = c_custkey WHERE n >= 2 GROUP BY ALL""", ("AGG27",))
def coarsen_counts(spark, folder):
    m = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").cast("long").alias("super"))
    x = T.hub_counts(spark, folder).where("n >= 2").withColumn("n", F.lit(1).cast("long"))
    return G.coarsen_counts(x, m, "hub", "gene", "n")


@query("supernode_centroids", f"WITH {T.points_sql(3)} SELECT label AS super, round(avg(x0), 9) AS x0, round(avg(x1), 9) AS x1, round(avg(x2), 9) AS x2, count(*) AS n FROM points GROUP BY 1", ("AGG28",))
def supernode_centroids(spark, folder):
    p = T.points(spark, folder, 3)
    c = G.centroids(p.drop("label"), p.select("node_id", F.col("label").alias("super")), ("x0", "x1", "x2"))
    return c.select("super", *[F.round(x, 9).alias(x) for x in ("x0", "x1", "x2")], "n")


@query("supernodes_min_size", f"""WITH {T.points_sql(2)}, b AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS super FROM points GROUP BY label HAVING count(*) >= 49)
SELECT node_id, super FROM points JOIN b USING (label)""", ("AGG29",))
def supernodes_min_size(spark, folder):
    return G.supernodes(T.points(spark, folder, 2).select("node_id", "label"), 49)


@query("final_coarsening", f"""WITH {T.HUB}, {T.EDGES}, m AS (SELECT s_suppkey AS src, CAST(s_nationkey AS BIGINT) AS a FROM supplier),
k AS (SELECT p_partkey AS dst, CAST(p_size AS BIGINT) AS b FROM part)
SELECT a, b, sum(w) AS w, count(*) AS n_fine FROM edges JOIN m USING (src) JOIN k USING (dst) GROUP BY ALL""", ("GR25", "GR30"))
def final_coarsening(spark, folder):
    from loomgraph.core.skew import lookup

    m = T.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("a"))
    k = T.table(spark, folder, "part").select(F.col("p_partkey").alias("dst"), F.col("p_size").cast("long").alias("b"))
    e = lookup(lookup(T.edges(spark, folder), m, "src"), k, "dst")
    return e.groupBy("a", "b").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n_fine"))


# ---------------------------------------------------------------- geometry on graphs
KNN5 = """near AS (SELECT a.node_id, b.node_id AS nbr, row_number() OVER (PARTITION BY a.node_id ORDER BY (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1), b.node_id) AS rank,
  sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) AS dist FROM points a JOIN points b ON a.node_id <> b.node_id QUALIFY rank <= 5)"""
KGRAPH = "kg AS (SELECT i, j, max(w) AS w FROM (SELECT node_id AS i, nbr AS j, 1.0 / rank AS w FROM near UNION ALL SELECT nbr, node_id, 1.0 / rank FROM near) GROUP BY ALL)"
GEO = f"{T.points_sql(2)}, {KNN5}, {KGRAPH}"


def _kgraph(spark, folder):
    p = T.points(spark, folder, 2)
    near = N.knn(p, 5, XY)
    return p, G.symmetrise(near.select(F.col("node_id").alias("i"), F.col("nbr").alias("j"), (1.0 / F.col("rank")).alias("w")), "max")


@query("transport_neglog_distance", f"""WITH {GEO}, s AS (SELECT i, sum(w) AS s FROM kg GROUP BY 1)
SELECT kg.i, kg.j, round(greatest(-ln(w / sqrt(a.s * b.s)), 0), 6) AS dist FROM kg JOIN s a ON a.i = kg.i JOIN s b ON b.i = kg.j""", ("GR17",))
def transport_neglog_distance(spark, folder):
    _, g = _kgraph(spark, folder)
    return G.transport_distance(g).select("i", "j", F.round("dist", 6).alias("dist"))


@query("adaptive_gaussian_weights", f"""WITH {GEO}, e AS (SELECT kg.*, (a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 AS d2 FROM kg JOIN points a ON a.node_id = i JOIN points b ON b.node_id = j),
s AS (SELECT i, sum(w * d2) / sum(w) AS s2 FROM e GROUP BY 1)
SELECT e.i, e.j, round(w * exp(-ln(0.5 * (p.s2 + q.s2)) - d2 / (0.5 * (p.s2 + q.s2))), 6) AS w FROM e JOIN s p ON p.i = e.i JOIN s q ON q.i = e.j""", ("GR19",))
def adaptive_gaussian_weights(spark, folder):
    p, g = _kgraph(spark, folder)
    return G.adaptive_gaussian(g, p, XY).select("i", "j", F.round("w", 6).alias("w"))


@query("fallback_knn_edges", f"""WITH {GEO}, sp AS (SELECT i, j, w FROM kg WHERE w > 0.9), d AS (SELECT i, count(*) AS have, min(w) AS low FROM sp GROUP BY 1),
c AS (SELECT node_id AS i, nbr AS j, low, have, row_number() OVER (PARTITION BY node_id ORDER BY rank) AS p FROM near LEFT JOIN d ON d.i = node_id
  WHERE coalesce(have, 0) < 3 AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.i = node_id AND sp.j = nbr))
SELECT i, j, round(coalesce(low, 1) * 0.01, 9) AS w FROM c WHERE p <= 3 - coalesce(have, 0)""", ("GR18",))
def fallback_knn_edges(spark, folder):
    p, g = _kgraph(spark, folder)
    out = G.fallback_edges(g.where("w > 0.9"), N.knn(p, 5, XY), 3, 0.01)
    return out.select("i", "j", F.round("w", 9).alias("w"))


@query("final_coarse_flow", f"""WITH RECURSIVE {GEO}, {T.HUB}, labels AS (SELECT node_id, CASE WHEN node_id % 11 = 0 THEN -1 ELSE label * 40 + node_id % 37 END AS label FROM points),
b AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS super, count(*) AS size FROM labels WHERE label >= 0 GROUP BY label), member AS (SELECT node_id, super FROM labels JOIN b USING (label)),
links AS (SELECT i, j, w FROM kg WHERE w > 0.9 AND abs(i - j) % 2 = 0), tot AS (SELECT i, sum(w) AS s FROM kg GROUP BY 1), tr AS (SELECT i, j, w / s AS w FROM kg JOIN tot USING (i)),
lc AS (SELECT a.super AS si, c.super AS sj, sum(w) AS w FROM links JOIN member a ON a.node_id = i JOIN member c ON c.node_id = j WHERE a.super <> c.super GROUP BY ALL),
pc AS (SELECT a.super AS si, c.super AS sj, sum(w) AS w FROM tr JOIN member a ON a.node_id = i JOIN member c ON c.node_id = j WHERE a.super <> c.super GROUP BY ALL),
ends AS MATERIALIZED (SELECT si AS a, sj AS b FROM lc UNION SELECT sj, si FROM lc UNION SELECT super, super FROM b),
prop(it, node, comp) AS (SELECT 0, a, a FROM ends WHERE a = b UNION ALL SELECT p.it + 1, e.a, min(p.comp) FROM prop p JOIN ends e ON e.b = p.node WHERE p.it < 100 GROUP BY p.it, e.a),
comp AS (SELECT node AS super, comp FROM prop WHERE it = 100), top AS (SELECT comp FROM comp JOIN b USING (super) GROUP BY comp ORDER BY sum(size) DESC, comp LIMIT 1),
kept AS (SELECT super, row_number() OVER (ORDER BY super) - 1 AS pos, size FROM comp JOIN top USING (comp) JOIN b USING (super)),
cen AS (SELECT pos, avg(x0) AS x0, avg(x1) AS x1 FROM points JOIN member USING (node_id) JOIN kept USING (super) GROUP BY 1)
SELECT 'link' AS part, a.pos AS i, CAST(c.pos AS VARCHAR) AS j, round(w, 6) AS w FROM lc JOIN kept a ON a.super = si JOIN kept c ON c.super = sj
UNION ALL SELECT 'transport', a.pos, CAST(c.pos AS VARCHAR), round(w, 6) FROM pc JOIN kept a ON a.super = si JOIN kept c ON c.super = sj
UNION ALL SELECT 'super', pos, CAST(super AS VARCHAR), CAST(size AS DOUBLE) FROM kept
UNION ALL SELECT 'centroid', pos, 'x0', round(x0, 6) FROM cen UNION ALL SELECT 'centroid', pos, 'x1', round(x1, 6) FROM cen
UNION ALL SELECT 'count', pos, gene, CAST(count(*) AS DOUBLE) FROM hub_counts JOIN member ON hub = node_id JOIN kept USING (super) WHERE n >= 2 GROUP BY ALL""", ("GR25", "AGG26", "AGG27", "AGG28", "AGG29", "GR8"))
def final_coarse_flow(spark, folder):
    from loomgraph.operators.coarse import coarse_flow

    p, g = _kgraph(spark, folder)
    labels = p.select("node_id", F.when(F.col("node_id") % 11 == 0, -1).otherwise(F.col("label") * 40 + F.col("node_id") % 37).cast("long").alias("label"))
    links = g.where((F.col("w") > 0.9) & (F.abs(F.col("i") - F.col("j")) % 2 == 0))
    counts = T.hub_counts(spark, folder).withColumnRenamed("hub", "node_id")
    flow = coarse_flow(labels, links, G.row_normalise(g).select("i", "j", "w"), p.select("node_id", *XY), XY, counts, 2)
    text, value = F.col("j").cast("string").alias("j"), F.round("w", 6).alias("w")
    out = flow.links.select(F.lit("link").alias("part"), "i", text, value)
    out = out.unionByName(flow.transport.select(F.lit("transport").alias("part"), "i", text, value))
    out = out.unionByName(flow.index.select(F.lit("super").alias("part"), "i", F.col("super").cast("string").alias("j"), F.col("size").cast("double").alias("w")))
    for x in XY:
        out = out.unionByName(flow.centroids.select(F.lit("centroid").alias("part"), "i", F.lit(x).alias("j"), F.round(x, 6).alias("w")))
    return out.unionByName(flow.counts.select(F.lit("count").alias("part"), "i", F.col("gene").alias("j"), F.col("n").cast("double").alias("w")))


@query("fallback_distances", f"""WITH RECURSIVE {GEO}, sp AS (SELECT i, j FROM kg WHERE w > 0.9), both_ends AS (SELECT i AS a, j AS b FROM kg UNION SELECT node_id, node_id FROM points),
prop(it, node, comp) AS (SELECT 0, a, a FROM both_ends WHERE a = b UNION ALL
  SELECT p.it + 1, s.a, min(p.comp) FROM prop p JOIN both_ends s ON s.b = p.node WHERE p.it < 60 GROUP BY p.it, s.a),
comp AS (SELECT node, comp FROM prop WHERE it = 60), have AS (SELECT i, count(*) AS have FROM sp GROUP BY 1),
c AS (SELECT node_id AS i, nbr AS j, have, row_number() OVER (PARTITION BY node_id ORDER BY rank) AS p FROM near LEFT JOIN have ON have.i = node_id
  JOIN comp a ON a.node = node_id JOIN comp b ON b.node = nbr AND a.comp = b.comp WHERE coalesce(have, 0) < 3 AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.i = node_id AND sp.j = nbr)),
added AS (SELECT i, j FROM c WHERE p <= 3 - coalesce(have, 0))
SELECT i, j, 25.0::DOUBLE * count(*) AS d FROM (SELECT i, j FROM added UNION ALL SELECT j, i FROM added) GROUP BY ALL""", ("GR18",))
def fallback_distances(spark, folder):
    p, g = _kgraph(spark, folder)
    comp = C.components(g, "i", "j", p)
    return G.fallback_distances(g.where("w > 0.9"), N.knn(p, 5, XY), 3, 25.0, comp)


@query("node_rmsd", f"""WITH {GEO}, e AS (SELECT kg.*, (a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 AS d2 FROM kg JOIN points a ON a.node_id = i JOIN points b ON b.node_id = j)
SELECT i, round(sum(w), 6) AS weighted_degree, count(*) AS degree, round(sqrt(sum(w * d2) / sum(w)), 6) AS rmsd FROM e GROUP BY 1""", ("AGG38",))
def node_rmsd(spark, folder):
    p, g = _kgraph(spark, folder)
    s = G.node_statistics(g, p, XY)
    return s.select("i", F.round("weighted_degree", 6).alias("weighted_degree"), "degree", F.round("rmsd", 6).alias("rmsd"))


@query("edge_distance_hist", f"""WITH {GEO} SELECT CAST(least(floor(sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) / 0.02), 10) AS BIGINT) AS bin, round(sum(w), 6) AS w, count(*) AS n
FROM kg JOIN points a ON a.node_id = i JOIN points b ON b.node_id = j WHERE i < j GROUP BY 1""", ("AGG38",))
def edge_distance_hist(spark, folder):
    p, g = _kgraph(spark, folder)
    h = G.distance_histogram(g.where("i < j"), p, XY, 0.02, 10)
    return h.select("bin", F.round("w", 6).alias("w"), "n")


SWEEP = """pos AS (SELECT node_id, row_number() OVER (ORDER BY x0, node_id) - 1 AS pos FROM points),
e AS (SELECT a.pos AS pi, b.pos AS pj, w FROM kg JOIN pos a ON a.node_id = i JOIN pos b ON b.node_id = j),
deg AS (SELECT pi AS pos, sum(w) AS degree, sum(CASE WHEN pj > pi THEN w ELSE -w END) AS dw, sum(CASE WHEN pj > pi THEN 1 ELSE -1 END) AS de FROM e GROUP BY 1),
run AS (SELECT node_id, pos, sum(dw) OVER o AS cw, CAST(sum(de) OVER o AS BIGINT) AS ce, sum(degree) OVER o AS lv, sum(degree) OVER () AS vol, count(*) OVER () AS n
  FROM pos JOIN deg USING (pos) WINDOW o AS (ORDER BY pos))"""


@query("sweep_conductance", f"""WITH {GEO}, {SWEEP} SELECT node_id, pos, round(cw, 6) + 0.0 AS cut_weight, ce AS cut_edges,
CASE WHEN least(lv, vol - lv) > 1e-9 AND pos + 1 >= 10 AND n - pos - 1 >= 10 THEN round(cw / least(lv, vol - lv), 6) END AS conductance FROM run""", ("GR21",))
def sweep_conductance(spark, folder):
    p, g = _kgraph(spark, folder)
    s = cuts.sweep(g, p.select("node_id", F.lit(0).alias("block"), F.col("x0").alias("score")), 10)
    return s.select("node_id", "pos", (F.round("cut_weight", 6) + 0.0).alias("cut_weight"), "cut_edges", F.round("conductance", 6).alias("conductance"))


@query("best_sweep_cut", f"""WITH {GEO}, {SWEEP}, c AS (SELECT pos, ce AS cut_edges, cw, cw / least(lv, vol - lv) AS cond FROM run WHERE pos + 1 >= 10 AND n - pos - 1 >= 10)
SELECT pos, cut_edges, round(cond, 6) AS conductance FROM c ORDER BY cond, pos LIMIT 1""", ("GR21",))
def best_sweep_cut(spark, folder):
    p, g = _kgraph(spark, folder)
    b = cuts.best_cuts(cuts.sweep(g, p.select("node_id", F.lit(0).alias("block"), F.col("x0").alias("score")), 10))
    return b.select("pos", "cut_edges", F.round("conductance", 6).alias("conductance"))


@query("two_hop_apply", f"""WITH {GEO}, y1 AS (SELECT j AS node_id, sum(w * x0) AS y FROM kg JOIN points ON node_id = i GROUP BY 1),
y2 AS (SELECT i AS node_id, sum(w * y) AS y FROM kg JOIN y1 ON y1.node_id = j GROUP BY 1), y3 AS (SELECT i AS node_id, sum(w * y) AS y FROM kg JOIN y2 ON y2.node_id = j GROUP BY 1)
SELECT node_id, round(y, 6) AS y FROM y3""", ("GR7",))
def two_hop_apply(spark, folder):
    from loomgraph.operators.linear import apply, apply_transposed

    p, g = _kgraph(spark, folder)
    x = p.select("node_id", F.col("x0").alias("v0"))
    y = apply(g, apply(g, apply_transposed(g, x, ["v0"]), ["v0"]), ["v0"])
    return y.select("node_id", F.round("v0", 6).alias("y"))


@query("rewired_edges", None, ("GR27",))
def rewired_edges(spark, folder):
    e = T.edges(spark, folder).select(F.col("src").alias("i"), F.col("dst").alias("j"), "w")
    return G.rewire(e, 0.1, seed=5).groupBy("i").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))


@query("fused_nodes", f"""WITH {T.EDGES} SELECT CASE WHEN src % 10 = 3 THEN src - 3 ELSE src END AS i, dst AS j, sum(w) AS w FROM edges GROUP BY ALL""", ("GR28",))
def fused_nodes(spark, folder):
    e = T.edges(spark, folder).select(F.col("src").alias("i"), F.col("dst").alias("j"), "w")
    donors = T.table(spark, folder, "supplier").where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") - 3).alias("receiver"))
    return G.fuse(e, donors, "i")


@query("kg_components", f"""WITH RECURSIVE {T.points_sql(2)}, one AS (SELECT a.node_id AS i, b.node_id AS j FROM points a JOIN points b ON a.node_id <> b.node_id
  QUALIFY row_number() OVER (PARTITION BY a.node_id ORDER BY (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1), b.node_id) <= 1),
sym AS MATERIALIZED (SELECT i AS a, j AS b FROM one UNION SELECT j, i FROM one UNION SELECT node_id, node_id FROM points),
prop(it, node, comp) AS (SELECT 0, a, a FROM sym WHERE a = b
  UNION ALL SELECT p.it + 1, s.a, min(p.comp) FROM prop p JOIN sym s ON s.b = p.node WHERE p.it < 60 GROUP BY p.it, s.a)
SELECT node AS node_id, comp FROM prop WHERE it = 60""", ("GR3", "GR26"))
def kg_components(spark, folder):
    p = T.points(spark, folder, 2)
    return C.components(N.knn(p, 1, XY), "node_id", "nbr")


@query("sparsest_cut_blocks", None, ("GR20", "GR32", "LA16"))
def sparsest_cut_blocks(spark, folder):
    _, g = _kgraph(spark, folder)
    blocks = cuts.sparsest_cut_blocks(g, min_size=200, threshold=0.2)
    return blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"))


@query("map_communities", None, ("GR13", "GR23", "SRC15"))
def map_communities(spark, folder):
    from loomgraph.operators.communities import communities

    _, g = _kgraph(spark, folder)
    return communities(g, "map", rounds=3, levels=1).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("modularity_communities", None, ("GR14", "ST20"))
def modularity_communities(spark, folder):
    from loomgraph.operators.communities import communities

    _, g = _kgraph(spark, folder)
    return communities(g, "modularity", rounds=3, levels=1).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("spanning_forest", f"""WITH RECURSIVE {T.points_sql(2)}, near AS (SELECT a.node_id AS i, b.node_id AS j, sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) AS d,
  row_number() OVER (PARTITION BY a.node_id ORDER BY (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1), b.node_id) AS r FROM points a JOIN points b ON a.node_id <> b.node_id QUALIFY r <= 5),
core AS (SELECT i, max(d) AS core FROM near GROUP BY 1), e AS (SELECT least(n.i, n.j) AS i, greatest(n.i, n.j) AS j, min(greatest(d, a.core, b.core)) AS d FROM near n JOIN core a ON a.i = n.i JOIN core b ON b.i = n.j GROUP BY ALL)
SELECT count(*) - 1 AS n_edges_if_connected, (SELECT count(*) FROM e) AS n_reach FROM points""", ("GR15",))
def spanning_forest(spark, folder):
    from loomgraph.core.session import cut
    from loomgraph.operators import density as D

    reach = cut(D.mutual_reachability(T.points(spark, folder, 2), XY, 5))
    forest = D.spanning_forest(reach).agg(F.count(F.lit(1)).alias("n_edges_if_connected"))
    return forest.join(F.broadcast(reach.agg(F.count(F.lit(1)).alias("n_reach"))))


@query("density_clusters", None, ("GR15", "GR16"))
def density_clusters(spark, folder):
    from loomgraph.operators import density as D

    return D.cluster_points(T.points(spark, folder, 2), XY, 20, 5).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("transport_clusters", None, ("GR16",))
def transport_clusters(spark, folder):
    from loomgraph.operators import density as D

    p, g = _kgraph(spark, folder)
    return D.cluster_transport(g, p.select("node_id"), 20, 5)


@query("segmented_points", None, ("GR10", "GR15", "GR23"))
def segmented_points(spark, folder):
    from loomgraph.operators import density as D

    p, g = _kgraph(spark, folder)
    return D.segment(p, XY, g, "density", 20, 5)
