"""Catalog: registration of a graph on a spatial slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.core.catalog import query
from loomgraph.operators import knn as N
from loomgraph.operators import poles as P
from loomgraph.operators import registration as R
from loomgraph.operators import transport as X
from loomgraph.plans.queries_graph import GEO, XY, _kgraph
from loomgraph.plans.queries_stats import D2
from loomgraph.sources import tables as T


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


# Genes on the points: the hub counts of the same number.
def _gene_counts(spark, folder):
    p = T.points(spark, folder, 2)
    x = T.hub_counts(spark, folder).where("n >= 6").withColumnRenamed("hub", "node_id")
    return p, x.join(p.select("node_id"), "node_id", "left_semi")


FIELD = f"""{T.HUB}, {T.points_sql(2)}, det AS (SELECT hub AS node_id, gene FROM hub_counts JOIN points ON hub = node_id WHERE n >= 6),
ab AS (SELECT gene, count(*) AS abundance FROM det GROUP BY 1 HAVING count(*) >= 10),
near AS (SELECT a.node_id, b.node_id AS nbr, row_number() OVER (PARTITION BY a.node_id ORDER BY {D2}, b.node_id) AS rank FROM points a, points b QUALIFY rank <= 15),
f AS (SELECT gene, n.node_id, count(*) / 15.0 AS f, any_value(abundance) AS abundance FROM near n JOIN det d ON d.node_id = nbr JOIN ab USING (gene) GROUP BY ALL),
sc AS (SELECT sqrt((max(x0) - min(x0)) ** 2 + (max(x1) - min(x1)) ** 2) AS scale FROM points),
pk AS (SELECT gene, f AS peak_value, x0 AS px0, x1 AS px1 FROM (SELECT f.*, x0, x1, row_number() OVER (PARTITION BY gene ORDER BY f DESC, node_id) AS rn FROM f JOIN points USING (node_id)) WHERE rn = 1),
st AS (SELECT gene, any_value(abundance) AS abundance, any_value(px0) AS px0, any_value(px1) AS px1, any_value(peak_value) AS peak_value, sum(f) AS field_mass, any_value(scale) AS scale,
  sqrt(sum(f * ((x0 - px0) ** 2 + (x1 - px1) ** 2)) / (sum(f) + 1e-12)) AS spread,
  coalesce(sum(f) FILTER ((x0 - px0) ** 2 + (x1 - px1) ** 2 <= (0.15 * scale) ** 2), 0) / (sum(f) + 1e-12) AS local_mass
  FROM f JOIN points USING (node_id) JOIN pk USING (gene), sc GROUP BY gene),
stat AS (SELECT *, peak_value * local_mass / (spread / (scale + 1e-12) + 1e-12) AS locality FROM st)"""


def _fields(spark, folder):
    p, x = _gene_counts(spark, folder)
    return p, R.pole_fields(p, x, XY, 15)


@query("pole_stats", f"""WITH {FIELD} SELECT gene, abundance, round(px0, 6) AS peak_x0, round(px1, 6) AS peak_x1, round(peak_value, 6) AS peak_value, round(field_mass, 6) AS field_mass,
round(spread, 6) AS spread, round(local_mass, 6) AS local_mass, round(locality, 5) AS locality FROM stat""", ("RG1", "LA17"))
def pole_stats(spark, folder):
    p, f = _fields(spark, folder)
    s = R.pole_statistics(p, f, XY)
    return s.select("gene", "abundance", *r6("peak_x0", "peak_x1", "peak_value", "field_mass", "spread", "local_mass"), F.round("locality", 5).alias("locality"))


ANCHOR = """lr AS (SELECT *, (rank() OVER (ORDER BY round(locality, 9)) + (count(*) OVER (PARTITION BY round(locality, 9)) - 1) / 2.0) AS rk FROM stat),
sr AS (SELECT *, rk / max(rk) OVER () AS lrank FROM lr), np AS (SELECT count(*) AS n FROM points),
mom AS (SELECT gene, sum(f) / n AS m, sqrt(sum(f * f) / n - (sum(f) / n) ** 2) AS sd, n FROM f, np GROUP BY gene, n),
cr AS (SELECT a.gene AS ga, b.gene AS gb, sum(a.f * b.f) AS c FROM f a JOIN f b ON a.node_id = b.node_id AND a.gene < b.gene GROUP BY ALL),
ps AS (SELECT a.gene AS ga, b.gene AS gb, sqrt((a.px0 - b.px0) ** 2 + (a.px1 - b.px1) ** 2) / (a.scale + 1e-12) AS sep, sqrt(a.lrank * b.lrank) AS lw,
  greatest((coalesce(c, 0) / ma.n - ma.m * mb.m) / (ma.sd * mb.sd), 0) AS ov FROM sr a JOIN sr b ON a.gene < b.gene JOIN mom ma ON ma.gene = a.gene JOIN mom mb ON mb.gene = b.gene
  LEFT JOIN cr ON ga = a.gene AND gb = b.gene)"""


def _ranked(p, f):
    s = R.pole_statistics(p, f, XY).withColumn("locality", F.round("locality", 9))
    from loomgraph.core.session import cut

    return cut(R.locality_ranks(s))


@query("pole_anchor_pair", f"WITH {FIELD}, {ANCHOR} SELECT ga AS lower, gb AS upper, round(sep * lw * (1 - ov), 6) AS score FROM ps ORDER BY sep * lw * (1 - ov) DESC LIMIT 1", ("RG2", "LA18"))
def pole_anchor_pair(spark, folder):
    from loomgraph.core.session import cut

    p, f = _fields(spark, folder)
    f = cut(f)
    pick = P.anchor_pair(_ranked(p, f), f, R.field_moments(p, f), XY, first=64)
    lo, hi = sorted((pick["a"], pick["b"]))
    return spark.createDataFrame([(lo, hi, round(pick["score"], 6))], "lower string, upper string, score double")


@query("pole_pairs", None, ("RG3", "RG4", "WIN21"))
def pole_pairs(spark, folder):
    from loomgraph.core.session import cut

    # every detection of every hub, whatever its count; hubs without a point count for a gene's abundance
    p = T.points(spark, folder, 2)
    f = cut(R.pole_fields(p, T.hub_counts(spark, folder).withColumnRenamed("hub", "node_id"), XY, 15))
    pairs = P.pole_pairs(_ranked(p, f), f, R.field_moments(p, f), XY, 2, 3)
    P.check_disjoint(pairs)
    return pairs


POLES = "poles(gene, pair, side) AS (VALUES ('g1', 'p0', 'A'), ('g2', 'p0', 'A'), ('g3', 'p0', 'B'), ('g4', 'p1', 'A'), ('g5', 'p1', 'B'), ('g6', 'p1', 'B'))"


def _poles(spark):
    rows = [("G1", "p0", "A"), ("G2", "p0", "A"), ("G3", "p0", "B"), ("G4", "p1", "A"), ("G5", "p1", "B"), ("G6", "p1", "B")]
    return spark.createDataFrame(rows, "gene string, pair string, side string")


@query("pole_pair_counts", f"""WITH {T.HUB}, {POLES} SELECT hub AS node_id, pair, CAST(sum(CASE WHEN side = 'A' THEN n ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN side = 'B' THEN n ELSE 0 END) AS BIGINT) AS b
FROM hub_counts JOIN poles USING (gene) GROUP BY ALL""", ("RG8", "RG5"))
def pole_pair_counts(spark, folder):
    return R.pair_counts(T.hub_counts(spark, folder).withColumnRenamed("hub", "node_id"), _poles(spark))


@query("slice_ratio_field", f"""WITH {T.HUB}, {T.points_sql(2)}, {POLES}, c AS (SELECT hub AS node_id, sum(CASE WHEN side = 'A' THEN n ELSE 0 END) AS a, sum(CASE WHEN side = 'B' THEN n ELSE 0 END) AS b
  FROM hub_counts JOIN poles USING (gene) WHERE pair = 'p0' GROUP BY 1),
near AS (SELECT a.node_id, b.node_id AS nbr FROM points a, points b QUALIFY row_number() OVER (PARTITION BY a.node_id ORDER BY {D2}, b.node_id) <= 8),
s AS (SELECT n.node_id, avg(coalesce(a, 0)) AS sa, avg(coalesce(b, 0)) AS sb FROM near n LEFT JOIN c ON c.node_id = nbr GROUP BY 1)
SELECT node_id, round(sa + sb, 6) AS support, CASE WHEN sa + sb > 1e-12 THEN round(sa / (sa + sb + 1e-12), 6) ELSE 0.5 END AS ratio FROM s""", ("RG6",))
def slice_ratio_field(spark, folder):
    p = T.points(spark, folder, 2)
    c = R.pair_counts(T.hub_counts(spark, folder).withColumnRenamed("hub", "node_id"), _poles(spark)).where("pair = 'p0'")
    return R.smoothed_ratio(p, c.select("node_id", "a", "b"), XY, 8).select("node_id", *r6("support", "ratio"))


@query("slice_time_rows", "SELECT vec_id AS node_id, label FROM embeddings WHERE label = 3", ("SRC10", "SRC11", "SRC12", "SRC13"))
def slice_time_rows(spark, folder):
    return R.slice_rows(T.points(spark, folder, 2), "label", 3).select("node_id", F.col("label").cast("int").alias("label"))


@query("slice_time_fallback", "SELECT vec_id AS node_id, label FROM embeddings", ("SRC10",))
def slice_time_fallback(spark, folder):
    return R.slice_rows(T.points(spark, folder, 2), "label", 999).select("node_id", F.col("label").cast("int").alias("label"))


@query("slice_node_mass", """SELECT c_custkey AS node_id, round(CASE WHEN c_nationkey < 5 THEN greatest(c_acctbal, 0) ELSE coalesce(t, 0) END, 4) AS mass
FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey""", ("AGG52",))
def slice_node_mass(spark, folder):
    c = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("node_id"), F.when(F.col("c_nationkey") < 5, F.col("c_acctbal")).alias("weight"))
    t = T.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("node_id")).agg(F.sum("o_totalprice").alias("total"))
    return R.node_mass(c, t, "weight").select("node_id", F.round("mass", 4).alias("mass"))


@query("uniform_capacities", """WITH c AS (SELECT c_custkey AS node_id, row_number() OVER (ORDER BY c_custkey) AS rn, count(*) OVER () AS n FROM customer)
SELECT node_id, 4000 // n + CASE WHEN rn <= 4000 % n THEN 1 ELSE 0 END AS capacity FROM c""", ("RG9", "WIN18"))
def uniform_capacities(spark, folder):
    c = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("node_id"))
    return R.capacities(c, None, 4000, "uniform_exact")


@query("farthest_point_capacities", None, ("RG9", "SRT12"))
def farthest_point_capacities(spark, folder):
    return R.capacities(T.points(spark, folder, 2), None, 24, "spatial_fps_exact", XY)


ARCS = f"""q AS (SELECT node_id, (x0 + x1) / 2 AS u, label / 10.0 AS v FROM points), near AS (SELECT a.node_id AS a, b.node_id AS b FROM points a JOIN points b ON a.node_id <> b.node_id
  QUALIFY row_number() OVER (PARTITION BY a.node_id ORDER BY {D2}, b.node_id) <= 5),
hub(d, x) AS (SELECT 1, 1), arcs AS (SELECT a, b, p.u - q2.u AS du, p.v - q2.v AS dv FROM near JOIN q p ON p.node_id = a JOIN q q2 ON q2.node_id = b),
costs AS (SELECT a, b, CASE WHEN abs(du) <= 0.05 THEN 0.5 * du * du ELSE 0.05 * (abs(du) - 0.025) END + CASE WHEN abs(dv) <= 0.05 THEN 0.5 * dv * dv ELSE 0.05 * (abs(dv) - 0.025) END AS cost FROM arcs)"""


def _arcs(spark, folder):
    p = T.points(spark, folder, 2)
    near = N.knn(p, 5, XY).select(F.col("node_id").alias("a"), F.col("nbr").alias("b"))
    f = p.select("node_id", ((F.col("x0") + F.col("x1")) / 2).alias("u"), (F.col("label") / 10.0).alias("v"))
    x = near.join(f.select(F.col("node_id").alias("a"), F.col("u").alias("a_u"), F.col("v").alias("a_v")), "a")
    return p, R.huber_costs(x.join(f.select(F.col("node_id").alias("b"), F.col("u").alias("b_u"), F.col("v").alias("b_v")), "b"), ["u", "v"]).select("a", "b", "cost")


@query("huber_costs", f"WITH {T.points_sql(2)}, {ARCS} SELECT a, b, round(cost, 9) AS cost FROM costs", ("RG10",))
def huber_costs(spark, folder):
    return _arcs(spark, folder)[1].withColumn("cost", F.round("cost", 9))


@query("quantised_costs", f"WITH {T.points_sql(2)}, {ARCS} SELECT a, b, CAST(round_even(cost * 1e6, 0) AS BIGINT) * ((SELECT count(DISTINCT a) * (max(b) - min(b)) + 1 FROM costs)) + b - (SELECT min(b) FROM costs) AS unit_cost FROM costs", ("RG14", "RG15"))
def quantised_costs(spark, folder):
    arcs = _arcs(spark, folder)[1]
    flow = arcs.select("a").distinct().count()
    q = R.quantise(arcs, flow)
    return R.lexicographic(q.withColumn("second", F.col("b")), "second", flow).select("a", "b", "unit_cost")


PENALTY = """pl AS (SELECT node_id, x1 AS y0, x0 AS y1 FROM points), mo AS (SELECT i AS a, sum(w) AS deg, sum(w * y0) AS s0, sum(w * y1) AS s1, sum(w * (y0 * y0 + y1 * y1)) AS s2 FROM kg JOIN pl ON pl.node_id = j GROUP BY 1),
pen AS (SELECT n.node_id AS a, n.nbr AS b, deg * (x0 * x0 + x1 * x1) - 2 * (x0 * s0 + x1 * s1) + s2 AS penalty, 1.0 / rank AS cost FROM near n JOIN points p ON p.node_id = nbr JOIN mo ON mo.a = n.node_id)"""


def _penalised(spark, folder):
    p, g = _kgraph(spark, folder)
    near = N.knn(p, 5, XY)
    arcs = near.select(F.col("node_id").alias("a"), F.col("nbr").alias("b"), (1.0 / F.col("rank")).alias("cost"))
    arcs = arcs.join(p.select(F.col("node_id").alias("b"), F.col("x0").alias("y_c0"), F.col("x1").alias("y_c1")), "b")
    placed = p.select("node_id", F.col("x1").alias("c0"), F.col("x0").alias("c1"))
    return R.dirichlet_penalty(arcs, g, placed, ("c0", "c1"))


@query("dirichlet_penalty", f"WITH {GEO}, {PENALTY} SELECT a, b, round(penalty, 6) AS penalty FROM pen", ("RG18",))
def dirichlet_penalty(spark, folder):
    return _penalised(spark, folder).select("a", "b", F.round("penalty", 6).alias("penalty"))


@query("adaptive_weight", f"WITH {GEO}, {PENALTY} SELECT round(least(median(cost) FILTER (cost > 0) / median(penalty) FILTER (penalty > 0), 1e12), 6) AS weight FROM pen", ("RG20",))
def adaptive_weight(spark, folder):
    return R.adaptive_weight(_penalised(spark, folder)).select(F.round("weight", 6).alias("weight"))


@query("assignment_energy", f"WITH {GEO} SELECT round(sum(w * ((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2)) / 2, 6) AS energy FROM kg JOIN points a ON a.node_id = i JOIN points b ON b.node_id = j", ("RG19",))
def assignment_energy(spark, folder):
    p, g = _kgraph(spark, folder)
    return R.assignment_energy(g, p, XY).select(F.round("energy", 6).alias("energy"))


@query("assignment_displacement", f"""WITH {T.points_sql(4)}, m AS (SELECT CASE WHEN label < 3 THEN sqrt((x0 - x2) ** 2 + (x1 - x3) ** 2) ELSE 0 END AS d FROM points)
SELECT count(*) AS n, count(*) FILTER (d > 0) AS n_moved, round(median(d) FILTER (d > 0), 6) AS median_move, round(max(d), 6) AS max_move,
  (SELECT round(sqrt((max(x0) - min(x0)) ** 2 + (max(x1) - min(x1)) ** 2), 6) FROM points) AS span FROM m""", ("RG29",))
def assignment_displacement(spark, folder):
    p = T.points(spark, folder, 4)
    stay = F.col("label") >= 3
    final = p.select("node_id", F.when(stay, F.col("x0")).otherwise(F.col("x2")).alias("x0"), F.when(stay, F.col("x1")).otherwise(F.col("x3")).alias("x1"))
    return R.displacement(p.select("node_id", *XY), final, XY).select("n", "n_moved", *r6("median_move", "max_move", "span"))


@query("slice_feature_means", """WITH s AS (SELECT s_suppkey AS slice FROM supplier), a AS (SELECT c_custkey AS node_id, CASE WHEN c_nationkey < 20 THEN c_custkey % 97 ELSE 5 END AS slice, c_acctbal AS v FROM customer)
SELECT s.slice, round(avg(v), 4) AS mean, count(v) AS n FROM s LEFT JOIN a USING (slice) GROUP BY 1""", ("AGG37", "SNK11"))
def slice_feature_means(spark, folder):
    c = T.table(spark, folder, "customer")
    assign = c.select(F.col("c_custkey").alias("node_id"), F.when(F.col("c_nationkey") < 20, F.col("c_custkey") % 97).otherwise(5).alias("slice"))
    s = T.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("slice"))
    m = R.slice_feature_means(assign, c.select(F.col("c_custkey").alias("node_id"), F.col("c_acctbal").alias("v")), s, "v")
    return m.select("slice", F.round("mean", 4).alias("mean"), "n")


ENS = f"{T.points_sql(6)}, mem AS (SELECT node_id, 0 AS member, x0 AS x, x1 AS y FROM points UNION ALL SELECT node_id, 1, x2, x3 FROM points UNION ALL SELECT node_id, 2, x4, x5 FROM points)"


def _members(spark, folder):
    p = T.points(spark, folder, 6)
    e = F.array(*[F.struct(F.lit(m).alias("member"), F.col(f"x{2 * m}").alias("x"), F.col(f"x{2 * m + 1}").alias("y")) for m in range(3)])
    return p.select("node_id", F.inline(e))


@query("ensemble_moments", f"WITH {ENS} SELECT node_id, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(covar_samp(x, x), 6) AS cov_x_x, round(covar_samp(x, y), 6) + 0.0 AS cov_x_y, round(covar_samp(y, y), 6) AS cov_y_y FROM mem GROUP BY 1", ("RG24",))
def ensemble_moments(spark, folder):
    m = R.ensemble_moments(_members(spark, folder), ("x", "y"))
    return m.select("node_id", *r6("mean_x", "mean_y", "cov_x_x"), (F.round("cov_x_y", 6) + 0.0).alias("cov_x_y"), *r6("cov_y_y"))


@query("covariance_floor", f"""WITH {ENS}, m AS (SELECT node_id, covar_samp(x, x) AS a, covar_samp(y, y) AS b FROM mem GROUP BY 1), f AS (SELECT greatest(0.05 * coalesce(median((a + b) / 2) FILTER (a + b > 0), 1), 1e-12) AS k FROM m)
SELECT node_id, round(a + k, 6) AS cov_x_x, round(b + k, 6) AS cov_y_y FROM m, f""", ("RG30",))
def covariance_floor(spark, folder):
    m = R.covariance_floor(R.ensemble_moments(_members(spark, folder), ("x", "y")), ("x", "y"), 0.05)
    return m.select("node_id", *r6("cov_x_x", "cov_y_y"))


@query("ensemble_medoid", f"""WITH {ENS}, d AS (SELECT a.member, sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM mem a JOIN mem b ON a.node_id = b.node_id GROUP BY 1)
SELECT member FROM d ORDER BY d, member LIMIT 1""", ("RG25",))
def ensemble_medoid(spark, folder):
    return R.medoid(_members(spark, folder), ("x", "y")).select("member")


@query("histogram_divergence", f"""WITH {T.points_sql(4)}, u AS (SELECT x0 AS x, x1 AS y, 0 AS s FROM points UNION ALL SELECT x2, x3, 1 FROM points), l AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM u),
h AS (SELECT least(floor((x - x0) / (x1 - x0) * 32), 31) AS cx, least(floor((y - y0) / (y1 - y0) * 32), 31) AS cy, count(*) FILTER (s = 0) AS p, count(*) FILTER (s = 1) AS q FROM u, l GROUP BY ALL),
n AS (SELECT CAST(p AS DOUBLE) / sum(p) OVER () AS p, CAST(q AS DOUBLE) / sum(q) OVER () AS q FROM h)
SELECT round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js FROM n""", ("RG26",))
def histogram_divergence(spark, folder):
    p = T.points(spark, folder, 4)
    return R.histogram_divergence(p.select(F.col("x0").alias("x"), F.col("x1").alias("y")), p.select(F.col("x2").alias("x"), F.col("x3").alias("y")), "x", "y").select(*r6("js"))


def _transport(spark, folder):
    """Suppliers to nations: a cost from the account balance, ten candidates each."""
    s = T.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("a"), "s_nationkey", "s_acctbal")
    arcs = s.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(
        "a", F.pmod(F.col("s_nationkey") + F.col("step") * 2, F.lit(25)).cast("long").alias("b"), (F.pmod(F.floor("s_acctbal") + F.col("step") * 7, F.lit(23))).cast("long").alias("unit_cost")
    )
    per = s.agg((F.floor(F.count(F.lit(1)) / 25) + 1).alias("capacity"))
    cap = T.table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("b")).join(F.broadcast(per))
    return arcs, cap


@query("min_cost_assignment", None, ("RG11", "RG12", "RG13", "RG23"))
def min_cost_assignment(spark, folder):
    return X.optimal(*_transport(spark, folder)).assigned


@query("assignment_ensemble", None, ("RG16", "RG17", "RG31"))
def assignment_ensemble(spark, folder):
    arcs, cap = _transport(spark, folder)
    return X.ensemble(arcs, cap, 6, 16, "perturb", relative=0.05).groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.max("objective").alias("objective"))


@query("assignment_certificate", "SELECT count(*) AS placed, 0 AS gap, 0 AS negative, 0 AS loose, 0 AS over FROM supplier", ("RG13",))
def assignment_certificate(spark, folder):
    """All suppliers placed, and the prices' proof: no duality gap, no cheaper arc, no priced spare column, no column beyond its capacity."""
    arcs, cap = _transport(spark, folder)
    c = X.certificate(arcs, cap, X.optimal(arcs, cap))
    return c.select("placed", (F.col("total") - F.col("dual")).alias("gap"), "negative", "loose", "over")
