"""Catalog: linear algebra and embedding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomgraph.core.catalog import query
from loomgraph.core.session import cut
from loomgraph.operators import embed as E
from loomgraph.operators import knn as N
from loomgraph.operators import linear as L
from loomgraph.operators import stats as S
from loomgraph.plans.queries_graph import XY, _kgraph
from loomgraph.operators.spectrum import leading_spectrum
from loomgraph.sources import tables as T


@query("gram_matrix", f"""WITH {T.points_sql(3)} SELECT round(sum(x0 * x0), 6) AS g00, round(sum(x0 * x1), 6) AS g01, round(sum(x1 * x1), 6) AS g11, round(sum(x2 * x2), 6) AS g22 FROM points""", ("LA4", "LA7", "LA19"))
def gram_matrix(spark, folder):
    g = L.gram(T.points(spark, folder, 3), ["x0", "x1", "x2"])
    return spark.createDataFrame([tuple(round(float(v), 6) for v in (g[0, 0], g[0, 1], g[1, 1], g[2, 2]))], "g00 double, g01 double, g11 double, g22 double")


@query("orthonormal_columns", None, ("LA4", "LA3"))
def orthonormal_columns(spark, folder):
    x, _ = L.orthonormalise(T.points(spark, folder, 6).select("node_id", *[f"x{i}" for i in range(6)]), [f"x{i}" for i in range(6)])
    return x


@query("leading_eigenvectors", None, ("LA1", "LA2", "LA5", "GR24"))
def leading_eigenvectors(spark, folder):
    _, g = _kgraph(spark, folder)
    x, values, _ = leading_spectrum(g, 6)
    return L.gap_scale(x, values)


@query("rank_rotation", None, ("LA6", "LA7", "WIN10"))
def rank_rotation(spark, folder):
    p = T.points(spark, folder, 4).select("node_id", *[F.col(f"x{i}").alias(f"v{i}") for i in range(4)])
    return E.rank_rotation_basis(p, L.columns(4), 4, rotations=3, bins=128)


@query("simplex_transport", None, ("LA8", "LA9", "LA10", "LA11", "T22"))
def simplex_transport(spark, folder):
    p, g = _kgraph(spark, folder)
    return E.local_transport(g, N.knn(p, 6, XY), p, XY)


@query("procrustes_rmse", f"""WITH {T.points_sql(4)}, m AS (SELECT avg(x0) AS a0, avg(x1) AS a1, avg(x2) AS b0, avg(x3) AS b1, count(*) AS n FROM points),
s AS (SELECT any_value(n) AS n, sum((x2 - b0) * (x0 - a0)) AS h00, sum((x2 - b0) * (x1 - a1)) AS h01, sum((x3 - b1) * (x0 - a0)) AS h10, sum((x3 - b1) * (x1 - a1)) AS h11,
  sum((x0 - a0) ** 2 + (x1 - a1) ** 2) AS sa, sum((x2 - b0) ** 2 + (x3 - b1) ** 2) AS sb FROM points, m),
t AS (SELECT *, sqrt(h00 * h00 + h01 * h01 + h10 * h10 + h11 * h11 + 2 * abs(h00 * h11 - h01 * h10)) AS nuc FROM s)
SELECT round(nuc / sb, 6) AS scale, round(sqrt((sa - nuc * nuc / sb) / n), 6) AS rmse, round((sa - nuc * nuc / sb) / sa, 6) AS disparity FROM t""", ("LA20",))
def procrustes_rmse(spark, folder):
    r = S.procrustes(T.points(spark, folder, 4), ["x0", "x1"], ["x2", "x3"])
    return spark.createDataFrame([(round(r["scale"], 6), round(r["rmse"], 6), round(r["disparity"], 6))], "scale double, rmse double, disparity double")


@query("likelihood_gradient", None, ("LA12",))
def likelihood_gradient(spark, folder):
    p, g = _kgraph(spark, folder)
    pairs = N.stratified_pairs(p, XY, 4).select("i", "j", F.lit(1.0).alias("weight"))
    value, grad = E.Likelihood(g, p.select("node_id", *XY), XY, cut(pairs))(np.eye(2))
    return spark.createDataFrame([(float(value), [float(v) for v in grad.ravel()])], "value double, gradient array<double>")


@query("graph_embedding", None, ("LA13", "LA14", "LA3", "T23"))
def graph_embedding(spark, folder):
    _, g = _kgraph(spark, folder)
    return E.embed(g, dim=2, k=3, block_rounds=2, rotations=2, descents=4, neighbours=12, bins=64)
