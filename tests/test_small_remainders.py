"""What is left of a graph is settled in one task once it is small, with the results of the distributed rounds."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import components as C
from loomgraph.operators import density as D
from loomgraph.operators import hierarchy as H


def _edges(spark, n=200, m=180):
    rng = random.Random(4)
    rows = {(min(a, b), max(a, b)): (float(rng.randrange(6)) if rng.random() < 0.9 else float("nan")) for a, b in (rng.sample(range(n), 2) for _ in range(m))}
    return spark.createDataFrame([(i, j, d) for (i, j), d in rows.items()], "i long, j long, d double")


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_small_graphs_need_no_star_rounds(spark, monkeypatch):
    edges = _edges(spark)
    want = _rows(C.components(edges, "i", "j", block=0))

    def boom(*_):
        raise AssertionError("a distributed round over a small graph")

    monkeypatch.setattr(C, "_star", boom)
    assert _rows(C.components(edges, "i", "j")) == want
    names = edges.select(F.format_string("é%d", "i").alias("i"), F.format_string("é%d", "j").alias("j"))
    assert C.components(names, "i", "j").select("comp").distinct().count() == len({w.split("comp=")[1] for w in want})
    assert C.components(edges.limit(0), "i", "j").count() == 0


def test_small_forests_need_no_rounds_of_components(spark, monkeypatch):
    edges = _edges(spark)
    want = _rows(D.spanning_forest(edges, block=0))
    assert _rows(D.spanning_forest(edges, block=100)) == want  # a round, then one task

    def boom(*_):
        raise AssertionError("a distributed round over a small graph")

    monkeypatch.setattr(D, "components", boom)
    assert _rows(D.spanning_forest(edges)) == want


def test_pointers_end_where_rounds_end(spark, monkeypatch):
    links = spark.createDataFrame([(i, max(i - 1, 0)) for i in range(200)] + [(1000, 1001), (1001, 5000)], "ref long, ptr long")
    want = _rows(H._jump(links, block=0))
    monkeypatch.setattr(H, "lookup", None)
    assert _rows(H._jump(links)) == want
    with pytest.raises(Exception, match="circle"):
        H._jump(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "ref long, ptr long"))
