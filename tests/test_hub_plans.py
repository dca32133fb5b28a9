"""Hub counts meet their hub once, and marker totals do not read them again."""

import pytest

import __spark_entry__ as entry_module
from loomgraph.sources import tables as T


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hubs"))
    lines = [(o, 7 * o + k, k) for o in range(60) for k in range(1, 4)] + [(None, 3, 1), (61, None, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(o, o % 5 if o % 11 else None) for o in range(62)], "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(c, "ab"[c % 2]) for c in range(5)], "c_custkey long, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_are_those_of_the_tables(spark, folder):
    want = {}
    for o in [*range(60), 61]:
        for part, n in [(7 * o + k, k) for k in range(1, 4)] if o < 60 else [(None, 2)]:
            key = (o % 5 if o % 11 else None, None if part is None else f"g{part % 50}")
            want[key] = want.get(key, 0) + n
    assert {(r["hub"], r["gene"]): r["n"] for r in T.hub_counts(spark, folder).collect()} == want


def test_totals_by_hub_need_no_exchange(spark, folder):
    counts = T.hub_counts(spark, folder)
    totals = counts.groupBy("hub").count()
    assert plan(totals).count("Exchange") == plan(counts).count("Exchange")


@pytest.mark.parametrize("name", ["cluster_markers", "marker_zscore", "marker_select"])
def test_markers_read_the_tables_no_more_than_once_for_their_totals(spark, folder, name):
    assert "FileScan" not in plan(entry_module.queries()[name](spark, folder))
