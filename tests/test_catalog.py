"""Registered queries against their SQL twins on the smallest tables.

A fixed list of fast queries runs by default; LOOM_ALL=1 runs every one.
"""

import os

import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = """uniq_seq_counts base4_roundtrip seqform_classify uxi_extract stacked_uxis mate_join mismatch_groups directional_clusters
uei_consensus_pairs assoc_filter_fixpoint extra_edges consensus_sequence trimmed_fragments label_entries sam_scan alignment_mutations
interval_annotation near_duplicates node_feature_matrix qc_gates cluster_markers marker_select jaccard_within cumweight_prune
noise_majority_vote kcore_mask coarsen_graph knn_exact rank_scores bh_fdr largest_remainder gene_autocorrelation meta_log_odds
signflip_exact pair_presence huber_costs ensemble_moments procrustes_rmse pseudobulk_cpm""".split()


def names():
    return sorted(entry_module.oracle_sql()) if os.environ.get("LOOM_ALL") else FAST


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i] + 0.0) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, FOLDER)
    cur = duck.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    got = entry_module.entry(spark)
    assert got.columns == ["comp", "comp_size", "comp_rank"] and got.count() == 1
