"""Barcodes of tables whose keys need more digits than the usual ones."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from loomgraph.functions import seq as S
from loomgraph.sources import tables as T

BIG, SUPPLIER, ORDER = 4**8 + 5, 3 * 4**8, 4**10 + 27


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("large"))
    rows = [(7, 3, 1, 1, 30.0, "A", "F"), (ORDER, BIG, SUPPLIER, 2, 30.0, "N", "O"), (8, BIG + 1, 2, 1, 26.0, "R", "O"), (None, None, None, 1, 26.0, "R", "O")]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/lineitem.parquet")
    return path


def run(spark, folder, name):
    return [r.asDict() for r in entry_module.queries()[name](spark, folder).collect()]


def test_a_table_has_barcodes_of_one_length(spark, folder):
    got = T.reads(spark, folder)
    lengths = [F.collect_set(F.length(c)).alias(c) for c in ("umi0_seq", "umi1_seq", "uei_seq")]
    assert got.agg(*lengths).first().asDict() == {"umi0_seq": [9], "umi1_seq": [9], "uei_seq": [11]}
    assert got.where(S.base4_decode("umi1_seq") != F.col("umi1")).count() == 0
    assert {(r["uei"], r["decoded"]) for r in run(spark, folder, "base4_roundtrip") if r["uei"]} == {(7, 7), (8, 8), (ORDER, ORDER)}
    assert {(r["k"], r["min_len"], r["max_len"]) for r in run(spark, folder, "uxi_length_report")} == {(0, 9, 9), (1, 9, 9), (2, 11, 11)}


def test_forms_follow_the_barcodes(spark, folder):
    reads = {r["read_id"]: r for r in (x.asDict() for x in T.reads(spark, folder).collect()) if r["umi1"]}
    got = {r["read_id"]: r for r in run(spark, folder, "uxi_extract")}
    for read, r in reads.items():
        rc = r["umi0_seq"][::-1].translate(str.maketrans("ACGT", "TGCA"))
        if rc[0] == "A" and r["uei_seq"].startswith("AA"):
            want = [r["umi0_seq"][:-1], r["uei_seq"][2:]]
        elif r["uei_seq"][0] == "A" and r["uei_seq"][-4] in "AT" and r["uei_seq"][-3] in "CG":
            want = [rc, r["uei_seq"][1:]]
        elif rc[0] == "C":
            want = [r["umi0_seq"][:-1]]
        else:
            assert read not in got
            continue
        assert got[read]["for_uxis"] == ",".join(want)
        assert got[read]["rev_amp"] == r["uei_seq"]


def test_neighbours_at_every_position(spark, folder):
    parts = run(spark, folder, "uniq_seq_counts")
    number = {r["seq"]: r["seq_idx"] for r in parts if r["seq"]}
    near = {number["CAAAAAACC"], number["CAAAAAACG"]}  # 65541 and 65542 differ in the ninth letter
    groups = run(spark, folder, "mismatch_groups")
    assert {(r["pos"], r["rest"]) for r in groups} == {(9, "CAAAAAAC")} and {r["seq_idx"] for r in groups} == near
    clusters = {r["seq_idx"]: r["clust"] for r in run(spark, folder, "directional_clusters")}
    assert clusters[number["CAAAAAACG"]] == number["CAAAAAACC"]


def test_alignments_of_large_keys(spark, folder):
    assert len(run(spark, folder, "sam_scan")) == len(run(spark, folder, "alignment_mutations")) == 3
