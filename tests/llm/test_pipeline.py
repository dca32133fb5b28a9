"""The pipeline's stages against plain versions of their decisions."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline as P
from loomgraph.llm import decontam, linecrf
from loomgraph.llm.common import keep
from test_pairs import brute_components

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(keep(stage(spark, out[-1], FOLDER)))
    return out


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_stages_keep_columns_and_only_drop_what_they_decide(spark, steps):
    docs, good, lined, single, clean, mixed = steps
    for df in steps[1:5]:
        assert df.columns == docs.columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    score = {r["doc_id"]: r["score"] for r in linecrf.quality_report(docs, labels).collect()}
    assert ids(good) == {i for i, s in score.items() if s >= linecrf.ACCEPT}
    assert ids(lined) == ids(good)
    assert lined.where("n_chars <> char_length(text)").count() == 0
    texts = lined.orderBy("doc_id").select("doc_id", "text").collect()
    comp = brute_components([r["text"] for r in texts])
    assert ids(single) == {r["doc_id"] for i, r in enumerate(texts) if comp[i][1] == i}
    leaked = ids(decontam.leaks(single, spark.read.parquet(f"{FOLDER}/benchmark.parquet")))
    assert ids(clean) == ids(single) - leaked
    assert ids(mixed) == ids(clean) and mixed.where(F.col("rate") < 0).count() == 0


def test_run_is_registered_and_ends_like_the_stages(spark, steps):
    got = entry_module.queries()["pipeline"](spark, FOLDER)
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(tuple(r)[:3] for r in steps[-1].collect())


def test_stages_on_tricky_rows(spark, tricky):
    docs = tricky
    for _, stage in P.STAGES:
        docs = keep(stage(spark, docs, FOLDER))
    assert docs.count() >= 5
