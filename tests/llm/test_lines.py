import hashlib

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import linededup as L
from loomgraph.llm.common import keep

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})


def brute(texts, least):
    count = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or count[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    pool = [f"Line {i} Ä" for i in range(40)] + ["", "  ", "\t"]
    made = ["\n".join(pool[j] if rng.random() < 0.8 else f"  {pool[j].upper()}\r" for j in rng.integers(0, len(pool), rng.integers(1, 9))) for _ in range(120)]
    return [*made, None, "", "Line 3 Ä", "Line 3 Ä"]


@pytest.mark.parametrize("size", [L.FILTER_BYTES, 0])
def test_both_ways_match_brute_force(spark, texts, size):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in L.dedup_lines(df, 10, 1, size).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 10)


def test_deleting_documents_undoes_their_insertion(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    first, later = df.where("doc_id < 60"), df.where("doc_id >= 60")
    before = keep(L.line_counts(first))
    filters = keep(L.build_filters(before, 3))
    after = keep(L.shift(before, later, 1))
    assert sorted(after.collect()) == sorted(L.line_counts(df).collect())
    grown = keep(L.update_filters(filters, before, after, 3))
    got = sorted(tuple(r) for r in L.drop_by_filters(df, grown, 3).select("doc_id", "n_dropped").collect())
    assert got == [(i, b[1]) for i, b in enumerate(brute(texts, 10))]
    back = keep(L.shift(after, later, -1))
    assert sorted(back.collect()) == sorted(before.collect())
    shrunk = L.update_filters(grown, after, back, 3)
    got = sorted(tuple(r) for r in L.drop_by_filters(first, shrunk, 3).select("doc_id", "n_dropped").collect())
    assert got == [(i, b[1]) for i, b in enumerate(brute(texts[:60], 10))]


def test_cuckoo_filter_holds_deletes_and_rarely_errs():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (20_000, 2)).astype(np.uint64)
    made = L._filled(keys)
    assert made.holds(keys).all()
    other = rng.integers(0, 2**63, (200_000, 2)).astype(np.uint64)
    assert made.holds(other).sum() <= 2
    made.delete(keys[:5_000])
    assert made.holds(keys[5_000:]).all() and made.holds(keys[:5_000]).sum() <= 2
    raw = pa.array([keys[i].tobytes() for i in range(3)], pa.binary())
    assert (L.as_numbers(raw) == keys[:3]).all()


def test_tricky_rows(tricky, empty):
    assert L.line_report(tricky).count() == tricky.count()
    assert L.line_report(empty).count() == 0
    kept = L.dedup_lines(tricky, 2, 1, 0)
    assert kept.columns == [*tricky.columns, "n_lines", "n_dropped"] and kept.count() == tricky.count()


def test_columns_with_the_operators_names_survive(spark, no_labels):
    from loomgraph.llm import linecrf

    many = [(i, f"shared line\nown line {i}", 7, 8, 9, 0.5, "r") for i in range(12)] + [(99, None, 7, 8, 9, 0.5, "r")]
    docs = spark.createDataFrame(many, "doc_id bigint, text string, n_lines bigint, n_dropped int, n_good_lines int, quality_score double, _row string")
    out = L.without_shared_lines(docs)
    assert out.columns == docs.columns and {r["doc_id"]: r["text"] for r in out.collect()} == {**{i: f"own line {i}" for i in range(12)}, 99: None}
    assert {tuple(r)[2:] for r in out.collect()} == {(7, 8, 9, 0.5, "r")}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id bigint, quality int, toxic int")
    kept = linecrf.accepted(docs, labels)
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} <= {(7, 8, 9, 0.5, "r")}
    assert L.without_shared_lines(docs.limit(0)).count() == 0
