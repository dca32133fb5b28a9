import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontam, ngramjoin, topk


def brute_components(texts, similar=75):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and 100 * same >= similar * len(sets[i] | sets[j]) and same:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def families(seed, n_groups, size, words, edits):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(n_groups):
        base = [f"w{rng.integers(0, 5000)}" for _ in range(words)]
        out.append(" ".join(base))
        for _ in range(size):
            copy = list(base)
            for p in rng.integers(0, words, rng.integers(0, edits)):
                copy[p] = f"x{rng.integers(0, 10**6)}"
            out.append(" ".join(copy))
    passage = " ".join(f"common{i}" for i in range(30))
    out += [" ".join(f"u{rng.integers(0, 10**6)}" for _ in range(25)) + " " + passage for _ in range(40)]
    rng.shuffle(out)
    return [*out, None, "", "a b", "a  b", "a b c", out[0], out[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    texts = families(seed, 6, 25, 60, 5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.join_documents(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_hot_shingles_split_over_salts_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "HOT", 4)
    texts = families(3, 3, 30, 40, 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.join_documents(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_suffix_filter_never_loses_a_link():
    rng = np.random.default_rng(6)
    dropped = 0
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        keep = a[rng.random(len(a)) < rng.choice([0.4, 0.8, 0.9, 0.99])]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 5))).astype(np.uint64)]))
        x, y = (ngramjoin._cells(v, np.array([len(v)]))[0] for v in (a, b))
        if len(b) and ngramjoin.linked(a, b):
            assert ngramjoin.may_share(x, y)
        dropped += not ngramjoin.may_share(x, y)
    assert dropped > 30


def test_join_of_tricky_rows(tricky, empty):
    got = ngramjoin.join_documents(tricky).collect()
    assert len(got) == tricky.count()
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert by[(1, 0)] == 1 and by[(2, 0)] == 2 and by[(4, 1)] == by[(5, 1)] == 4
    assert ngramjoin.join_documents(empty).count() == 0


def brute_top(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good[i] = np.floor(64 * np.array(v, float)).astype(int)
    out = []
    for q in good:
        if q % every == 0:
            score = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score)]
    return sorted(out)


def test_top_k_takes_every_row_of_a_repeated_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (20, [0.0, 1.0]), (20, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    scores = {}
    for q, a in rows:
        for c, b in rows:
            if q % 20 == 0 and q != c:
                scores.setdefault(q, []).append((-int(64 * a[0]) * int(64 * b[0]) - int(64 * a[1]) * int(64 * b[1]), c))
    want = sorted((q, r + 1, c, -s) for q, found in scores.items() for r, (s, c) in enumerate(sorted(found)[:4]))
    assert sorted(tuple(r) for r in topk.top_k(df, "vec_id", "embedding", 20, 4).collect()) == want


def test_top_k_matches_brute_force_with_ties_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 5)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) if x else 0.0 for x in np.round(rng.normal(0, 0.2, 8) * (rng.random(8) < (0.3 if i % 3 else 1)), 2)]) for i in range(240)]
    rows += [(i, rows[0][1]) for i in range(240, 260)]  # ties
    rows += [(260, None), (280, [None] * 8), (300, [float("nan")] * 8), (320, [float("inf")] * 8), (None, [0.1] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, score string")
    got = sorted(tuple(r) for r in topk.top_k(df, "vec_id", "embedding").collect())
    assert got == brute_top(rows, 20, 20)
    assert topk.top_k(df.limit(0), "vec_id", "embedding").count() == 0
    few = sorted(tuple(r) for r in topk.top_k(df.where("vec_id < 3"), "vec_id", "embedding").collect())
    assert few == brute_top(rows[:3], 20, 20)


def brute_tiling(doc, item, match):
    """Greedy string tiling as defined: the longest unmarked common runs first."""
    md, mi = [False] * len(doc), [False] * len(item)
    match = min(match, len(item))
    while True:
        best, found = match - 1, []
        for p in range(len(item)):
            for t in range(len(doc)):
                n = 0
                while p + n < len(item) and t + n < len(doc) and item[p + n] == doc[t + n] and not mi[p + n] and not md[t + n]:
                    n += 1
                if n > best:
                    best, found = n, [(p, t)]
                elif n == best and n >= match:
                    found.append((p, t))
        if best < match:
            return sum(mi)
        for p, t in found:
            if not any(mi[p : p + best]) and not any(md[t : t + best]):
                mi[p : p + best] = [True] * best
                md[t : t + best] = [True] * best


def test_tiling_matches_brute_force_and_catches_reordered_passages(spark):
    rng = np.random.default_rng(4)
    items = [[f"b{rng.integers(0, 60)}" for _ in range(30)] for _ in range(6)] + [["tiny", "item"], []]
    docs = []
    for _ in range(40):
        words = [f"d{rng.integers(0, 500)}" for _ in range(20)]
        item = items[rng.integers(0, 6)]
        cut = int(rng.integers(6, 24))
        parts = [item[cut:], words[:7], item[:cut]] if rng.random() < 0.5 else [words[:5], item[: cut + 4], words[5:]]
        docs.append([w for p in parts for w in p])
    docs += [["a", "TINY", "item", "b"], [], items[0] * 50]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None)], "item_id bigint, text string")
    df = spark.createDataFrame([(i, ", ".join(w)) for i, w in enumerate(docs)] + [(99, None)], "doc_id bigint, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]): r["covered"] for r in decontam.leaks(df, bench).collect()}
    want = {}
    for i, d in enumerate(docs):
        for j, item in enumerate(items):
            covered = brute_tiling([x.lower() for x in d], item, decontam.MATCH) if item else 0
            if item and covered >= decontam.COVERAGE * len(item):
                want[i, j] = covered
    assert got == want and len(want) > 30
    left = {r["doc_id"] for r in decontam.without_leaks(df, bench).collect()}
    assert left == {*range(len(docs)), 99} - {i for i, _ in want}


def test_test_set_in_parts_gives_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"t{i}x{j}" for j in range(12))) for i in range(20)], "item_id bigint, text string")
    df = spark.createDataFrame([(i, " ".join(f"t{i}x{j}" for j in range(12))) for i in range(25)], "doc_id bigint, text string")
    monkeypatch.setattr(decontam, "SEEDS", 300)
    assert {tuple(r)[:2] for r in decontam.leaks(df, bench).collect()} == {(i, i) for i in range(20)}
    assert decontam.without_leaks(df, bench).count() == 5


def test_decontamination_of_tricky_rows(spark, tricky, empty):
    bench = spark.createDataFrame([(1, "one"), (2, None), (3, "")], "item_id bigint, text string")
    assert sorted(r["doc_id"] for r in decontam.leaks(tricky, bench).collect()) == [4, 5]
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(tricky, bench.limit(0)).count() == 0
    kept = decontam.without_leaks(tricky, bench)
    assert kept.columns == tricky.columns and kept.where(F.col("doc_id").isin(4, 5)).count() == 0 and kept.count() == tricky.count() - 2
