"""Consensus of groups read one after the other, against brute force; texts move once."""

from collections import Counter, defaultdict

import numpy as np

from loomgraph.operators import consensus as K


def _brute(rows):
    groups = defaultdict(list)
    for umi, seq in rows:
        if seq:
            groups[umi, seq[:10]].append(seq)
    out = {}
    for (umi, kmer), seqs in groups.items():
        if umi is None and len(set(seqs)) > 1:
            continue
        letters = []
        for p in range(max(map(len, seqs))):
            top = Counter(s[p] for s in seqs if p < len(s) and s[p] in "ACGT").most_common(2)
            letters.append("N" if not top or (len(top) > 1 and top[0][1] == top[1][1]) else top[0][0])
        out[umi, kmer] = "".join(letters), len(seqs)
    return out


def _rows():
    rng = np.random.default_rng(7)
    heads = ["ACGTACGTAA", "ACGTACGTAC", "TTTTTTTTTN", "GG"]
    rows = [(int(rng.integers(3)), heads[rng.integers(4)] + "".join(rng.choice(list("ACGTNé"), int(rng.integers(0, 30))))) for _ in range(150)]
    rows += [(7, "ACGTACGTACGGT")] * 20 + [(8, ""), (8, None), (None, "AAAA"), (None, "AAAA"), (None, "ACGTACGTAAC"), (None, "ACGTACGTAAG"), (9, "é")]
    return rows


def test_consensus_matches_brute_force_on_both_ways(spark, monkeypatch):
    df = spark.createDataFrame(_rows(), "umi long, insert_seq string").repartition(5)
    want = _brute(_rows())
    assert {(r["umi"], r["kmer"]): (r["consensus"], r["n_reads"]) for r in K.consensus(df).collect()} == want
    monkeypatch.setattr(K, "known_small", lambda _: False)
    assert {(r["umi"], r["kmer"]): (r["consensus"], r["n_reads"]) for r in K.consensus(df, heavy=400).collect()} == want


def test_sequences_move_once_and_stay_out_of_the_window(spark, capsys):
    df = spark.createDataFrame(_rows(), "umi long, insert_seq string")
    K.consensus(df).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Generate" not in plan
    named = K.numbered(K.consensus(df))
    assert {(r["umi"], r["kmer"], r["sub"]) for r in named.collect()} == {
        (u, k, sorted(x for v, x in _brute(_rows()) if v == u).index(k)) for u, k in _brute(_rows())
    }
    named.explain()
    window = capsys.readouterr().out.split("Window [")[1]
    assert "consensus" not in window.split("Scan")[0]
