import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import eliasfano, langmix, linecrf, mixing, ngramlm
from loomgraph.llm.common import held_out
from loomgraph.llm.textcodes import blocks

FOLDER = "/root/testdata/sf0.01"


def block(texts):
    return next(blocks(pa.array(texts, pa.string())))


# ---- quality field


def brute_chain(unary, stay):
    n = len(unary)
    weight = {}
    for ys in itertools.product((0, 1), repeat=n):
        weight[ys] = math.exp(sum(u for u, y in zip(unary, ys) if y) + sum(stay[a, b] for a, b in zip(ys, ys[1:])))
    z = sum(weight.values())
    good = [sum(w for ys, w in weight.items() if ys[t]) / z for t in range(n)]
    return good, math.log(z)


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    sizes = [1, 5, 3, 1, 7]
    unary, stay = rng.normal(0, 2, sum(sizes)), rng.normal(0, 1, (2, 2))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good, z, link, xi = linecrf.forward_backward(unary, owner, stay, True)
    at = 0
    for s in sizes:
        want, log_z = brute_chain(unary[at : at + s], stay)
        assert np.allclose(good[at : at + s], want) and np.isclose(z[at], log_z)
        at += s
    assert np.allclose(xi.sum((1, 2)), 1) and len(link) == sum(sizes) - len(sizes)
    assert np.allclose(linecrf.forward_backward(unary, owner, stay), good)


def test_line_shapes_of_odd_texts():
    texts = ["", None, "\n\n", "Äb.\n\nTHE END!!\nTHE END!!", "a a a\n|<x>|"]
    b = block(texts)
    start, end, owner = linecrf.lines_of(b)
    assert np.bincount(owner).tolist() == [1, 1, 3, 4, 2]
    x, points, _ = linecrf.line_shapes(b)
    assert points.tolist() == [0, 0, 0, 0, 0, 3, 0, 9, 9, 5, 5] and np.isfinite(x).all()
    assert x[8, 14] == 1 and x[7, 14] == 0  # a line met before in its text


def test_field_separates_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = linecrf.quality_report(docs, labels)
    joined = got.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert got.count() == docs.count()
    assert sum(r[0] == r[1] for r in joined) >= 0.9 * len(joined)
    assert all(r[0] == 1 for r in joined if r[1] == 1)


def test_field_without_labels_or_rows(tricky, empty, no_labels):
    got = linecrf.quality_report(tricky, no_labels).collect()
    assert len(got) == tricky.count() and {r["score"] for r in got} == {0.5}
    assert linecrf.quality_report(empty, no_labels).count() == 0
    assert linecrf.accepted(tricky, no_labels).columns == tricky.columns


# ---- languages


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = langmix.language_report(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_mixtures_find_both_languages_and_their_shares(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("n_chars between 800 and 4000")
    model = langmix.train(docs)
    one = {r["lang"]: r["text"] for r in docs.where("lang in ('en', 'de', 'fr')").orderBy("doc_id").collect()}
    mixed = one["de"][:600] + " " + one["fr"][:300]
    pi, n = model.mixtures(block([mixed, one["en"], "", "123 --"]))
    share = dict(zip(model.langs, pi[0]))
    assert 0.5 < share["de"] < 0.85 and 0.2 < share["fr"] < 0.5
    assert pi[1].max() > 0.9 and not pi[2].any() and not pi[3].any() and n[2] == n[3] == 0


def test_proportions_are_a_fixed_point_of_em():
    rng = np.random.default_rng(5)
    log_p = np.log(rng.dirichlet(np.ones(3), langmix.BUCKETS) * 0.2 + 0.8 / 3)  # languages that are hard to tell apart
    log_p[:, 2] -= 3
    model = langmix.Model(["a", "b", "c"], log_p, np.log(np.array([0.05, 0.9, 0.05])))
    text = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(40_000))
    pi, _ = model.mixtures(block([text, "\u201c\u2026\u201d \U0001f600", "\u6f22"]))
    _, bucket = langmix.trigrams(block([text]))
    p = np.exp(log_p[bucket])
    def fit(x):
        return np.log(p @ x).sum()
    step = (p * pi[0] / (p @ pi[0])[:, None]).mean(0)
    assert (pi[0] > 0).sum() == 2 and 0 <= fit(step) - fit(pi[0]) < 2 * langmix.TOLERANCE
    assert not pi[1].any() and pi[2].any()


def test_trigram_counts_match_brute_force(spark):
    rows = [("en", "Ab, c"), ("en", "ab"), (None, "zzz"), ("fr", None), ("de", "é")]
    got = {(r["lang"], r["bucket"]): r["n"] for r in langmix.ngram_counts(spark.createDataFrame(rows, "lang string, text string"), "lang", "text").collect()}
    want = Counter()
    for lang, text in rows:
        if lang and text:
            raw = b" " + bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in text.encode()) + b" "
            for a, m, b in zip(raw, raw[1:], raw[2:]):
                if m != 32 or (a != 32 and b != 32):
                    want[lang, (((a << 16 | m << 8 | b) * 0x9E3779B97F4A7C15) % 2**64) >> 48] += 1
    assert got == dict(want)


def test_languages_of_tricky_rows(tricky, empty):
    assert {(r["lang_pred"], r["score"]) for r in langmix.language_report(tricky).collect()} == {("und", 0.0)}
    assert langmix.language_report(empty).count() == 0
    some = tricky.withColumn("lang", F.lit("xx"))
    got = {r["doc_id"]: r["lang_pred"] for r in langmix.language_report(some).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] == "xx"


# ---- mixing


def brute_rates(t, p, weights):
    x = np.ones(len(t))
    for _ in range(60_000):
        r = (t * x) @ p / t.sum() - weights
        x = np.maximum(0, x - (p @ r + mixing.RIDGE * (x - 1)) / (1 + mixing.RIDGE))
    return x


def test_rates_match_plain_projected_gradient_and_targets(spark):
    rng = np.random.default_rng(2)
    t = rng.integers(1, 500, 80)
    p = rng.dirichlet([0.3, 0.3, 0.3], 80)
    weights = np.array([0.7, 0.2, 0.1])
    df = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(80)], "doc_id bigint, tokens bigint, p array<double>").repartition(3)
    got = {r["doc_id"]: r["rate"] for r in mixing.fit_rates(df, weights).collect()}
    x = np.array([got[i] for i in range(80)])
    assert (x >= 0).all()
    assert np.allclose((t * x) @ p / t.sum(), weights, atol=2e-3)
    best = brute_rates(t.astype(float), p, weights)
    assert np.allclose((t * best) @ p / t.sum(), (t * x) @ p / t.sum(), atol=2e-3)


@pytest.mark.parametrize("rare", [(1e-3, 1e-4), (1e-4, 1e-4)])
@pytest.mark.parametrize("soft", [0.0, 0.02])
def test_rates_meet_targets_of_rare_domains(spark, rare, soft):
    weights = np.array([0.90, 0.08, 0.02])
    share = np.array([1 - sum(rare), *rare])
    t = np.repeat((share * 1e7 / 50).astype(int), 50)
    p = np.repeat(np.eye(3), 50, axis=0)
    p = (1 - soft) * p + soft * p[:, ::-1] * np.random.default_rng(3).random((150, 1))
    p /= p.sum(1, keepdims=True)
    df = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(150)], "doc_id bigint, tokens bigint, p array<double>")
    got = {r["doc_id"]: r["rate"] for r in mixing.fit_rates(df, weights).collect()}
    x = np.array([got[i] for i in range(150)])
    assert (x >= 0).all() and np.allclose((t * x) @ p / t.sum(), weights, rtol=2e-3)


def test_mix_of_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mix(docs, labels).toPandas()
    total = got["tokens"].sum()
    for d, w in mixing.TARGETS.items():
        assert abs((got["tokens"] * got["rate"] * got[f"p_{d}"]).sum() / total - w) < 5e-3
    known = got.merge(labels.toPandas(), on="doc_id")
    assert (known[known.toxic == 1].domain == "toxic").mean() > 0.9 and (known[(known.toxic == 0) & (known.quality == 1)].domain == "good").mean() > 0.97
    assert (got["copies"] - got["rate"]).abs().max() < 1 + 1e-9


def test_mix_of_tricky_rows(tricky, empty, no_labels):
    got = mixing.mix(tricky, no_labels).collect()
    assert len(got) == tricky.count()
    assert all(r["rate"] == 1.0 for r in got if r["tokens"] == 0) and min(r["rate"] for r in got) >= 0
    assert mixing.mix(empty, no_labels).count() == 0


# ---- language model


@pytest.mark.parametrize("n,top", [(0, 10), (1, 1), (1000, 50), (500, 2**47), (300, 10**6)])
def test_elias_fano_round_trip(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n).astype(np.uint64))
    size, width, upper, low = eliasfano.EliasFano.encode(v, top)
    ef = eliasfano.EliasFano(size, width, upper, low)
    assert (ef.access(np.arange(n)) == v).all()
    ask = np.concatenate([v, rng.integers(0, 2 * top, 200).astype(np.uint64)])
    place = ef.find(ask)
    held = set(v.tolist())
    for a, x in zip(place.tolist(), ask.tolist()):
        assert (a >= 0) == (x in held) and (a < 0 or v[a] == x)


def brute_scores(rows, order, mass=ngramlm.MASS):
    low = {c: c + 32 for c in range(65, 91)}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    tok = [(i, [*word.findall((t or "").translate(low)), "\0E"], i is not None and zlib.crc32(str(i).encode()) % 5 == 1) for i, t in rows]
    c, c1, c2, c3 = Counter(), Counter(), Counter(), Counter()
    for _, t, out in tok:
        if not out:
            c.update(t)
            s = ["\0S", *t]
            c1.update(s[:-1])
            c2.update(zip(s, s[1:]))
            c3.update(zip(s, s[1:], s[2:]))
    n, v = sum(c.values()), len(c)
    one = lambda w: math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))
    two = lambda a, b: math.log10(c2[a, b] / (c1[a] + mass)) if c2[a, b] else math.log10(mass / (c1[a] + mass)) + one(b)
    three = lambda u, a, b: math.log10((c3[u, a, b] or mass) / (c2[u, a] + mass)) + (0 if c3[u, a, b] else two(a, b))
    res = []
    for i, t, out in tok:
        s = ["\0S", *t]
        score = two(*s[:2]) + sum(three(*x) if order == 3 else two(*x[1:]) for x in zip(s, s[1:], s[2:]))
        res.append((i, out, len(t), sum(c[w] > 0 for w in t), n, sum(map(one, t)), score))
    return res


@pytest.mark.parametrize("shard,order", [(40, 3), (ngramlm.SHARD, 3), (40, 2)])
def test_language_model_matches_brute_force(spark, shard, order):
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(60)] + ["The", "É"]
    weight = 1 / np.arange(1, len(vocab) + 1)
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(0, 40), p=weight / weight.sum()))) for i in range(90)]
    rows += [(90, None), (91, "x" * 50_000), (92, "new words only here"), (92, "new words only here"), (None, "the w1")]
    rows += [(200 + i, "one passage that many documents share w1 w2 w1") for i in range(40)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id bigint, text string, score double").repartition(3)
    scored = ngramlm.score_texts(df, ~held_out("doc_id", 5, 1), shard, order).collect()
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, not r["train"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in scored))
    want = sorted((i if i is not None else -1, *r) for i, *r in brute_scores(rows, order))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(g[6] - w[6]) < 0.01 * w[2]  # quantised


def test_language_model_of_tricky_rows(tricky, empty):
    assert ngramlm.lm_report(tricky).count() == tricky.count()
    assert ngramlm.lm_report(empty).count() == 0
    none = ngramlm.score_texts(tricky, F.lit(False)).collect()
    assert len(none) == tricky.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in none)
    assert all(abs(r["base_score"]) < 1e-6 and abs(r["score"]) < 1e-6 for r in none)  # sums of up to 30,000 logarithms
