"""Mixing a corpus to target token shares of domains with soft membership.

A classifier fitted on a labelled table gives every document a posterior over
domains.  Documents get the nonnegative rates x that minimise

    1/2 sum_d r_d^2 / h_d + RIDGE/2 sum_i t_i/T (x_i - 1)^2,   r_d = (sum_i p_id t_i x_i - b_d) / T,

with t_i the tokens of a document, b_d = weight_d T and h_d = sum_i p_id^2 t_i / T
the curvature of a domain, so that a rare domain meets its target as a common
one does.  The least rates are x_i = max(0, 1 - p_i l) for one multiplier l_d =
r_d / (RIDGE h_d) a domain, and Newton steps on these need one small sum over all
documents each.  They end when every domain's r_d is within STILL (weight_d +
h_d) of RIDGE h_d l_d.

Defined cases: a null or empty text has no tokens and rate 1; targets are
scaled to sum to 1; a domain without any mass keeps its shortfall; without
labelled rows all domains are equally likely; documents labelled twice with
different values take the smaller label; repeated rows count each; an empty
table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import keep
from loomgraph.llm.linecrf import SHAPE, lbfgs, line_shapes
from loomgraph.llm.textcodes import Block, blocks, sums

#: Target shares of tokens by domain of the labelled table.
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}
#: Most labelled documents the classifier is fitted on, its words, and how many of these documents must hold a word.
SAMPLE, WORDS, LEAST = 4_000, 4_096, 8
RIDGE, PENALTY = 1e-4, 1e-4
ROUNDS, STILL = 200, 1e-6


def domain_of(quality: str = "quality", toxic: str = "toxic") -> F.Column:
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 1, "good").when(F.col(quality) == 0, "poor")


def _words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct words of each text, their marks stripped, and the token count of each text."""
    begin, end, text = block.words()
    n_tokens = np.bincount(text, minlength=len(block))
    inner, stop, owner = block.pieces(_LETTER[block.data])
    h = block.hashes(inner, stop)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new], n_tokens


_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def _dense(block: Block) -> np.ndarray:
    """Mean line shape of each text, weighted by length, and the log of its length."""
    x, points, owner = line_shapes(block)
    w = points + 1
    total = sums(w, owner, len(block))
    mean = np.stack([sums(x[:, j] * w, owner, len(block)) / total for j in range(SHAPE)], axis=1)
    mean[:, 0] = np.log1p(total) / 10
    return mean


@dataclass
class Classifier:
    domains: list[str]
    words: np.ndarray  # sorted hashes
    dense: np.ndarray  # SHAPE x domains
    word: np.ndarray  # words x domains

    def posteriors(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(texts x domains, tokens)."""
        owner, h, n_tokens = _words(block)
        score = _dense(block) @ self.dense
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            for d in range(len(self.domains)):
                score[:, d] += sums(self.word[at[hit], d], owner[hit], len(block))
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(1, keepdims=True), n_tokens


def train(docs: DataFrame, labels: DataFrame, domains: list[str], sample: int = SAMPLE) -> Classifier:
    """Softmax regression on word presence and mean line shape; features are made by the tasks, ``sample`` bounds what the driver sees."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), domain_of().alias("domain")).where("doc_id is not null and domain is not null")
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().join(known, "doc_id")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                owner, h, _ = _words(b)
                x = _dense(b)
                n = np.bincount(owner, minlength=len(b))
                end = np.cumsum(n)
                part = batch.slice(b.first, len(b))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([r.tobytes() for r in x], pa.binary()),
                        pa.array([h[e - k : e].tobytes() for e, k in zip(end.tolist(), n.tolist(), strict=True)], pa.binary()),
                    ],
                    ["doc_id", "domain", "x", "h"],
                )

    made = keep(rows.select("doc_id", "text", "domain").mapInArrow(run, "doc_id bigint, domain string, x binary, h binary"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h.as_buffer(), np.int64))], ["h"])

    often = made.select("h").mapInArrow(explode, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    words = np.sort(np.array([r[0] for r in often.orderBy(F.desc("n"), "h").limit(WORDS).collect()], np.int64).view(np.uint64))
    kind = {d: i for i, d in enumerate(domains)}
    got = [r for r in made.orderBy("doc_id").collect() if r["domain"] in kind]
    x = np.array([np.frombuffer(r["x"], float) for r in got]).reshape(-1, SHAPE)
    y = np.array([kind[r["domain"]] for r in got], np.int64)
    owner, column = [], []
    for i, r in enumerate(got):
        h = np.frombuffer(r["h"], np.uint64)
        at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
        hit = at[words[at] == h] if len(words) else np.zeros(0, np.int64)
        owner.append(np.full(len(hit), i))
        column.append(hit)
    owner, column = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (owner, column))
    k, m = len(domains), len(words)
    if not len(y):
        return Classifier(domains, words, np.zeros((SHAPE, k)), np.zeros((m, k)))
    one = np.eye(k)[y]

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        dense, word = theta[: SHAPE * k].reshape(SHAPE, k), theta[SHAPE * k :].reshape(m, k)
        score = x @ dense
        for d in range(k):
            score[:, d] += np.bincount(owner, weights=word[column, d], minlength=len(y))
        top = score.max(1, keepdims=True)
        z = top[:, 0] + np.log(np.exp(score - top).sum(1))
        p = np.exp(score - z[:, None])
        value = (z - score[np.arange(len(y)), y]).mean() + PENALTY / 2 * theta @ theta
        err = (p - one) / len(y)
        gw = np.stack([np.bincount(column, weights=err[owner, d], minlength=m) for d in range(k)], axis=1) if m else np.zeros((0, k))
        return value, np.concatenate([(x.T @ err).ravel(), gw.ravel()]) + PENALTY * theta

    theta = lbfgs(loss, np.zeros((SHAPE + m) * k), 100)
    return Classifier(domains, words, theta[: SHAPE * k].reshape(SHAPE, k), theta[SHAPE * k :].reshape(m, k))


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, tokens, p): expected domains of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                p, tokens = shared.value.posteriors(b)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, len(b)), pa.array(tokens.astype(np.int64)), flat], ["doc_id", "tokens", "p"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, tokens bigint, p array<double>")


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    t = batch.column(0).to_numpy().astype(float)
    return t, batch.column(1).flatten().to_numpy().reshape(len(t), -1)


def _totals(members: DataFrame, l: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums of t x^2, t p x, and t p p' over rates above 0, at multipliers ``l``."""
    k = len(l)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            if batch.num_rows:
                t, p = _columns(batch)
                x = np.maximum(0.0, 1 - p @ l)
                total += np.concatenate([[t @ x**2], (t * x) @ p, ((p * (t * (x > 0))[:, None]).T @ p).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

    out = np.zeros(1 + k + k * k)
    for r in members.select("tokens", "p").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out[0], out[1 : 1 + k], out[1 + k :].reshape(k, k)


def _multipliers(members: DataFrame, weights: np.ndarray, rounds: int) -> np.ndarray:
    l = np.zeros(len(weights))
    square, at, curve = _totals(members, l)
    total = square  # all rates are 1
    if not total:
        return l
    h = np.diag(curve) / total
    some = np.flatnonzero(h > 0)  # a domain without any mass keeps its shortfall
    ridge = RIDGE * h

    def value(square: float, l: np.ndarray) -> float:
        return square / total / 2 + ridge @ l**2 / 2 + weights @ l

    for _ in range(rounds):
        down = (at / total - weights - ridge * l)[some]
        if (np.abs(down) <= STILL * (weights + h)[some]).all():
            return l
        scale = 1 / np.sqrt(h[some])
        step = np.zeros(len(l))
        bent = (curve / total + np.diag(ridge))[np.ix_(some, some)]
        step[some] = scale * np.linalg.solve(bent * np.outer(scale, scale), scale * down)
        here, size = value(square, l), 1.0
        while True:
            new = _totals(members, l + size * step)
            # where values no longer tell steps apart, full steps are taken
            if value(new[0], l + size * step) <= here - 1e-4 * size * (down @ step[some]) + 1e-13 * (1 + abs(here)) or size < 1e-9:
                break
            size /= 2
        l = l + size * step
        square, at, curve = new
    raise RuntimeError(f"rates did not settle in {rounds} rounds")


def fit_rates(members: DataFrame, weights: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, tokens, p, rate) for a table of memberships; raises when the residuals have not come to rest."""
    members = keep(members.select("doc_id", "tokens", "p"))
    l = _multipliers(members, weights, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, p = _columns(batch.select(["tokens", "p"]))
            rate = np.where(t > 0, np.maximum(0.0, 1 - p @ l), 1.0) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], ["doc_id", "tokens", "p", "rate"])

    return members.mapInArrow(run, "doc_id bigint, tokens bigint, p array<double>, rate double")


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """(doc_id, domain, tokens, posteriors, rate, copies) for every row; ``copies`` is the rate rounded by a hash of the id."""
    domains = sorted(targets)
    weights = np.array([targets[d] for d in domains])
    weights = weights / weights.sum()
    rates = fit_rates(memberships(docs, train(docs, labels, domains)), weights)
    names = F.array(*[F.lit(d) for d in domains])
    best = F.array_position("p", F.array_max("p")).cast("int")
    draw = F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(1 << 20)) / F.lit(1 << 20)
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("bigint")
    posteriors = [F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(domains)]
    return rates.select("doc_id", F.element_at(names, best).alias("domain"), "tokens", *posteriors, "rate", copies.alias("copies"))
