"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's score depends on its own shape and on that
of the lines before and after it; a transition score ties neighbouring labels.
Forward-backward gives each line's probability of being good, and a document's
quality is their mean, weighted by line length.

The field is fitted by maximum conditional likelihood (L-BFGS) on at most
``SAMPLE`` labelled documents, those whose ids hash lowest; each line takes its
document's label and each document counts once.  Only the text is an input.

Defined cases: a null or empty text is one empty line, with a score like any
other; without labelled rows, or with one label only, every score is that
label's share (0.5 without any); documents labelled twice with different values
take the smaller one; repeated rows are scored each; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import held_out, set_aside
from loomgraph.llm.textcodes import Block, blocks, sums

#: Most labelled documents the field is fitted on, and the score from which a document is accepted.
SAMPLE, ACCEPT = 4_000, 0.3
RIDGE, STEPS = 1e-3, 80


def _flags(*chosen) -> np.ndarray:
    out = np.zeros(256, bool)
    for c in chosen:
        out[list(c)] = True
    return out


_UPPER, _LOWER_CASE, _DIGIT = range(65, 91), range(97, 123), range(48, 58)
_MARKS = [ord(c) for c in ".,;:!?'\"()-"]
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum() and c not in _MARKS]
_BLANK = [0x20, *range(0x09, 0x0E)]
_SETS = [
    _flags(_UPPER),
    _flags(_UPPER, _LOWER_CASE, range(128, 256)),
    _flags(_DIGIT),
    _flags(_MARKS),
    _flags(_SIGNS),
    _flags(_BLANK),
    _flags([33, 63]),
    _flags([60, 62, 91, 93, 123, 125, 124, 47, 92]),
    _flags(range(128, 192)),  # continuation bytes, to count code points
]
SHAPE = 18


def lines_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every line, empty ones too."""
    n = len(block.data)
    bounds = np.zeros(n + 1, bool)
    if n:
        bounds[:n] = block.data == 10
    at = np.flatnonzero(bounds)
    text = np.searchsorted(block.starts, at, "right") - 1
    inside = at < block.ends[text] if len(at) else np.zeros(0, bool)
    at, text = at[inside], text[inside]
    start = np.concatenate([block.starts, at + 1])
    owner = np.concatenate([np.arange(len(block)), text])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    last = np.r_[owner[1:] != owner[:-1], True]
    end[last] = block.ends[owner[last]]
    return start, end, owner


def line_shapes(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in code points, text) of every line."""
    start, end, owner = lines_of(block)
    n = len(start)
    size = (end - start).astype(float)
    total = np.zeros(len(block.data) + 1, np.int32)
    counts = []
    for flags in _SETS:
        np.cumsum(flags[block.data], out=total[1:])
        counts.append((total[end] - total[start]).astype(float))
    upper, letters, digits, marks, signs, blanks, shout, code, more = counts
    points = size - more
    some = np.maximum(size, 1)
    begin, stop, _ = block.words()
    h = block.hashes(begin, stop)
    line = np.searchsorted(start, begin, "right") - 1
    while len(line) and (wrong := begin >= end[line]).any():  # an empty line at the same place
        line[wrong] -= 1
    words = np.bincount(line, minlength=n).astype(float)
    any_word = np.maximum(words, 1)
    order = np.lexsort((h, line))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])][: len(h)]
    distinct = sums(new.astype(float), line[order], n)
    pair = (h[1:] == h[:-1]) & (line[1:] == line[:-1]) if len(h) else np.zeros(0, bool)
    again = sums(pair.astype(float), line[1:], n) if len(h) else np.zeros(n)
    sign_end = sums(_flags(_SIGNS, [33])[block.data[stop - 1]].astype(float), line, n) if len(h) else np.zeros(n)
    alone = sums((stop - begin == 1).astype(float), line, n)
    line_hash = block.hashes(start, np.maximum(end, start)) if n else np.zeros(0, np.uint64)
    order = np.lexsort((line_hash, owner))
    first = np.r_[True, (line_hash[order][1:] != line_hash[order][:-1]) | (owner[order][1:] != owner[order][:-1])][:n]
    copy = np.zeros(n)
    copy[order] = ~first
    closed = np.zeros(n)
    full = size > 0
    closed[full] = _flags([ord(c) for c in ".!?"])[block.data[end[full] - 1]]
    x = np.stack(
        [
            np.log1p(points) / 5,
            upper / np.maximum(letters, 1),
            letters / some,
            digits / some,
            marks / some,
            signs / some,
            blanks / some,
            shout / some,
            code / some,
            size / any_word / 10 * (words > 0),
            distinct / any_word,
            again / any_word,
            sign_end / any_word,
            alone / any_word,
            copy,
            closed,
            (words < 3).astype(float),
            np.ones(n),
        ],
        axis=1,
    )
    x[:, 9] = np.minimum(x[:, 9], 5)
    return x, points, owner


def with_neighbours(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after (zero at the ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = owner[1:] == owner[:-1]
    before[1:][same] = x[:-1][same]
    after[:-1][same] = x[1:][same]
    return np.concatenate([x, before, after], axis=1)


def forward_backward(unary: np.ndarray, owner: np.ndarray, stay: np.ndarray, pairs: bool = False):
    """Marginals of "good" for chains laid end to end.

    ``unary`` is the score of good against bad, ``stay`` the 2 x 2 transition
    scores.  All chains of a block move together, longest first.  With ``pairs``
    also the log partition of every chain and the sum of pair marginals.
    """
    n_chains = int(owner[-1]) + 1 if len(owner) else 0
    size = np.bincount(owner, minlength=n_chains)
    start = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    score = np.zeros((len(unary), 2))
    score[:, 1] = unary
    f, b = np.empty_like(score), np.zeros_like(score)
    live = n_chains
    f[start] = score[start]
    steps = []
    for t in range(1, int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -t, "left"))
        at = start[:live] + t
        old = f[at - 1]
        f[at, 0] = np.logaddexp(old[:, 0] + stay[0, 0], old[:, 1] + stay[1, 0])
        f[at, 1] = np.logaddexp(old[:, 0] + stay[0, 1], old[:, 1] + stay[1, 1]) + score[at, 1]
        steps.append(live)
    for t in range(len(steps), 0, -1):
        at = start[: steps[t - 1]] + t
        new = b[at] + score[at]
        b[at - 1, 0] = np.logaddexp(new[:, 0] + stay[0, 0], new[:, 1] + stay[0, 1])
        b[at - 1, 1] = np.logaddexp(new[:, 0] + stay[1, 0], new[:, 1] + stay[1, 1])
    both = f + b
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    if not pairs:
        return good
    z = np.logaddexp(both[:, 0], both[:, 1])
    link = np.flatnonzero(owner[1:] == owner[:-1])
    xi = f[link][:, :, None] + stay + (score + b)[link + 1][:, None, :] - z[link][:, None, None]
    return good, z, link, np.exp(xi)


@dataclass
class Field:
    weights: np.ndarray
    stay: np.ndarray
    constant: float | None = None

    def marginals(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return forward_backward(with_neighbours(x, owner) @ self.weights, owner, self.stay)


def fit(x: np.ndarray, owner: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Field:
    """The field for lines ``x`` of documents ``owner`` with labels 0 or 1."""
    if not len(label) or label.min() == label.max():
        return Field(np.zeros(3 * SHAPE), np.zeros((2, 2)), float(label.mean()) if len(label) else 0.5)
    full = with_neighbours(x, owner)
    y = label[owner]
    size = np.bincount(owner, minlength=len(label))
    share = 1.0 / size  # each document counts once
    n = len(label)

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        w, stay = theta[:-4], theta[-4:].reshape(2, 2)
        unary = full @ w
        good, z, link, xi = forward_backward(unary, owner, stay, True)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        truth = sums(unary * y, owner, n) + (size - 1) * stay[label, label]
        value = (share * (z[first] - truth)).sum() / n + RIDGE / 2 * theta @ theta
        g = full.T @ (share[owner] * (good - y)) / n
        h = (share[owner[link]][:, None, None] * xi).sum(0)
        for c in (0, 1):
            h[c, c] -= (share * (size - 1))[label == c].sum()
        return value, np.concatenate([g, h.ravel() / n]) + RIDGE * theta

    theta = lbfgs(loss, np.zeros(full.shape[1] + 4), steps)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def lbfgs(loss, theta: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    value, grad = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d = grad.copy()
        used = []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            d -= a * y
            used.append((a, s, y))
        if past:
            s, y = past[-1]
            d *= (s @ y) / (y @ y)
        for a, s, y in reversed(used):
            d += s * (a - (y @ d) / (s @ y))
        step = 1.0 if past else min(1.0, 1.0 / (np.abs(grad).sum() + 1e-12))
        slope = grad @ d
        for _ in range(25):
            new = theta - step * d
            v, g = loss(new)
            if v <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - theta, g - grad
        if s @ y > 1e-12:
            past = [*past[-(memory - 1) :], (s, y)]
        done = value - v < 1e-9 * max(1.0, abs(v))
        theta, value, grad = new, v, g
        if done:
            break
    return theta


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int = 5, part: int = 0, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y): at most ``sample`` labelled documents outside the held-out part, lowest hash first."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", parts, part))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().join(known, "doc_id")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Line shapes are made by the tasks; what reaches the driver is bounded by ``sample`` documents."""
    rows = sample_rows(docs, labels, "quality", sample=sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                x, _, owner = line_shapes(b)
                size = np.bincount(owner, minlength=len(b))
                end = np.cumsum(size)
                raw = [x[e - k : e].astype(np.float32).tobytes() for e, k in zip(end.tolist(), size.tolist(), strict=True)]
                part = batch.slice(b.first, len(b))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(raw, pa.binary())], ["doc_id", "y", "x"])

    got = rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id bigint, y int, x binary").orderBy("doc_id").collect()
    shapes = [np.frombuffer(r["x"], np.float32).reshape(-1, SHAPE).astype(float) for r in got]
    owner = np.repeat(np.arange(len(shapes)), [len(s) for s in shapes])
    x = np.concatenate(shapes) if shapes else np.zeros((0, SHAPE))
    return fit(x, owner, np.array([r["y"] for r in got], np.int64))


def quality_of(block: Block, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, lines, good lines) of every text of a block."""
    x, points, owner = line_shapes(block)
    good = field.marginals(x, owner)
    weight = points + 1.0
    score = sums(good * weight, owner, len(block)) / sums(weight, owner, len(block))
    return score, np.bincount(owner, minlength=len(block)), np.bincount(owner, weights=good >= 0.5, minlength=len(block))


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with quality_score, n_lines and n_good_lines added."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], "quality_score double, n_lines bigint, n_good_lines bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(names.index("text"))):
                score, lines, good = quality_of(b, shared.value)
                part = batch.slice(b.first, len(b))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.clip(score, 0, 1)), pa.array(lines.astype(np.int64)), pa.array(good.astype(np.int64))],
                    [*names, "quality_score", "n_lines", "n_good_lines"],
                )

    return docs.mapInArrow(run, schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    score = F.col("quality_score")
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), score.alias("score"), F.when(score >= ACCEPT, 1).otherwise(0).alias("predicted"), "n_lines", "n_good_lines")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows the field rejects; all columns stay, whatever their names.

    Null and empty texts are one empty line and are scored like any other; an
    empty table stays empty; of rows that repeat an id each is judged by its text.
    """
    plain = set_aside(docs)
    good = scored(plain, train(docs, labels)).where(F.col("quality_score") >= ACCEPT)
    return good.select(*plain.columns).toDF(*docs.columns)
