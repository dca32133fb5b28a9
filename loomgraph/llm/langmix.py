"""Language proportions of documents by expectation-maximisation over n-gram likelihoods.

Every byte trigram of a text, A-Z folded and everything that is no letter read
as a blank, comes from one of the learned languages.  EM finds the mixing
proportions; language sets grow by the strongest language while twice the gain
in log-likelihood beats ``PENALTY`` log(n) a language.  The largest proportion
of the chosen set is the prediction.

Trigram counts are summed over all training documents; a language's model is
``BUCKETS`` numbers, whatever the size of the corpus.

Defined cases: a null text or one without a Unicode letter is ``und`` with score 0;
without training rows every text is; null languages are not learned; repeated
rows are predicted each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import held_out
from loomgraph.llm.textcodes import Block, blocks

BUCKETS, SMOOTH = 1 << 16, 0.5
#: EM of a text ends when a round adds less than this to its log-likelihood.
TOLERANCE, PENALTY = 1e-4, 4.0

_FOLD = np.full(256, 32, np.uint8)
for _c in (*range(97, 123), *range(128, 256)):
    _FOLD[_c] = _c
for _c in range(65, 91):
    _FOLD[_c] = _c + 32


def trigrams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every trigram with at least one letter; a text is framed by blanks."""
    n = len(block.data)
    c = np.full(n + 2, 32, np.uint32)
    c[1:-1] = _FOLD[block.data]
    size = block.ends - block.starts
    text = np.repeat(np.arange(len(block)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(block.starts, size)
    left, mid, right = c[at], c[at + 1], c[at + 2]
    left = np.where(at == block.starts[text], 32, left)
    right = np.where(at == block.ends[text] - 1, 32, right)
    code = (left << np.uint32(16)) | (mid << np.uint32(8)) | right
    some = (mid != 32) | ((left != 32) & (right != 32))
    code = code[some].astype(np.uint64)
    return text[some], ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def has_letter(block: Block) -> np.ndarray:
    """True for texts with a Unicode letter."""
    low = block.data | 32
    plain = np.flatnonzero((low >= 97) & (low <= 122))
    out = np.searchsorted(plain, block.ends) > np.searchsorted(plain, block.starts)
    wide = np.flatnonzero(block.data >= 128)
    for i in np.flatnonzero(~out & (np.searchsorted(wide, block.ends) > np.searchsorted(wide, block.starts))).tolist():
        out[i] = any(map(str.isalpha, block.data[block.starts[i] : block.ends[i]].tobytes().decode("utf-8", "replace")))
    return out


def ngram_counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, bucket, n) over all rows; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for b in blocks(batch.column(1)):
                owner, bucket = trigrams(b)
                mine = langs[b.first : b.first + len(b)]
                for one in set(mine):
                    which = mine == one
                    held = total.setdefault(one, np.zeros(BUCKETS, np.int64))
                    held += np.bincount(bucket[which[owner]], minlength=BUCKETS)
        for one, held in total.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(held[at])], ["lang", "bucket", "n"])

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # buckets x languages
    log_prior: np.ndarray

    def mixtures(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the chosen languages (texts x languages, 0 for the others) and the trigram count of each text."""
        owner, bucket = trigrams(block)
        n_texts, k = len(block), len(self.langs)
        key, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
        doc, bucket = key >> 16, key & (BUCKETS - 1)
        total = np.bincount(doc, weights=count, minlength=n_texts)
        letters = has_letter(block)
        total[~letters] = 0
        out = np.zeros((n_texts, k))
        if not len(key) or not k:
            return out, total
        log_p = self.log_p.T[:, bucket]  # a row a language, so that every sum runs over contiguous numbers
        top = log_p.max(0)
        p = np.exp(log_p - top)
        some, start = np.unique(doc, return_index=True)
        alone = np.add.reduceat(log_p * count, start, axis=1).T
        base = np.add.reduceat(top * count, start)
        weight = count.astype(float)
        prior = np.exp(self.log_prior)

        def em(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rounds until the log-likelihood of every text rests; texts leave as theirs does."""
            pi = mask * prior
            pi /= pi.sum(1, keepdims=True)
            fit = np.full(len(some), -np.inf)
            live, p_at, w_at, first_at, size = np.arange(len(some)), p, weight, start, np.diff(start, append=len(doc))
            on, used = np.ones(len(some), bool), np.flatnonzero(mask.any(0))
            while True:
                now_pi = pi[live]
                each = np.repeat(now_pi[:, used[0]], size)
                each *= p_at[used[0]]
                for j in used[1:]:
                    part = np.repeat(now_pi[:, j], size)
                    part *= p_at[j]
                    each += part
                now = base[live] + np.add.reduceat(w_at * np.log(each), first_at)
                moved = on & (now - fit[live] > TOLERANCE)
                fit[live[on]] = now[on]
                if not moved.any():
                    return pi, fit
                share = np.divide(w_at, each, out=each)
                new = 1e-9 * mask[live]
                for j in used:
                    new[:, j] += now_pi[:, j] * np.add.reduceat(p_at[j] * share, first_at)
                pi[live[moved]] = new[moved] / new[moved].sum(1, keepdims=True)
                on = moved
                if size[on].sum() < 0.75 * len(w_at):  # texts at rest are taken out when they are a quarter of the work
                    stays = np.repeat(on, size)
                    p_at, w_at, live, size = p_at[:, stays], w_at[stays], live[on], size[on]
                    first_at, on = np.cumsum(size) - size, np.ones(len(live), bool)

        full, _ = em(np.ones((len(some), k)))
        rank = np.argsort(-(full + 1e-12 * prior), axis=1, kind="stable")
        cost = PENALTY * np.log(total[some] + 1)
        first = (alone + self.log_prior).argmax(1)
        chosen = np.zeros((len(some), k))
        chosen[np.arange(len(some)), first] = 1.0
        best = 2 * alone[np.arange(len(some)), first]
        mask = chosen.copy()
        open_ = np.ones(len(some), bool)
        for size in range(2, k + 1):
            mask = mask.copy()
            for j in range(k):  # the strongest language not yet in the set joins it
                lang = rank[:, j]
                due = open_ & (mask.sum(1) < size) & (mask[np.arange(len(some)), lang] == 0)
                mask[np.flatnonzero(due), lang[due]] = 1.0
            pi, fit = em(mask)
            gain = open_ & (2 * fit - cost * (size - 1) > best)
            chosen[gain], best[gain] = pi[gain], (2 * fit - cost * (size - 1))[gain]
            open_ = gain
            if not open_.any():
                break
        out[some] = chosen
        out[~letters] = 0
        return out, total


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    got = ngram_counts(docs, lang, text).toPandas()  # languages x BUCKETS rows at most
    langs = sorted(got["lang"].unique().tolist())
    n = np.zeros((BUCKETS, len(langs)))
    column = {x: i for i, x in enumerate(langs)}
    n[got["bucket"].to_numpy(np.int64), np.array([column[x] for x in got["lang"]], np.int64)] = got["n"].to_numpy(np.int64)
    total = n.sum(0)
    log_p = np.log(n + SMOOTH) - np.log(total + SMOOTH * BUCKETS)
    return Model(langs, log_p, np.log(total / max(total.sum(), 1)))


def predict(docs: DataFrame, model: Model, extra: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, *extra, lang_pred, score, mixture) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id"), "text", *extra)
    kept = [i for i in range(len(rows.columns)) if i != 1]
    names = [rows.columns[i] for i in kept]
    schema = ", ".join([*[f"`{rows.schema[i].name}` {rows.schema[i].dataType.simpleString()}" for i in kept], "lang_pred string, score double, mixture string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in batches:
            for b in blocks(batch.column(1)):
                pi, total = mine.mixtures(b)
                langs, score, listed = [], [], []
                for row, n in zip(pi, total, strict=True):
                    if not n or not len(row):
                        langs.append("und")
                        score.append(0.0)
                        listed.append("")
                        continue
                    best = int(row.argmax())
                    langs.append(mine.langs[best])
                    score.append(min(1.0, float(row[best])))
                    listed.append(",".join(f"{mine.langs[j]}:{row[j]:.4f}" for j in np.argsort(-row, kind="stable") if row[j] > 0))
                part = batch.slice(b.first, len(b))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], pa.array(langs), pa.array(score), pa.array(listed)], [*names, "lang_pred", "score", "mixture"])

    return rows.mapInArrow(run, schema)


def language_report(docs: DataFrame) -> DataFrame:
    out = held_out("doc_id", 3, 1)
    model = train(docs.where(~out))
    return predict(docs, model, (out.alias("held_out"),)).select("doc_id", "held_out", "lang_pred", "score", "mixture")
