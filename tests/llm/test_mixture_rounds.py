"""Texts whose proportions rest after different numbers of rounds do not touch each other."""

import numpy as np
import pyarrow as pa

from loomgraph.llm import langmix
from loomgraph.llm.textcodes import blocks


def test_a_text_has_the_same_mixture_alone_and_among_others():
    rng = np.random.default_rng(11)
    log_p = np.log(rng.dirichlet(np.ones(4), langmix.BUCKETS) * 0.3 + 0.7 / 4)
    model = langmix.Model(["a", "b", "c", "d"], log_p, np.log(np.array([0.4, 0.3, 0.2, 0.1])))
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    texts = ["".join(rng.choice(letters, int(n))) for n in [3, 50_000, 10, 400, 5_000, 1, 20_000, 90, 3_000] * 2] + ["", None, "...", "漢"]
    together, total = model.mixtures(next(blocks(pa.array(texts, pa.string()))))
    assert len(together) == len(texts)
    for text, pi, n in zip(texts, together, total, strict=True):
        alone, m = model.mixtures(next(blocks(pa.array([text], pa.string()))))
        assert np.allclose(alone[0], pi, atol=1e-9) and m[0] == n
        assert not n or abs(pi.sum() - 1) < 1e-6


def test_a_block_holds_a_long_text_and_short_ones():
    texts = ["x" * 280_000, "y", "z"]
    assert len(next(blocks(pa.array(texts, pa.string())))) == 3
    assert [len(b) for b in blocks(pa.array(texts, pa.string()), 1 << 18)] == [1, 2]
