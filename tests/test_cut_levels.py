"""Sparsest cuts in one task against the distributed steps."""

import itertools
import random

from loomgraph.operators import cuts


def _graph(spark):
    rng = random.Random(4)
    w = {}
    for c in range(5):
        for a, b in itertools.combinations(range(10 * c, 10 * c + 8), 2):
            if rng.random() < 0.7 or b == a + 1:
                w[a, b] = rng.random() + 0.2
        w[10 * c, 10 * ((c + 1) % 5) + 3] = 0.05 * (c + 1)
    w[3, 60] = w[60, 61] = 0.01  # a tail that min_within drops
    rows = [(a, b, x) for (i, j), x in w.items() for a, b in ((i, j), (j, i))] + [(7, 7, 2.0), (80, 80, 1.0), (90, 91, 1.0), (91, 90, 1.0)]
    return spark.createDataFrame(rows, "i long, j long, w double")


def _blocks(frame):
    got = [(r["node_id"], r["block"]) for r in frame.collect()]
    assert len(got) == len(set(got))
    return dict(got)


def test_levels_need_no_round_outside_their_task(spark, monkeypatch):
    def gone(*_, **__):
        raise AssertionError("a distributed round")

    monkeypatch.setattr(cuts, "second_vectors", gone)
    blocks = _blocks(cuts.sparsest_cut_blocks(_graph(spark), 4, 0.25))
    assert len(blocks) == 45 and blocks[80] == 80 and blocks[91] == 90
    assert len(set(blocks.values())) == 7


def test_a_level_in_a_task_equals_the_distributed_one(spark):
    g = _graph(spark).cache()
    more = {"min_within": 0.3, "stopping_assoc": 3, "max_size": 60, "max_depth": 1}
    want = _blocks(cuts.sparsest_cut_blocks(g, 4, 0.25, most=0, **more))
    assert _blocks(cuts.sparsest_cut_blocks(g, 4, 0.25, **more)) == want
