"""Exact top-k search by exhaustive term-at-a-time accumulation.

Components become integer weights floor(64 x).  Vectors are packed into blocks;
every block of queries meets every block of candidates once.  In such a tile
each term (dimension) is taken in turn: its postings, the candidates with a
nonzero weight, are scattered with the weight of each query that has the term
into a dense score array.  ``numpy.partition`` keeps a tile's k best a query, and
the tiles' lists are merged by a window over the query.

Defined cases: vectors that are null or hold a null or non-finite component
take no part; vectors of other lengths are read as sparse rows, absent terms
being zero; a query never meets rows of its own id; with fewer than k
candidates all are returned; ties go to the smaller id; every row that repeats
an id is a candidate, and query rows of one id share one list of k; null ids
take no part; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE = 64
#: Rows of a candidate block and of a query block; a tile's scores are 1,024 x 8,192 numbers at most, in slices of queries.
CANDIDATES, QUERIES, SLICE = 8_192, 1_024, 128
#: Tasks of the tiles at most; each then takes several.
TASKS = 20_000

_TILE = "query_id bigint, vec_id bigint, score bigint"


def weights(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, w): integer weights of the vectors that take part."""
    w = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.col(vec_id).isNotNull() & F.col("w").isNotNull() & F.forall("w", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.withColumn("w", w).where(ok)
    ints = F.transform("w", lambda x: F.floor(x * SCALE).cast("bigint"))
    return rows.select(F.col(vec_id).cast("bigint").alias("id"), ints.alias("w"))


def _blocks(rows: DataFrame, name: str, size: int, count: int) -> DataFrame:
    """(name, ids, values, width): rows packed by a hash of their id and place, so that a repeated id fills no block alone."""
    blocks = max(1, -(-count // size))
    keyed = rows.select(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias(name), "id", "w")

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        lists = t["w"].combine_chunks()
        lens = lists.value_lengths().to_numpy()
        width = int(lens.max(initial=0))
        dense = np.zeros((len(ids), width), np.int64)
        flat = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(ids)), lens)
        dense[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
        small = np.abs(dense).max(initial=0) < 2**15
        dense = dense.astype(np.int16 if small else np.int64)
        return pa.table(
            {
                name: pa.array([key[0].as_py()], pa.int32()),
                "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
                "values": pa.array([dense.tobytes()], pa.binary()),
                "width": pa.array([width], pa.int32()),
                "small": pa.array([bool(small)]),
            }
        )

    schema = f"{name} int, ids binary, values binary, width int, small boolean"
    return keyed.groupBy(name).applyInArrow(pack, schema)


def _unpack(ids: bytes, values: bytes, width: int, small: bool) -> tuple[np.ndarray, np.ndarray]:
    ident = np.frombuffer(ids, np.int64)
    dense = np.frombuffer(values, np.int16 if small else np.int64).reshape(len(ident), width)
    return ident, dense


def accumulate(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Score array of queries x candidates, one term after the other."""
    terms = min(q.shape[1], c.shape[1])
    top = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(terms, 1)
    kind = np.int32 if top < 2**31 else np.int64
    score = np.zeros((len(q), len(c)), kind)
    for t in range(terms):
        having = np.flatnonzero(q[:, t])
        post = np.flatnonzero(c[:, t])
        if not len(having) or not len(post):
            continue
        if 2 * len(post) > len(c):  # the posting list is nearly all rows: add it whole
            column = c[:, t].astype(kind)
            for r in having:
                score[r] += column * kind(q[r, t])
        else:
            column = c[post, t].astype(kind)
            for r in having:
                score[r, post] += column * kind(q[r, t])
    return score


def _best(score: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best of one score row, ties by smaller id, without the query's own row."""
    at = np.flatnonzero(ids != own)
    s = score[at]
    if len(at) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        at, s = at[s >= least], s[s >= least]
    return at[np.lexsort((ids[at], -s.astype(np.int64)))[:k]]


def top_k(vectors: DataFrame, vec_id: str, vector: str, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries whose id is divisible by ``every``."""
    rows = weights(vectors, vec_id, vector)
    n_rows, n_queries = vectors.agg(F.count(F.lit(1)), F.count_if(F.col(vec_id) % every == 0)).first()
    n_blocks, c_blocks = max(1, -(-n_queries // QUERIES)), max(1, -(-n_rows // CANDIDATES))
    candidates = _blocks(rows, "c", CANDIDATES, n_rows)
    queries = _blocks(rows.where(F.col("id") % every == 0), "q", QUERIES, n_queries)
    # both sides are laid out tile by tile, so that no task sees all candidates of a query block
    tasks = min(n_blocks * c_blocks, TASKS)
    left = candidates.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).repartition(tasks, "q", "c")
    right = queries.select("q", *[F.col(x).alias(f"q_{x}") for x in ("ids", "values", "width", "small")])
    right = right.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))).repartition(tasks, "q", "c")
    tiles = left.join(right, ["q", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c_ids, c = _unpack(r["ids"], r["values"], r["width"], r["small"])
                q_ids, q = _unpack(r["q_ids"], r["q_values"], r["q_width"], r["q_small"])
                for a in range(0, len(q_ids), SLICE):
                    score = accumulate(q[a : a + SLICE], c)
                    got = [_best(score[i], c_ids, own, k) for i, own in enumerate(q_ids[a : a + SLICE])]
                    lens = [len(g) for g in got]
                    at = np.concatenate(got) if got else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "query_id": np.repeat(q_ids[a : a + SLICE], lens),
                            "vec_id": c_ids[at],
                            "score": score[np.repeat(np.arange(len(got)), lens), at].astype(np.int64),
                        }
                    )

    best = tiles.mapInArrow(run, _TILE)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
