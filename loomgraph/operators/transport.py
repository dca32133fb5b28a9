"""Minimum-cost assignment with capacities by a parallel auction.

Rows bid for columns; a column with capacity c keeps the c highest bids.  With
integer costs multiplied by (rows + 1) and a bid step of 1 the result is
optimal (Bertsekas and Castanon, "The auction algorithm for the transportation
problem").  Every round is one join of the open rows' arcs with the column
prices and two aggregations; several problems (``keys``, for instance the
members of an ensemble) are solved in the same rounds.

``optimal`` needs no small bid step: a coarse auction finds places for all
rows, then units move along negative cycles of the graph of columns (an edge is
the cheapest move of a row from one column to another) until none is left.
Shortest distances in that graph are then prices that prove the optimum.

Where rows outbid each other for more than ``AUCTION_ROUNDS`` rounds, ``settled``
starts anew from the other side: every row takes its cheapest column, and rows
leave overfull columns along cheapest moves while prices keep every row at a
cheapest column.  Its steps grow with the levels of cost and not with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from loomgraph.core.session import cut
from loomgraph.operators.registration import lexicographic

# Rounds after which a coarse auction is left for ``settled``.
AUCTION_ROUNDS = 32
# Problems x columns x columns that the driver may see; beyond, the auction goes on.
MAX_PAIRS = 1 << 20
# Kinds of rows (column, equally cheap columns) looked at for one move in a step, the commonest first.
KINDS = 8
# Arcs of a problem that one task holds; larger problems take the same steps as joins.
ARCS = 1 << 22
# Columns whose set fits a word.
WORD = 62
# No way between two columns.
FAR = np.int64(1 << 62)


class StillBidding(RuntimeError):
    """An auction that did not end within its rounds."""


def auction(
    arcs: DataFrame, capacity: DataFrame, keys: Sequence[str] = (), step: int = 1, exact: bool = True, max_rounds: int = 1_000
) -> tuple[DataFrame, DataFrame, int]:
    """Assignment (keys, a, b, unit_cost), the rows left over, and the rounds.

    ``arcs`` is (keys, a, b, unit_cost), ``capacity`` is (b, capacity).  A row
    whose price passes what a feasible problem can reach is left over: its
    candidates are blocked by other rows and it needs more of them.  Without
    ``exact`` the total is within rows x ``step`` of the optimum, in fewer rounds.
    """
    keys = list(keys)
    n_rows = arcs.select(*keys, "a").distinct().count()
    scale = (n_rows + 1) if exact else 1
    arcs = cut(arcs.select(*keys, "a", "b", "unit_cost").withColumn("value", -F.col("unit_cost") * F.lit(scale)))
    spread = arcs.agg(F.max("unit_cost") - F.min("unit_cost")).first()[0] or 0
    limit = (2 * n_rows + 1) * (spread * scale + step)
    cols = cut(capacity.where("capacity > 0").select("b", "capacity"))
    arcs = arcs.join(cols.select("b"), "b", "left_semi")
    whole = dict(arcs.dtypes)["unit_cost"] in ("int", "bigint") and limit < 1 << 62 and not arcs.where("unit_cost is null or a is null").limit(1).count()
    if whole and _held_by_tasks(arcs, keys) and cols.count() == cols.select("b").distinct().count():
        return _auction_in_tasks(cut(arcs), cols, keys, limit, spread * scale + step, step, max_rounds)
    all_rows = cut(arcs.select(*keys, "a").distinct())
    held = all_rows.limit(0).select(*keys, "a", F.lit(0).cast(dict(arcs.dtypes)["b"]).alias("b"), F.lit(0).cast("long").alias("bid"))
    price = arcs.limit(0).select(*keys, "b", F.lit(0).cast("long").alias("price"))
    lost = all_rows.limit(0)
    rounds = 0
    while rounds < max_rounds:
        rounds += 1
        open_rows = all_rows.join(held, [*keys, "a"], "left_anti").join(lost, [*keys, "a"], "left_anti")
        offers = arcs.join(open_rows, [*keys, "a"]).join(price, [*keys, "b"], "left")
        offers = offers.withColumn("net", F.col("value") - F.coalesce("price", F.lit(0)))
        w = Window.partitionBy(*keys, "a").orderBy(F.desc("net"), "b")
        top = offers.withColumn("r", F.row_number().over(w)).where("r <= 2")
        best = top.groupBy(*keys, "a").agg(
            F.min_by("b", "r").alias("b"), F.max("net").alias("n1"), F.min("net").alias("n2"), F.count(F.lit(1)).alias("c"), F.min_by("price", "r").alias("p")
        )
        gap = F.when(F.col("c") > 1, F.col("n1") - F.col("n2")).otherwise(F.lit(spread * scale + step))
        bids = best.select(*keys, "a", "b", (F.coalesce("p", F.lit(0)) + gap + step).alias("bid"))
        bids = cut(bids)
        if not bids.limit(1).count():
            break
        gone = bids.where(F.col("bid") > limit).select(*keys, "a")
        fresh = held.unionByName(bids.where(F.col("bid") <= limit)).join(cols, "b")
        order = Window.partitionBy(*keys, "b").orderBy(F.desc("bid"), "a")
        kept = fresh.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("capacity"))
        held = cut(kept.drop("place"))
        full = held.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("n"), F.min("bid").alias("low"), F.max("capacity").alias("capacity"))
        price = cut(full.where("n >= capacity").select(*keys, "b", F.col("low").alias("price")))
        held = held.drop("capacity")
        lost = cut(lost.unionByName(gone))
    else:
        raise StillBidding(f"rows still bid after {max_rounds} rounds")
    out = held.join(arcs.select(*keys, "a", "b", "unit_cost"), [*keys, "a", "b"])
    rest = all_rows.join(held, [*keys, "a"], "left_anti")
    return out.select(*keys, "a", "b", "unit_cost"), rest, rounds


def grow_candidates(k: int, places: int, soft_cap: int = 256) -> int:
    """Next candidate count of a blocked row: doubled, 32 more at least, held at the cap when below it, ``places`` at most."""
    wider = max(k + 32, min(places, 2 * k))
    if 0 < k < soft_cap:
        wider = min(wider, soft_cap)
    return min(wider, places)


def assignment_hash(assignment: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order-free fingerprint and objective per problem."""
    h = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).cast("string")
    return assignment.groupBy(*keys).agg(h.alias("hash"), F.sum("unit_cost").alias("objective"), F.count(F.lit(1)).alias("n"))


# The column that stands for spare capacity; columns have numbers from 0 on.
POOL = -1
# Rows that may take one edge of a cycle in the same step.
BUNDLE = 64


@dataclass
class Optimum:
    assigned: DataFrame  # keys, a, b, unit_cost
    prices: DataFrame  # keys, b, price: 0 where capacity is spare, never negative
    rest: DataFrame  # keys, a: rows for which the candidates leave no place
    steps: int


def _column_graph(held: DataFrame, arcs: DataFrame, cols: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, w, moves): the cheapest moves of a unit from column x to y, at most ``BUNDLE`` of (gain, a) a pair in order."""
    own = held.join(arcs, [*keys, "a", "b"]).select(*keys, "a", F.col("b").alias("x"), F.col("unit_cost").alias("own"))
    other = arcs.select(*keys, "a", F.col("b").alias("y"), "unit_cost")
    moves = own.join(other, [*keys, "a"]).where("x <> y").withColumn("gain", F.col("unit_cost") - F.col("own"))
    order = Window.partitionBy(*keys, "x", "y").orderBy("gain", "a")
    best = moves.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= BUNDLE)
    real = best.groupBy(*keys, "x", "y").agg(F.array_sort(F.collect_list(F.struct("gain", "a"))).alias("moves"))
    used = held.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("used"))
    each = held.select(*keys).distinct() if keys else None
    room = (each.crossJoin(F.broadcast(cols)) if each is not None else cols).join(used, [*keys, "b"], "left")  # a row per problem and column
    spare = F.col("capacity") - F.coalesce("used", F.lit(0))
    none = F.struct(F.lit(0).cast("long").alias("gain"), F.lit(None).cast(dict(held.dtypes)["a"]).alias("a"))
    leave = room.where(spare > 0).select(*keys, F.col("b").alias("x"), F.lit(POOL).cast("long").alias("y"), F.array_repeat(none, F.least(spare, F.lit(BUNDLE)).cast("int")).alias("moves"))
    enter = room.select(*keys, F.lit(POOL).cast("long").alias("x"), F.col("b").alias("y"), F.array_repeat(none, BUNDLE).alias("moves"))
    out = real.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "moves")
    return reduce(DataFrame.unionByName, [leave, enter], out).withColumn("w", F.col("moves")[0]["gain"])


def _relaxed(edges: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """One round of Bellman and Ford: (keys, node, d, up, fell)."""
    offers = edges.join(state.select(*keys, F.col("node").alias("x"), "d"), [*keys, "x"]).select(*keys, F.col("y").alias("node"), (F.col("d") + F.col("w")).alias("to"), "x")
    best = offers.groupBy(*keys, "node").agg(F.min(F.struct("to", "x")).alias("_m"))
    fell = F.coalesce(F.col("_m.to") < F.col("d"), F.lit(False))
    both = state.select(*keys, "node", "d", "up").join(best, [*keys, "node"], "left")
    return both.select(*keys, "node", F.when(fell, F.col("_m.to")).otherwise(F.col("d")).alias("d"), F.when(fell, F.col("_m.x")).otherwise(F.col("up")).alias("up"), fell.alias("fell"))


def _cycles(state: DataFrame, keys: list[str], nodes: int) -> DataFrame:
    """(keys, y, x, cycle): the edges x -> y of all cycles that the ``up`` pointers form, named by their least node; by pointer doubling."""
    link = state.where("up is not null").select(*keys, "node", "up")
    jump = cut(link.withColumn("low", F.least("node", "up")))
    reach = 1
    while reach < nodes:
        ahead = jump.select(*keys, F.col("node").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        jump = cut(jump.join(ahead, [*keys, "up"]).select(*keys, "node", F.col("up2").alias("up"), F.least("low", "low2").alias("low")))
        reach *= 2
        if not jump.limit(1).count():
            break
    on = jump.select(*keys, F.col("up").alias("node")).distinct()
    names = jump.select(*keys, "node", F.col("low").alias("cycle"))
    return link.join(on, [*keys, "node"]).join(names, [*keys, "node"]).select(*keys, F.col("node").alias("y"), F.col("up").alias("x"), "cycle")


def _rotated(held: DataFrame, edges: DataFrame, cycles: DataFrame, keys: list[str]) -> DataFrame:
    """``held`` after units moved along ``cycles``: as many on each as still pay, at most ``BUNDLE``."""
    length = cycles.groupBy(*keys, "cycle").agg(F.count(F.lit(1)).alias("length"))
    moves = cycles.join(edges, [*keys, "x", "y"]).select(*keys, "cycle", "y", F.posexplode("moves").alias("turn", "move"))
    turns = moves.groupBy(*keys, "cycle", "turn").agg(F.sum("move.gain").alias("gain"), F.count(F.lit(1)).alias("edges"))
    pays = turns.join(length, [*keys, "cycle"]).where("gain < 0 and edges = length").select(*keys, "cycle", "turn")
    to = moves.join(pays, [*keys, "cycle", "turn"]).where("move.a is not null").select(*keys, F.col("move.a").alias("a"), F.col("y").alias("_to"))
    new = F.coalesce(F.col("_to"), F.col("b")).cast(dict(held.dtypes)["b"])
    return held.join(to, [*keys, "a"], "left").select(*keys, "a", new.alias("b"))


def _raised(reach: np.ndarray, excess: np.ndarray, spare: np.ndarray) -> np.ndarray | None:
    """By how much each column's price may rise: until the first column with spare places is as cheap for a row of an overfull one.

    ``reach`` holds the least extra cost of a move between columns.  None if no overfull column reaches a spare place.
    """
    dist = np.where(excess > 0, 0, FAR)
    while True:
        known = (dist[:, None] < FAR) & (reach < FAR)
        new = np.minimum(dist, np.where(known, np.where(known, dist[:, None], 0) + np.where(known, reach, 0), FAR).min(axis=0))
        if (new == dist).all():
            break
        dist = new
    nearest = dist[spare > 0].min(initial=FAR)
    return None if nearest == FAR else np.maximum(nearest - dist, 0)


def _flow(kinds: list[tuple[int, tuple[int, ...], int]], excess: np.ndarray, spare: np.ndarray) -> dict[tuple, dict[int, int]]:
    """Rows to move, by kind (column, columns open to it): from overfull columns to spare places, chain by chain.

    ``excess`` and ``spare`` are brought up to date.
    """
    left, out = {(x, open_to): n for x, open_to, n in kinds}, {}
    of: dict[int, list] = {}
    for kind in left:
        of.setdefault(kind[0], []).append(kind)
    while True:
        via: dict[int, tuple | None] = {int(x): None for x in np.flatnonzero(excess > 0)}
        queue, end = list(via), None
        for x in queue:
            for kind in of.get(x, ()):
                for y in kind[1] if left[kind] else ():
                    if y not in via:
                        via[y] = kind
                        queue.append(y)
                        end = y if end is None and spare[y] > 0 else end
            if end is not None:
                break
        if end is None:
            return out
        chain, y = [], end
        while via[y] is not None:
            chain.append((via[y], y))
            y = via[y][0]
        n = min(int(excess[y]), int(spare[end]), *(left[kind] for kind, _ in chain))
        excess[y] -= n
        spare[end] -= n
        for kind, to in chain:
            left[kind] -= n
            held = out.setdefault(kind, {})
            held[to] = held.get(to, 0) + n


def _held_by_tasks(arcs: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no problem has more than ``ARCS`` arcs."""
    return not arcs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ARCS).limit(1).count()


def _top(rank: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorting by (rank, *order), and where in it each rank begins."""
    by = np.lexsort((*reversed(order), rank))
    return by, np.flatnonzero(np.r_[True, rank[by][1:] != rank[by][:-1]]) if len(by) else np.zeros(0, np.int64)


def _bids(row: np.ndarray, col: np.ndarray, value: np.ndarray, capacity: np.ndarray, limit: int, alone: int, step: int, max_rounds: int) -> tuple[np.ndarray, int]:
    """The rounds of ``auction`` for one problem: each row's column, -1 without a place, and the rounds, 0 if rows still bid.

    ``row`` and ``col`` are numbers in order of a and b, ``row`` is sorted.
    """
    n = int(row[-1]) + 1 if len(row) else 0
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if n else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(row)])
    at, bid, lost, price = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(len(capacity), np.int64)
    for done in range(1, max_rounds + 1):
        free = np.flatnonzero((at < 0) & ~lost)
        if not len(free):
            return at, done
        arc = np.repeat(first[free] - np.r_[0, np.cumsum(count[free])[:-1]], count[free]) + np.arange(count[free].sum())
        net = value[arc] - price[col[arc]]
        by, head = _top(row[arc], -net, col[arc])
        best, several = arc[by[head]], count[free] > 1
        top = net[by[head]]
        second = net[by[np.where(several, head + 1, head)]]
        offer = price[col[best]] + np.where(several, top - second, alone) + step
        lost[free[offer > limit]] = True
        good = offer <= limit
        at[free[good]], bid[free[good]] = col[best[good]], offer[good]
        held = np.flatnonzero(at >= 0)
        by, head = _top(at[held], -bid[held], held)
        held = held[by]
        place = np.arange(len(held)) - np.repeat(head, np.diff(np.r_[head, len(held)]))
        out = held[place >= capacity[at[held]]]
        last = held[place == capacity[at[held]] - 1]
        price[:] = 0
        price[at[last]] = bid[last]
        at[out] = -1
    return at, 0


def _auction_in_tasks(arcs: DataFrame, cols: DataFrame, keys: list[str], limit: int, alone: int, step: int, max_rounds: int) -> tuple[DataFrame, DataFrame, int]:
    """``auction`` with each problem in one task; the number of rows and the spread are those of all problems."""
    places = cols.orderBy("b").collect()
    names, capacity = np.array([r["b"] for r in places], np.int64), np.array([r["capacity"] for r in places], np.int64)
    schema = StructType([*[arcs.schema[k] for k in keys], arcs.schema["a"], arcs.schema["b"], StructField("rounds", IntegerType())])

    def solved(table: pa.Table) -> pa.Table:
        a, b, value = (table.column(c).to_numpy() for c in ("a", "b", "value"))
        key = [table.column(k)[0].as_py() for k in keys]
        name, row = np.unique(a, return_inverse=True)
        by = np.argsort(row, kind="stable")
        at, rounds = _bids(row[by], np.searchsorted(names, b[by]), value[by], capacity, limit, alone, step, max_rounds)
        got = pa.array(names[np.maximum(at, 0)] if len(names) else at, mask=at < 0)
        types = [table.schema.field(c).type for c in (*keys, "a", "b")]
        columns = [pa.array([k] * len(name), t) for k, t in zip(key, types)]
        return pa.Table.from_arrays([*columns, pa.array(name, types[-2]), got.cast(types[-1]), pa.array(np.full(len(name), rounds, np.int32))], schema_names)

    schema_names = [f.name for f in schema.fields]
    found = cut(arcs.select(*keys, "a", "b", "value").groupBy(*keys).applyInArrow(solved, schema))
    low, high = found.agg(F.min("rounds"), F.max("rounds")).first()
    if low == 0:
        raise StillBidding(f"rows still bid after {max_rounds} rounds")
    held = found.where("b is not null").select(*keys, "a", "b")
    out = held.join(arcs.select(*keys, "a", "b", "unit_cost").hint("merge"), [*keys, "a", "b"])
    return out.select(*keys, "a", "b", "unit_cost"), found.where("b is null").select(*keys, "a"), high or 1


def _prices(row: np.ndarray, ix: np.ndarray, cost: np.ndarray, room: np.ndarray, max_steps: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The steps of ``settled`` for one problem: each row's column, the prices, and the steps; arcs in order of (row, ix)."""
    size = len(room)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    by, _ = _top(row, cost, ix)
    at = ix[by[first]]
    used, price, steps = np.bincount(at, minlength=size), np.zeros(size, np.int64), 0
    bits = np.left_shift(np.int64(1), ix.astype(np.int64))
    while (used > room).any():
        steps += 1
        if steps > max_steps:
            raise RuntimeError(f"no optimum after {max_steps} steps")
        full = cost + price[ix]
        here = at[row]
        away = ix != here
        reach = np.full(size * size, FAR)
        np.minimum.at(reach, here[away] * size + ix[away], (full - np.minimum.reduceat(full, first)[row])[away])
        rise = _raised(reach.reshape(size, size), used - room, room - used)
        if rise is None:
            break
        price += rise
        full = cost + price[ix]
        equal = away & (full == np.minimum.reduceat(full, first)[row])
        open_to = np.bitwise_or.reduceat(np.where(equal, bits, 0), first)
        some = np.flatnonzero(open_to)
        by = some[np.lexsort((some, open_to[some], at[some]))]
        head = np.flatnonzero(np.r_[True, (at[by][1:] != at[by][:-1]) | (open_to[by][1:] != open_to[by][:-1])]) if len(by) else np.zeros(0, np.int64)
        rows_of = {(int(at[r[0]]), tuple(y for y in range(size) if int(open_to[r[0]]) >> y & 1)): r for r in np.split(by, head[1:])} if len(by) else {}
        common: dict[tuple, list] = {}
        for (x, columns), r in rows_of.items():
            for y in columns:
                common.setdefault((x, y), []).append((-len(r), columns))
        found = {(x, columns, -n) for (x, _), kinds in common.items() for n, columns in sorted(kinds)[:KINDS]}
        moved = _flow(sorted(found), np.maximum(used - room, 0), np.maximum(room - used, 0))
        for kind, to in moved.items():
            start, rows = 0, rows_of[kind]  # in order of a
            for y, n in sorted(to.items()):
                at[rows[start : start + n]] = y
                start += n
        used = np.bincount(at, minlength=size)
    return at, price, steps


def _settled_in_tasks(arcs: DataFrame, number: DataFrame, names: list, room: np.ndarray, keys: list[str], max_steps: int) -> Optimum:
    """``settled`` with each problem in one task."""
    known = arcs.where("a is not null and unit_cost is not null").join(F.broadcast(number), "b").select(*keys, "a", "ix", F.col("unit_cost").cast("long").alias("cost"))
    fields = [*[arcs.schema[k] for k in keys], arcs.schema["a"], StructField("b", LongType()), StructField("price", LongType()), StructField("steps", IntegerType())]
    labels = [f.name for f in fields]
    columns = np.array(names, np.int64)

    def solved(table: pa.Table) -> pa.Table:
        key = [table.column(k)[0].as_py() for k in keys]
        types = [table.schema.field(c).type for c in (*keys, "a")]
        name, row = np.unique(table.column("a").to_numpy(), return_inverse=True)
        ix, cost = table.column("ix").to_numpy().astype(np.int64), table.column("cost").to_numpy()
        by = np.lexsort((cost, ix, row))
        row, ix, cost = row[by], ix[by], cost[by]
        one = np.r_[True, (row[1:] != row[:-1]) | (ix[1:] != ix[:-1])]  # the cheapest of equal arcs
        at, price, steps = _prices(row[one], ix[one], cost[one], room, max_steps)
        by, head = _top(at, np.arange(len(at)))
        place = np.arange(len(by)) - np.repeat(head, np.diff(np.r_[head, len(by)]))
        stay = np.sort(by[place < room[at[by]]])
        n = len(stay) + len(columns)
        none = np.arange(n) >= len(stay)
        a = pa.array(np.r_[name[stay], np.zeros(len(columns), name.dtype)], types[-1], mask=none)
        b = pa.array(np.r_[columns[at[stay]], columns])
        paid = pa.array(np.r_[np.zeros(len(stay), np.int64), price], mask=~none)
        return pa.Table.from_arrays([*[pa.array([k] * n, t) for k, t in zip(key, types)], a, b, paid, pa.array(np.full(n, steps, np.int32))], labels)

    found = cut(known.groupBy(*keys).applyInArrow(solved, StructType(fields)))
    held = found.where("price is null").select(*keys, "a", "b")
    # sizes are underestimated behind an explode: without the hint the driver would hold the rows for a broadcast
    rest = cut(arcs.select(*keys, "a").distinct().join(held.hint("merge"), [*keys, "a"], "left_anti"))
    out = held.join(arcs.hint("merge"), [*keys, "a", "b"]).select(*keys, "a", "b", "unit_cost")
    return Optimum(out, found.where("price is not null").select(*keys, "b", "price"), rest, found.agg(F.max("steps")).first()[0] or 0)


def settled(arcs: DataFrame, cols: DataFrame, keys: Sequence[str] = (), max_steps: int = 10_000) -> Optimum:
    """The optimum by prices that rise and rows that follow (primal-dual), without bids.

    Every row is always at a column that is cheapest for it at the prices, so
    the end is an optimum and the prices prove it.  A step takes the least extra
    cost of a move between any two columns, raises prices until an overfull
    column reaches a spare place at no extra cost, and moves rows along such
    chains, as many as there are.  Rows and arcs stay distributed and are moved
    by broadcast bounds on their numbers; the driver sees a number for a pair of
    columns and at most ``KINDS`` kinds of rows for it.
    """
    keys = list(keys)
    spark = arcs.sparkSession
    places = cols.groupBy("b").agg(F.sum("capacity").alias("capacity")).orderBy("b").collect()
    number = spark.createDataFrame([(r["b"], i) for i, r in enumerate(places)], "b long, ix int")
    room, size = np.array([r["capacity"] for r in places], np.int64), len(places)
    if size <= WORD and _held_by_tasks(arcs, keys):
        return _settled_in_tasks(arcs, number, [r["b"] for r in places], room, keys, max_steps)
    known = arcs.where("a is not null and unit_cost is not null").groupBy(*keys, "a", "b").agg(F.min("unit_cost").alias("cost"))
    rows = known.join(F.broadcast(number), "b").groupBy(*keys, "a").agg(F.array_sort(F.collect_list(F.struct("ix", "cost"))).alias("offers"))
    rows = cut(rows.withColumn("at", F.array_min(F.transform("offers", lambda s: F.struct(s["cost"], s["ix"])))["ix"]))
    used: dict[tuple, np.ndarray] = {}
    for r in rows.groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("n")).collect():
        used.setdefault(tuple(r[k] for k in keys), np.zeros(size, np.int64))[r["at"]] = r["n"]
    price = {p: np.zeros(size, np.int64) for p in used}
    live = {p for p, n in used.items() if (n > room).any()}
    key_fields = [arcs.schema[k] for k in keys]
    paid = StructType([*key_fields, StructField("price", ArrayType(LongType()))])
    kind_fields = [*key_fields, StructField("at", IntegerType()), StructField("open", ArrayType(IntegerType())), StructField("y", IntegerType()), StructField("start", LongType()), StructField("stop", LongType())]

    def priced(some: set) -> DataFrame:
        table = F.broadcast(spark.createDataFrame([(*p, price[p].tolist()) for p in some], paid))
        x = rows.join(table, keys) if keys else rows.crossJoin(table)
        full = F.transform("offers", lambda s: F.struct(s["ix"].alias("ix"), (s["cost"] + F.col("price")[s["ix"]]).alias("full")))
        x = x.withColumn("full", full).withColumn("own", F.array_min(F.col("full")["full"]))
        equal = F.filter("full", lambda s: (s["full"] == F.col("own")) & (s["ix"] != F.col("at")))
        return x.withColumn("open", equal["ix"])

    steps = 0
    while live:
        steps += 1
        if steps > max_steps:
            raise RuntimeError(f"no optimum after {max_steps} steps")
        extra = priced(live).select(*keys, "at", "own", F.inline("full")).where("ix <> at").groupBy(*keys, "at", "ix").agg(F.min(F.col("full") - F.col("own")).alias("w"))
        reach = {p: np.full((size, size), FAR) for p in live}
        for r in extra.collect():
            reach[tuple(r[k] for k in keys)][r["at"], r["ix"]] = r["w"]
        for p in list(live):
            rise = _raised(reach[p], used[p] - room, room - used[p])
            if rise is None:
                live.discard(p)
            else:
                price[p] += rise
        if not live:
            break
        kinds = priced(live).where(F.size("open") > 0).groupBy(*keys, "at", "open").agg(F.count(F.lit(1)).alias("n"))
        common = Window.partitionBy(*keys, "at", "y").orderBy(F.desc("n"), "open")
        kinds = kinds.withColumn("y", F.explode("open")).withColumn("_r", F.row_number().over(common)).where(F.col("_r") <= KINDS).select(*keys, "at", "open", "n")
        found: dict[tuple, set] = {p: set() for p in live}
        for r in kinds.collect():
            found[tuple(r[k] for k in keys)].add((r["at"], tuple(r["open"]), r["n"]))
        moves = []
        for p in list(live):
            excess, spare = np.maximum(used[p] - room, 0), np.maximum(room - used[p], 0)
            for (x, open_to), to in _flow(sorted(found[p]), excess, spare).items():
                start = 0
                for y, n in sorted(to.items()):
                    moves.append((*p, x, list(open_to), y, start, start + n))
                    used[p][x], used[p][y], start = used[p][x] - n, used[p][y] + n, start + n
        table = F.broadcast(spark.createDataFrame(moves, StructType(kind_fields)))
        now = priced(live)
        # the rows of a kind move in order of their numbers: a bound on the number tells which
        of_kind = [*keys, "at", "open"]
        turn = F.row_number().over(Window.partitionBy(*of_kind).orderBy("a"))
        movers = now.select(*of_kind, "a").join(table.select(*of_kind), of_kind, "left_semi").withColumn("turn", turn)
        bound = movers.join(table, of_kind).where("turn > start and turn <= stop").groupBy(*of_kind, "y").agg(F.max("a").alias("last"))
        bound = cut(bound.groupBy(*of_kind).agg(F.array_sort(F.collect_list(F.struct("last", "y"))).alias("to")))
        to = F.get(F.filter("to", lambda s: s["last"] >= F.col("a")), F.lit(0))["y"]  # none beyond the last bound
        gone = {p for p in live if not (used[p] > room).any()}
        moved = now.join(F.broadcast(bound), of_kind, "left").select(*keys, "a", "offers", F.coalesce(to, F.col("at")).alias("at"))
        if keys and len(live) < len(used):
            still = rows.join(F.broadcast(spark.createDataFrame(list(live), StructType(key_fields))), keys, "left_anti")
            moved = moved.unionByName(still.select(*keys, "a", "offers", "at"))
        rows = cut(moved)
        live -= gone
    full = StructType([*key_fields, StructField("at", IntegerType()), StructField("b", LongType()), StructField("price", LongType()), StructField("room", LongType())])
    table = spark.createDataFrame([(*p, i, r["b"], int(price[p][i]), int(room[i])) for p in used for i, r in enumerate(places)], full)
    held = rows.select(*keys, "a", "at").join(F.broadcast(table), [*keys, "at"])
    held = held.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "at").orderBy("a"))).where("place <= room")
    held = cut(held.select(*keys, "a", "b"))
    rest = cut(arcs.select(*keys, "a").distinct().join(held, [*keys, "a"], "left_anti"))
    out = held.join(arcs, [*keys, "a", "b"]).select(*keys, "a", "b", "unit_cost")
    return Optimum(out, cut(table.select(*keys, "b", "price")), rest, steps)


def may_settle(cols: DataFrame, problems: int) -> bool:
    return problems * cols.count() ** 2 <= MAX_PAIRS


def optimal(arcs: DataFrame, capacity: DataFrame, keys: Sequence[str] = (), max_steps: int = 10_000) -> Optimum:
    """Assignment of least total cost, with prices that prove it.

    ``arcs`` is (keys, a, b, unit_cost) with integer costs, ``capacity`` is
    (b, capacity).  Rows without a place are in ``rest``; they need more
    candidates, and the others' assignment is the best without them.  Every
    step cuts the total by one at least; ``max_steps`` relaxations without an
    end raise.
    """
    keys = list(keys)
    arcs = cut(arcs.select(*keys, "a", F.col("b").cast("long").alias("b"), F.col("unit_cost").cast("long").alias("unit_cost")))
    cols = cut(capacity.where("capacity > 0").select(F.col("b").cast("long").alias("b"), F.col("capacity").cast("long").alias("capacity")))
    arcs = cut(arcs.join(cols.select("b"), "b", "left_semi"))
    low, high = arcs.agg(F.min("unit_cost"), F.max("unit_cost")).first()
    brief = may_settle(cols, arcs.select(*keys).distinct().count() if keys else 1)
    try:
        got, rest, _ = auction(arcs, cols, keys, step=max(1, ((high or 0) - (low or 0)) // 16), exact=False, max_rounds=AUCTION_ROUNDS if brief else 1_000)
    except StillBidding:
        if not brief:
            raise
        return settled(arcs, cols, keys, max_steps)
    held, rest = cut(got.select(*keys, "a", "b")), cut(rest)
    nodes = cols.count() + 1
    node = cols.select(F.col("b").alias("node")).unionByName(cols.sparkSession.range(1).select(F.lit(POOL).cast("long").alias("node")))
    problems = held.select(*keys).distinct() if keys else None
    state = problems.crossJoin(F.broadcast(node)) if problems is not None else node
    state = cut(state.select(*keys, "node", F.lit(0).cast("long").alias("d"), F.lit(None).cast("long").alias("up"), F.lit(True).alias("fell")))
    steps = 0
    while True:
        edges = cut(_column_graph(held, arcs, cols, keys))
        look, done = 2, 0
        while True:
            steps, done = steps + 1, done + 1
            if steps > max_steps:
                raise RuntimeError(f"no optimum after {max_steps} steps")
            state = cut(_relaxed(edges, state, keys))
            if not state.where("fell").limit(1).count():
                base = state.where(F.col("node") == POOL).select(*keys, F.col("d").alias("base"))
                prices = state.where(F.col("node") >= 0)
                prices = prices.join(F.broadcast(base), keys) if keys else prices.crossJoin(F.broadcast(base))
                prices = cut(prices.select(*keys, F.col("node").alias("b"), (F.col("base") - F.col("d")).alias("price")))
                return Optimum(held.join(arcs, [*keys, "a", "b"]).select(*keys, "a", "b", "unit_cost"), prices, rest, steps)
            if done == look:
                look *= 2
                cycles = cut(_cycles(state, keys, nodes))
                if cycles.limit(1).count():
                    held = cut(_rotated(held, edges, cycles, keys))
                    state = cut(state.withColumn("up", F.lit(None).cast("long")))
                    break


def certificate(arcs: DataFrame, capacity: DataFrame, found: Optimum, keys: Sequence[str] = ()) -> DataFrame:
    """Per problem: rows placed, total cost, dual total, and the arcs and columns that break optimality (0 for an optimum).

    ``negative`` counts arcs that would be cheaper than a row's own at the
    prices, ``loose`` columns with spare capacity and a price, ``over`` columns
    beyond their capacity.  With none of them both totals agree.
    """
    keys = list(keys)
    priced = arcs.join(found.prices, [*keys, "b"]).withColumn("full", F.col("unit_cost") + F.col("price"))
    own = found.assigned.join(found.prices, [*keys, "b"]).select(*keys, "a", "unit_cost", (F.col("unit_cost") + F.col("price")).alias("paid"))
    rows = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("placed"), F.sum("unit_cost").alias("total"), F.sum("paid").alias("paid"))
    worse = priced.select(*keys, "a", "full").join(own.select(*keys, "a", "paid"), [*keys, "a"])
    bad = worse.groupBy(*keys).agg(F.count(F.when(F.col("full") < F.col("paid"), 1)).alias("negative"))
    used = found.assigned.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("used"))
    columns = found.prices.join(F.broadcast(capacity.select("b", "capacity")), "b").join(used, [*keys, "b"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    sides = columns.groupBy(*keys).agg(
        F.sum(F.col("price") * F.col("capacity")).alias("rent"), F.count(F.when((F.col("used") < F.col("capacity")) & (F.col("price") != 0), 1)).alias("loose"),
        F.count(F.when((F.col("used") > F.col("capacity")) | (F.col("price") < 0), 1)).alias("over"),
    )
    both = rows.join(bad, keys).join(sides, keys) if keys else rows.crossJoin(bad).crossJoin(sides)
    return both.select(*keys, "placed", "total", (F.col("paid") - F.col("rent")).alias("dual"), "negative", "loose", "over")


def member_costs(arcs: DataFrame, members: int, mode: str, size: int, seed: int = 0) -> DataFrame:
    """(member, a, b, unit_cost) of ``members`` problems; member m draws from seed + 1000003 m.

    ``base`` changes nothing, ``perturb`` adds an integer of [-size, size] to
    every arc (shifted so that no cost is negative), ``lexicographic`` breaks
    ties of the total by an integer of [0, size] per arc.
    """
    each = arcs.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    draw = F.xxhash64("a", "b", F.lit(seed) + F.lit(1_000_003) * F.col("member"))
    if mode == "base":
        out = each
    elif mode == "perturb":
        noisy = each.withColumn("unit_cost", F.col("unit_cost") + F.pmod(draw, F.lit(2 * size + 1)) - F.lit(size))
        shift = noisy.groupBy("member").agg(F.least(F.min("unit_cost"), F.lit(0)).alias("_shift"))
        out = noisy.join(F.broadcast(shift), "member").withColumn("unit_cost", F.col("unit_cost") - F.col("_shift"))
    elif mode == "lexicographic":
        rows = arcs.select("a").distinct().count()
        out = lexicographic(each.withColumn("_tie", F.pmod(draw, F.lit(max(1, size) + 1))), "_tie", rows)
    else:
        raise ValueError(f"unknown ensemble mode {mode}")
    return out.select("member", "a", "b", F.col("unit_cost").cast("long").alias("unit_cost"))


def ensemble(
    arcs: DataFrame, capacity: DataFrame, size: int, members: int = 16, mode: str = "perturb", relative: float = 0.0, absolute: float = 0.0, keep: int | None = None, seed: int = 0
) -> DataFrame:
    """(member, a, b, unit_cost, objective): exact optima of changed costs, with the base costs and their total.

    Equal assignments stay once, those with the smallest (objective, member)
    first; objectives may exceed the best by ``absolute`` plus ``relative``
    times its size, and ``keep`` bounds how many members stay (all by default).
    """
    arcs = cut(arcs.select("a", F.col("b").cast("long").alias("b"), "unit_cost"))
    solved = optimal(member_costs(arcs, members, mode, size, seed), capacity, ["member"])
    if solved.rest.limit(1).count():
        raise ValueError("the candidates leave rows without a place")
    base = cut(solved.assigned.drop("unit_cost").join(arcs.hint("merge"), ["a", "b"]))
    marks = assignment_hash(base, ["member"])  # one row a member
    first = marks.groupBy("hash").agg(F.min(F.struct("objective", "member")).alias("m")).select("m.*")
    best = first.agg(F.min("objective").alias("best"))
    inside = first.join(F.broadcast(best)).where(F.col("objective") <= F.col("best") + F.lit(absolute) + F.lit(relative) * F.greatest(F.abs("best"), F.lit(1e-12)))
    if keep is not None:
        inside = inside.orderBy("objective", "member").limit(keep)
    return base.join(F.broadcast(inside.select("member", "objective")), "member").select("member", "a", "b", "unit_cost", "objective")
