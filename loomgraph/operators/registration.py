"""Placing graph nodes on a spatial slice: features, capacities, costs, energies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.core.order import average_ranks, dense_index
from loomgraph.core.session import cut
from loomgraph.core.skew import HOT_ROWS, MAX_HOT, lookup
from loomgraph.functions.num import huber
from loomgraph.operators import knn as N
from loomgraph.operators.ranks import largest_remainder

EPS = 1e-12
# fixed values: defaults of the registration
MIN_DETECTED = 10
LOCAL_RADIUS = 0.15
HUBER_DELTA = 0.05


def slice_rows(obs: DataFrame, time: str, value: str) -> DataFrame:
    """Rows of one stage; all rows when the stage does not occur."""
    chosen = obs.where(F.col(time) == value)
    return chosen if chosen.limit(1).count() else obs


def node_mass(obs: DataFrame, totals: DataFrame, weight: str | None) -> DataFrame:
    """Explicit weight, else the row's count total; negatives and NaN are 0."""
    x = obs.join(totals, "node_id", "left")
    m = F.coalesce(F.col(weight), F.col("total")) if weight else F.col("total")
    m = F.when(F.isnan(m.cast("double")), 0.0).otherwise(m.cast("double"))
    return x.select("node_id", F.greatest(F.coalesce(m, F.lit(0.0)), F.lit(0.0)).alias("mass"))


def ratio_from_labelled(points: DataFrame, counts: DataFrame, coords: Sequence[str], k: int) -> DataFrame:
    """a / (a + b) over the k nearest nodes that have any of both; 0.5 without."""
    lab = points.join(counts.where(F.col("a") + F.col("b") > 0), "node_id").select("node_id", *coords, "a", "b")
    near = N.knn(points, k, coords, targets=lab)
    v = lab.select(F.col("node_id").alias("nbr"), "a", "b")
    s = lookup(near, v, "nbr").groupBy("node_id").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    both = F.col("sa") + F.col("sb")
    return s.select("node_id", both.alias("support"), F.when(both > 0, F.col("sa") / (both + EPS)).otherwise(0.5).alias("ratio"))


def smoothed_ratio(points: DataFrame, counts: DataFrame, coords: Sequence[str], k: int) -> DataFrame:
    """Neighbourhood means of both counts and their ratio; 0.5 without support."""
    near = N.knn(points, k, coords, include_self=True)
    v = points.select("node_id").join(counts, "node_id", "left").na.fill(0).select(F.col("node_id").alias("nbr"), "a", "b")
    s = lookup(near, v, "nbr").groupBy("node_id").agg(F.avg("a").alias("sa"), F.avg("b").alias("sb"))
    both = F.col("sa") + F.col("sb")
    return s.select("node_id", both.alias("support"), F.when(both > EPS, F.col("sa") / (both + EPS)).otherwise(0.5).alias("ratio"))


def pair_counts(counts: DataFrame, pairs: DataFrame, node: str = "node_id") -> DataFrame:
    """Counts of side A and B genes of each pole pair (pairs: gene, pair, side).

    A pole table lists a few genes per pair.
    """
    x = counts.withColumn("gene", F.lower("gene")).join(F.broadcast(pairs.withColumn("gene", F.lower("gene"))), "gene")
    return x.groupBy(node, "pair").agg(
        F.sum(F.when(F.col("side") == "A", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == "B", F.col("n")).otherwise(0)).alias("b")
    )


def pole_fields(points: DataFrame, counts: DataFrame, coords: Sequence[str], k: int, least: int = MIN_DETECTED) -> DataFrame:
    """Smoothed detection field (gene, node_id, f) of every gene seen often enough.

    Only entries above zero are kept: a node without a detecting neighbour has
    field 0 and adds nothing to any of the sums below.
    """
    seen = cut(counts.where(F.col("n") > 0).select("node_id", "gene").distinct())
    genes = seen.groupBy("gene").agg(F.count(F.lit(1)).alias("abundance")).where(F.col("abundance") >= least)
    genes = cut(dense_index(genes, ["gene"], "code").withColumn("code", F.col("code").cast("int")))
    # a gene has at most k rows for each node that detects it, so the heavy ones are known
    heavy = genes.where(F.col("abundance") * k >= HOT_ROWS).orderBy(F.desc("abundance"), "code").limit(MAX_HOT).collect()
    seen = lookup(seen, genes.select("gene", "code"), "gene", "inner", [r["gene"] for r in heavy])
    # a node's genes travel as one list of numbers and are counted where their neighbours meet
    held = seen.join(points.select("node_id"), "node_id", "left_semi").groupBy(F.col("node_id").alias("nbr")).agg(F.collect_list("code").alias("codes"))
    near = cut(N.knn(points, k, coords, include_self=True).where("node_id is not null").select("node_id", "nbr"))
    hits = lookup(near, held, "nbr", "left").groupBy("node_id").agg(F.count(F.lit(1)).alias("k"), F.flatten(F.collect_list("codes")).alias("codes"))
    f = hits.select("node_id", "k", F.explode("codes").alias("code")).groupBy("node_id", "k", "code").agg(F.count(F.lit(1)).alias("h"))
    return lookup(f, genes, "code", "inner", [r["code"] for r in heavy]).select("gene", "node_id", (F.col("h") / F.col("k")).alias("f"), "abundance")


def pole_statistics(points: DataFrame, fields: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Peak, spread, local mass and locality score of each gene's field."""
    ends = [F.max(c) - F.min(c) for c in coords]
    span2 = sum((e * e for e in ends), F.lit(0.0))
    scale = points.agg(F.sqrt(span2).alias("raw")).select(F.when(F.col("raw") > EPS, F.col("raw")).otherwise(1.0).alias("scale"))
    x = cut(lookup(fields, points.select("node_id", *coords), "node_id"))
    peak = x.groupBy("gene").agg(
        F.max(F.struct("f", (-F.col("node_id")).alias("neg"), *coords)).alias("p"), F.sum("f").alias("field_mass"), F.first("abundance").alias("abundance")
    )
    peak = peak.select("gene", "field_mass", "abundance", F.col("p.f").alias("peak_value"), *[F.col(f"p.{c}").alias(f"peak_{c}") for c in coords])
    y = lookup(x.drop("abundance"), peak, "gene").join(F.broadcast(scale))
    d2 = sum(((F.col(c) - F.col(f"peak_{c}")) ** 2 for c in coords), F.lit(0.0))
    radius = F.greatest(F.lit(LOCAL_RADIUS) * F.col("scale"), F.lit(EPS))
    s = y.withColumn("d2", d2).groupBy("gene").agg(
        F.sum(F.col("f") * F.col("d2")).alias("m2"), F.sum(F.when(F.col("d2") <= radius * radius, F.col("f")).otherwise(0.0)).alias("near"), F.first("scale").alias("scale")
    )
    t = peak.join(s, "gene")
    spread = F.sqrt(F.col("m2") / (F.col("field_mass") + EPS))
    local = F.col("near") / (F.col("field_mass") + EPS)
    norm = spread / (F.col("scale") + EPS)
    return t.select(
        "gene", "abundance", *[f"peak_{c}" for c in coords], "peak_value", "field_mass", spread.alias("spread"), local.alias("local_mass"),
        (F.col("peak_value") * local / (norm + EPS)).alias("locality"), "scale",
    )


def locality_ranks(stats: DataFrame) -> DataFrame:
    """Average rank of the locality score over the largest rank."""
    r = average_ranks(stats.withColumn("_v", F.log1p("locality")), [], "_v", "_r")
    top = r.agg(F.max("_r").alias("_m"))
    return r.join(F.broadcast(top)).withColumn("locality_rank", F.col("_r") / F.col("_m")).drop("_v", "_r", "_m", "n_group")


def field_moments(points: DataFrame, fields: DataFrame) -> DataFrame:
    n = points.agg(F.count(F.lit(1)).alias("n"))
    g = fields.groupBy("gene").agg(F.sum("f").alias("s"), F.sum(F.col("f") * F.col("f")).alias("ss")).join(F.broadcast(n))
    m = F.col("s") / F.col("n")
    return g.select("gene", "n", m.alias("m"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - m * m, F.lit(0.0))).alias("sd"))


def correlation_to(fields: DataFrame, moments: DataFrame, anchor: str, name: str) -> DataFrame:
    """Correlation of every gene's field with that of one gene (absent is 0)."""
    own = fields.where(F.col("gene") == anchor).select("node_id", F.col("f").alias("g"))
    cross = fields.join(own, "node_id").groupBy("gene").agg(F.sum(F.col("f") * F.col("g")).alias("c"))
    a = moments.where(F.col("gene") == anchor).select(F.col("m").alias("ma"), F.col("sd").alias("sa"))
    x = moments.join(cross, "gene", "left").join(F.broadcast(a))
    cov = F.coalesce("c", F.lit(0.0)) / F.col("n") - F.col("m") * F.col("ma")
    return x.select("gene", F.when((F.col("sd") > 0) & (F.col("sa") > 0), cov / (F.col("sd") * F.col("sa"))).otherwise(0.0).alias(name))


def assign_to_poles(stats: DataFrame, corr_a: DataFrame, corr_b: DataFrame, anchors: tuple[str, str], top: int) -> DataFrame:
    """Genes on the side of the larger positive correlation, best ``top`` per side."""
    a, b = anchors
    x = stats.join(corr_a, "gene").join(corr_b, "gene")
    pa, pb = F.greatest("corr_a", F.lit(0.0)), F.greatest("corr_b", F.lit(0.0))
    side = F.when(F.col("gene") == a, "A").when(F.col("gene") == b, "B").when(pa >= pb, "A").otherwise("B")
    score = F.when(F.col("gene").isin(a, b), F.lit(float("inf"))).otherwise(F.col("locality_rank") * F.greatest(pa, pb))
    x = x.select("gene", side.alias("side"), score.alias("score"), "locality")
    placed = dense_index(x, [F.col("side"), F.desc("score"), F.desc("locality"), F.col("gene")], "_p")
    first = placed.groupBy("side").agg(F.min("_p").alias("_f"))
    return placed.join(F.broadcast(first), "side").where(F.col("_p") - F.col("_f") < top).select("gene", "side", "score", (F.col("_p") - F.col("_f")).alias("place"))


def capacities(obs: DataFrame, mass: DataFrame, target: int, mode: str = "mass_exact", coords: Sequence[str] = ()) -> DataFrame:
    """Capacity of each slice node under one of four policies; fewer places than ``target`` are an error or, spread in space, filled up."""
    if mode == "mass_exact":
        return largest_remainder(mass, "node_id", "mass", target).select("node_id", "capacity")
    even = obs.select("node_id", F.lit(1.0).alias("mass"))
    if mode == "uniform_exact":
        return largest_remainder(even, "node_id", "mass", target).select("node_id", "capacity")
    if mode == "unit_upper":
        places = obs.count()
        if places < target:
            raise ValueError(f"{places} places of one unit cannot take {target}")
        return obs.select("node_id", F.lit(1).cast("long").alias("capacity"))
    if mode == "spatial_fps_exact":
        places = obs.count()
        if target >= places:  # every place is chosen, and what is left is spread evenly
            more = largest_remainder(even, "node_id", "mass", target - places)
            return more.select("node_id", (F.col("capacity") + 1).cast("long").alias("capacity"))
        chosen = farthest_points(obs, coords, target).withColumn("capacity", F.lit(1).cast("long"))
        return obs.select("node_id").join(chosen, "node_id", "left").select("node_id", F.coalesce("capacity", F.lit(0).cast("long")).alias("capacity"))
    raise ValueError(f"unknown capacity mode {mode}")


def farthest_points(points: DataFrame, coords: Sequence[str], k: int, block: int = 64) -> DataFrame:
    """Greedy farthest-point order: the first is nearest to the centre; ties go to the smaller id.

    The next choices are among the points that are now farthest: a pass takes
    the ``block`` farthest, and choosing among them is right for as long as the
    farthest of them is no nearer than any point outside at the pass's start,
    since distances only fall.  One pass over the points thus serves up to
    ``block`` choices and one update.
    """
    spark = points.sparkSession
    centre = points.agg(*[F.avg(c) for c in coords]).first()
    d0 = sum(((F.col(c) - float(m)) ** 2 for c, m in zip(coords, centre)), F.lit(0.0))
    first = points.agg(F.min(F.struct(d0.alias("d"), "node_id", *coords)).alias("b")).first()["b"]
    if first is None or k < 1:
        return spark.createDataFrame([], "node_id long")
    done = new = [(first["node_id"], tuple(first[c] for c in coords))]
    state = points.select("node_id", *coords, F.lit(float("inf")).alias("low"))
    while len(done) < k:
        low = F.col("low")
        for _, at in new:
            low = F.least(low, sum(((F.col(c) - float(v)) ** 2 for c, v in zip(coords, at)), F.lit(0.0)))
        state = cut(state.where(~F.col("node_id").isin([n for n, _ in new])).withColumn("low", low))
        top = state.orderBy(F.desc("low"), "node_id").limit(block + 1).collect()
        if not top:
            break
        bound = (top[block]["low"], -top[block]["node_id"]) if len(top) > block else None
        near = {r["node_id"]: (r["low"], tuple(r[c] for c in coords)) for r in top[:block]}
        new = []
        while near and len(done) + len(new) < k:
            pick = max(near, key=lambda n: (near[n][0], -n))
            if bound is not None and new and (near[pick][0], -pick) < bound:
                break
            at = near.pop(pick)[1]
            new.append((pick, at))
            near = {n: (min(d, sum((x - y) ** 2 for x, y in zip(p, at))), p) for n, (d, p) in near.items()}
        done = done + new
    return spark.createDataFrame([(int(n),) for n, _ in done], "node_id long")


def huber_costs(arcs: DataFrame, features: Sequence[str], delta: float = HUBER_DELTA) -> DataFrame:
    """Sum of Huber losses of the feature differences of each arc."""
    total = F.lit(0.0)
    for f in features:
        total = total + huber(F.col(f"a_{f}") - F.col(f"b_{f}"), delta)
    return arcs.withColumn("cost", total)


def quantise(arcs: DataFrame, flow: int, top: int = 1 << 60) -> DataFrame:
    """Integer costs, shifted to start at 0, whose sum over ``flow`` units stays below ``top``; halves go to even."""
    low, high = arcs.agg(F.min("cost"), F.max("cost")).first()
    shift = min(0.0, low or 0.0)
    span = (high or 0.0) - shift
    if span <= 0.0:
        return arcs.withColumn("unit_cost", F.lit(0).cast("long"))
    scale = max(1, min(1_000_000, int(top / (max(flow, 1) * span))))
    return arcs.withColumn("unit_cost", F.rint((F.col("cost") - F.lit(shift)) * F.lit(float(scale))).cast("long"))


def lexicographic(arcs: DataFrame, second: str, flow: int, top: int = 1 << 60) -> DataFrame:
    """The first cost decides and the second only breaks ties of whole assignments of ``flow`` units.

    The second is folded to half its range, again and again, until the sums fit below ``top``.
    """
    base, low, high = arcs.agg(F.max("unit_cost"), F.min(second), F.max(second)).first()
    most = (high or 0) - (low or 0)
    while most > 0:
        room = max(flow, 1) * most + 1
        if ((base or 0) * room + most) * max(flow, 1) < top:
            return arcs.withColumn("unit_cost", F.col("unit_cost") * F.lit(room) + (F.col(second) - F.lit(low)) % F.lit(most + 1))
        most //= 2
    return arcs


def perturb(arcs: DataFrame, size: float, seed: int) -> DataFrame:
    """Small repeatable noise on the costs, one draw per arc and seed."""
    u = F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(2_000_003)) / 2_000_003.0
    return arcs.withColumn("cost", F.col("cost") + F.lit(size) * u)


def dirichlet_penalty(arcs: DataFrame, edges: DataFrame, placed: DataFrame, coords: Sequence[str]) -> DataFrame:
    """deg |y|^2 - 2 y . sum(w y_nbr) + sum(w |y_nbr|^2) for each arc (a -> y)."""
    nb = placed.select(F.col("node_id").alias("j"), *[F.col(c).alias(f"n_{c}") for c in coords])
    n2 = sum((F.col(f"n_{c}") * F.col(f"n_{c}") for c in coords), F.lit(0.0))
    m = lookup(edges, nb, "j").groupBy(F.col("i").alias("a")).agg(
        F.sum("w").alias("deg"), *[F.sum(F.col("w") * F.col(f"n_{c}")).alias(f"s_{c}") for c in coords], F.sum(F.col("w") * n2).alias("s2")
    )
    x = lookup(arcs, m, "a", "left")
    y2 = sum((F.col(f"y_{c}") * F.col(f"y_{c}") for c in coords), F.lit(0.0))
    cross = sum((F.col(f"y_{c}") * F.col(f"s_{c}") for c in coords), F.lit(0.0))
    pen = F.coalesce(F.col("deg") * y2 - 2 * cross + F.col("s2"), F.lit(0.0))
    return x.withColumn("penalty", pen).drop("deg", "s2", *[f"s_{c}" for c in coords])


def adaptive_weight(arcs: DataFrame) -> DataFrame:
    """Median positive cost over median positive penalty: 0 without penalties, 1 / penalty without costs, 1e12 at most."""
    mid = arcs.agg(F.median(F.when(F.col("cost") > 0, F.col("cost"))).alias("c"), F.median(F.when(F.col("penalty") > 0, F.col("penalty"))).alias("p"))
    tiny = 1e-12
    weight = F.when(F.coalesce("p", F.lit(0.0)) <= tiny, 0.0).when(F.coalesce("c", F.lit(0.0)) <= tiny, 1.0 / F.col("p")).otherwise(F.col("c") / F.col("p"))
    return mid.select(F.least(weight, F.lit(1e12)).alias("weight"))


def assignment_energy(edges: DataFrame, placed: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Half the sum over both directions of w |y_i - y_j|^2."""
    a = placed.select(F.col("node_id").alias("i"), *[F.col(c).alias(f"a_{c}") for c in coords])
    b = placed.select(F.col("node_id").alias("j"), *[F.col(c).alias(f"b_{c}") for c in coords])
    d2 = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in coords), F.lit(0.0))
    return lookup(lookup(edges, a, "i"), b, "j").agg((F.sum(F.col("w") * d2) / 2).alias("energy"))


def displacement(base: DataFrame, final: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Moved share, median and largest move, in units of the coordinate span."""
    f = final.select("node_id", *[F.col(c).alias(f"f_{c}") for c in coords])
    d = F.sqrt(sum(((F.col(c) - F.col(f"f_{c}")) ** 2 for c in coords), F.lit(0.0)))
    span = F.sqrt(sum(((F.max(c) - F.min(c)) ** 2 for c in coords), F.lit(0.0)))
    x = base.join(f, "node_id").withColumn("d", d)
    return x.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("n_moved"), F.median(F.when(F.col("d") > 0, F.col("d"))).alias("median_move"),
        F.max("d").alias("max_move"), span.alias("span"),
    )


def slice_feature_means(assign: DataFrame, values: DataFrame, slices: DataFrame, value: str) -> DataFrame:
    """Mean and count of assigned values per slice node; NULL mean without any."""
    g = lookup(assign, values, "node_id").groupBy("slice").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return slices.join(g, "slice", "left").select("slice", "mean", F.coalesce("n", F.lit(0)).alias("n"))


def ensemble_moments(members: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Mean and sample covariance of each node over the members."""
    pairs = [(a, b) for i, a in enumerate(coords) for b in list(coords)[i:]]
    return members.groupBy("node_id").agg(*[F.avg(c).alias(f"mean_{c}") for c in coords], *[F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in pairs])


def covariance_floor(moments: DataFrame, coords: Sequence[str], floor: float) -> DataFrame:
    """Adds floor x median mean-variance (at least 1e-12) to every variance.

    A matrix with an entry that is no finite number becomes zero as a whole; the
    median is over positive traces, and 1 without any.
    """
    own = [f"cov_{c}_{c}" for c in coords]
    every = [x for x in moments.columns if x.startswith("cov_")]
    bad = F.lit(False)
    for c in every:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    fixed = moments.withColumn("_bad", bad)
    fixed = fixed.select(*[F.when(F.col("_bad"), 0.0).otherwise(F.col(c)).alias(c) if c in every else F.col(c) for c in moments.columns])
    trace = sum((F.col(c) for c in own), F.lit(0.0)) / len(own)
    mid = fixed.agg(F.greatest(F.coalesce(F.median(F.when(trace > 0, trace)), F.lit(1.0)) * floor, F.lit(1e-12)).alias("_add"))
    out = fixed.join(F.broadcast(mid))
    for c in own:
        out = out.withColumn(c, F.col(c) + F.col("_add"))
    return out.drop("_add")


def medoid(members: DataFrame, coords: Sequence[str], member: str = "member") -> DataFrame:
    """The member closest to the ensemble mean, in squared distance over all nodes.

    The sum of squared distances of a member to all members is E times its own
    to the mean plus a constant, so no pair of members is formed.
    """
    mean = members.groupBy("node_id").agg(*[F.avg(c).alias(f"m_{c}") for c in coords])
    d2 = sum(((F.col(c) - F.col(f"m_{c}")) ** 2 for c in coords), F.lit(0.0))
    s = lookup(members, mean, "node_id").groupBy(member).agg(F.sum(d2).alias("d"))
    return s.agg(F.min(F.struct("d", member)).alias("b")).select(F.col(f"b.{member}").alias(member), F.col("b.d").alias("d"))


def histogram_divergence(a: DataFrame, b: DataFrame, x: str, y: str, bins: int = 32) -> DataFrame:
    """Jensen-Shannon divergence of two point sets on one common grid."""
    both = a.select(x, y, F.lit(0).alias("s")).unionByName(b.select(x, y, F.lit(1).alias("s")))
    lim = both.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))

    def cell(v: str, lo: str, hi: str):
        return F.least(F.floor((F.col(v) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(EPS)) * bins), F.lit(bins - 1))

    h = both.join(F.broadcast(lim)).groupBy(cell(x, "x0", "x1").alias("cx"), cell(y, "y0", "y1").alias("cy")).agg(
        F.count_if(F.col("s") == 0).alias("p"), F.count_if(F.col("s") == 1).alias("q")
    )
    t = h.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    p, q = F.col("p") / F.col("tp"), F.col("q") / F.col("tq")
    m = (p + q) / 2
    part = F.when(p > 0, p * F.log(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log(q / m)).otherwise(0.0)
    return h.join(F.broadcast(t)).agg((F.sum(part) / 2).alias("js"))
