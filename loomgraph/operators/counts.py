"""Sparse count matrices in long form: build, normalise, gate, summarise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.core.order import group_index
from loomgraph.core.session import cut
from loomgraph.core.skew import lookup
from loomgraph.functions.seq import is_placeholder

GENOME = "__genome__:"


def feature_name(gene: str = "gene", biotype: str = "biotype", contig: str = "contig") -> tuple[Column, Column]:
    """Feature and its biotype; unannotated rows fall back to their contig."""
    blank = F.coalesce(F.trim(F.col(biotype)), F.lit(""))
    genomic = is_placeholder(gene) & ((blank == "") | (F.lower(blank) == "genome"))
    where = F.when(is_placeholder(contig), "unknown").otherwise(F.col(contig))
    return (
        F.when(genomic, F.concat(F.lit(GENOME), where)).otherwise(F.trim(F.col(gene))),
        F.when(genomic, "genome").when(blank == "", "gene").otherwise(blank),
    )


def feature_calls(assign: DataFrame, keep_ambiguous: bool = False) -> DataFrame:
    """One row per (node, sub-consensus, feature) with its reads.

    Repeated calls inside a sub-consensus collapse; then sub-consensuses with
    more than one feature are dropped unless asked for.
    """
    feat, bt = feature_name()
    calls = assign.withColumn("feature", feat).withColumn("bt", bt).groupBy("umi", "fqn", "feature").agg(
        F.min("bt").alias("biotype"), F.max("sub_reads").alias("sub_reads")
    )
    if keep_ambiguous:
        return calls
    one = calls.groupBy("umi", "fqn").agg(
        F.count(F.lit(1)).alias("n"), F.min("feature").alias("feature"), F.min("biotype").alias("biotype"), F.min("sub_reads").alias("sub_reads")
    )
    return one.where("n = 1").drop("n")


def count_matrix(calls: DataFrame) -> DataFrame:
    return calls.groupBy("umi", "feature").agg(F.sum("sub_reads").alias("n"))


def feature_biotypes(calls: DataFrame) -> DataFrame:
    """Biotype with most reads per feature (ties: the larger name)."""
    per = calls.groupBy("feature", "biotype").agg(F.sum("sub_reads").alias("reads"))
    top = per.groupBy("feature").agg(F.max(F.struct("reads", "biotype")).alias("t"))
    return top.select("feature", F.col("t.biotype").alias("biotype"), F.col("t.reads").alias("reads"))


def node_summary(assign: DataFrame, calls: DataFrame) -> DataFrame:
    """Per node: sub-consensuses, features with reads, all sub reads."""
    subs = assign.groupBy("umi", "fqn").agg(F.max("sub_reads").alias("r"))
    a = subs.groupBy("umi").agg(F.count(F.lit(1)).alias("n_subclusters"), F.sum("r").alias("total_sub_reads"))
    b = calls.groupBy("umi").agg(F.countDistinct("feature").alias("n_annotated"))
    return a.join(b, "umi", "left").select("umi", "n_subclusters", "total_sub_reads", F.coalesce("n_annotated", F.lit(0)).alias("n_annotated"))


def binarise(counts: DataFrame, n: str = "n", least: int = 1) -> DataFrame:
    return counts.where(F.col(n) >= least).withColumn(n, F.lit(1).cast("long"))


def log_normalise(counts: DataFrame, row: str, n: str = "n", scale: float = 1e4) -> DataFrame:
    """log1p of counts scaled to a fixed row total."""
    total = counts.groupBy(row).agg(F.sum(n).alias("_t"))
    return lookup(counts, total, row).withColumn("value", F.log1p(F.col(n) * scale / F.col("_t"))).drop("_t")


def collapse_names(counts: DataFrame, row: str, feature: str, n: str = "n") -> DataFrame:
    """Columns whose names differ only in case are summed."""
    return counts.groupBy(row, F.lower(F.trim(feature)).alias(feature)).agg(F.sum(n).alias(n))


def heaviest_spelling(counts: DataFrame, feature: str, n: str = "n") -> DataFrame:
    """Of columns that differ only in case keep the one with the largest total."""
    totals = counts.groupBy(feature).agg(F.sum(n).alias("t"))
    best = totals.groupBy(F.lower(feature).alias("low")).agg(F.min(F.struct((-F.col("t")).alias("neg"), F.col(feature).alias("name"))).alias("b"))
    return counts.join(best.select(F.col("b.name").alias(feature)), feature, "left_semi")


def shared_features(a: DataFrame, b: DataFrame, feature: str, n: str = "n", least: int = 5) -> DataFrame:
    """Lower-case names present on both sides, with enough counts on the second."""
    left = a.select(F.lower(feature).alias(feature)).distinct()
    right = b.groupBy(F.lower(feature).alias(feature)).agg(F.sum(n).alias("total")).where(F.col("total") >= least)
    return right.join(left, feature, "left_semi")


def rrna_features(counts: DataFrame, kinds: DataFrame, row: str, feature: str, n: str = "n") -> DataFrame:
    """Raw rRNA columns are replaced by two any-positive columns per row."""
    k = F.lower(F.regexp_replace(F.col("biotype"), r"[\s-]+", "_"))
    joined = lookup(counts, kinds.select(feature, k.alias("_k")), feature, "left")
    name = F.when(F.col("_k").contains("rrna") & F.col("_k").contains("mt"), "Mt_rRNA_sum").when(F.col("_k").contains("rrna"), "rRNA_sum")
    pseudo = joined.where(name.isNotNull() & (F.col(n) > 0)).select(row, name.alias(feature)).distinct().withColumn(n, F.lit(1).cast("long"))
    plain = joined.where(name.isNull()).groupBy(row, feature).agg(F.sum(n).alias(n))
    return plain.unionByName(pseudo)


def quality_gates(counts: DataFrame, cell: str, gene: str, n: str, min_counts: int, min_genes: int, min_cells: int) -> DataFrame:
    """Cells with enough counts, of those with enough genes, genes in enough cells."""
    per = counts.groupBy(cell).agg(F.sum(n).alias("t"), F.count_if(F.col(n) > 0).alias("g"))
    cells = per.where((F.col("t") >= min_counts) & (F.col("g") >= min_genes)).select(cell)
    kept = lookup(counts, cells, cell, "left_semi")
    genes = kept.where(F.col(n) > 0).groupBy(gene).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_cells).select(gene)
    return lookup(kept, genes, gene, "left_semi")


def gate_report(counts: DataFrame, cell: str, n: str, min_counts: int, min_genes: int) -> DataFrame:
    per = counts.groupBy(cell).agg(F.sum(n).alias("t"), F.count_if(F.col(n) > 0).alias("g"))
    reason = F.when(F.col("t") < min_counts, "fail_min_counts").when(F.col("g") < min_genes, "fail_min_genes").otherwise("pass")
    return per.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_cells"))


def feature_moments(counts: DataFrame, rows: DataFrame, feature: str, value: str) -> DataFrame:
    """Mean, population variance and detection over all rows, absent entries being 0.

    ``rows`` is a one-row table with the number of rows, ``n_rows``.
    """
    s = counts.groupBy(feature).agg(
        F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"), F.count_if(F.col(value) > 0).alias("d")
    )
    mean = F.col("s") / F.col("n_rows")
    return s.join(F.broadcast(rows)).select(
        feature,
        mean.alias("mean"),
        F.greatest(F.col("ss") / F.col("n_rows") - mean * mean, F.lit(0.0)).alias("variance"),
        (F.col("d") / F.col("n_rows")).alias("detection"),
    )


def hub_to_cell(counts: DataFrame, cells: DataFrame, hub: str = "hub", gene: str = "gene", n: str = "n", least: int = 1) -> DataFrame:
    """Binarised hub calls summed per cell (cells: hub, cell)."""
    calls = lookup(binarise(counts, n, least), cells, hub)
    return calls.groupBy("cell", gene).agg(F.sum(n).alias("n_hubs"))


def cell_summary(counts: DataFrame, cells: DataFrame, hub: str = "hub", gene: str = "gene", n: str = "n", least: int = 1) -> DataFrame:
    per_hub = binarise(counts, n, least).groupBy(hub).agg(F.count(F.lit(1)).alias("genes"))
    joined = cells.join(per_hub, hub, "left")
    a = joined.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_hubs"), F.count("genes").alias("n_hubs_with_call"), F.count_if(F.col("genes") > 1).alias("n_multigene_hubs")
    )
    b = hub_to_cell(counts, cells, hub, gene, n, least).groupBy("cell").agg(F.count(F.lit(1)).alias("n_genes"))
    return a.join(b, "cell", "left").select("cell", "n_hubs", "n_hubs_with_call", "n_multigene_hubs", F.coalesce("n_genes", F.lit(0)).alias("n_genes"))


def cluster_markers(counts: DataFrame, clusters: DataFrame, cell: str, gene: str, n: str = "n") -> DataFrame:
    """Cluster versus rest: CPM fold change and detection shares per gene.

    The rest is the total minus the cluster.  Cluster totals and gene totals
    have one row each per cluster or gene; they are made from the kept sums, so
    the counts are read once for these and not once for each.
    """
    x = lookup(counts, clusters.select(cell, "cluster"), cell)
    inside = cut(x.groupBy("cluster", gene).agg(F.sum(n).alias("s_in"), F.count_if(F.col(n) > 0).alias("d_in")))
    all_genes = inside.groupBy(gene).agg(F.sum("s_in").alias("s_all"), F.sum("d_in").alias("d_all"))
    lib = inside.groupBy("cluster").agg(F.sum("s_in").alias("lib_in"))
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("c_in"))
    head = cut(size.join(lib, "cluster"))
    whole = head.agg(F.sum("lib_in").alias("lib_all"), F.sum("c_in").alias("c_all"))
    grid = lookup(inside, all_genes, gene)
    grid = lookup(grid, head, "cluster").join(F.broadcast(whole))
    pc = 0.5
    n_genes = all_genes.agg(F.count(F.lit(1)).alias("n_genes"))
    grid = grid.join(F.broadcast(n_genes))
    cpm_in = (F.col("s_in") + pc) / (F.col("lib_in") + pc * F.col("n_genes")) * 1e6
    cpm_out = (F.col("s_all") - F.col("s_in") + pc) / (F.col("lib_all") - F.col("lib_in") + pc * F.col("n_genes")) * 1e6
    out_cells = F.greatest(F.col("c_all") - F.col("c_in"), F.lit(1))
    return grid.select(
        "cluster",
        gene,
        F.log2(cpm_in / cpm_out).alias("log2fc"),
        (F.col("d_in") / F.col("c_in")).alias("pct_in"),
        ((F.col("d_all") - F.col("d_in")) / out_cells).alias("pct_out"),
    )


def marker_score(log2fc: Column, fdr: Column | None, pct_in: Column) -> Column:
    weight = F.lit(1.0) if fdr is None else F.least(-F.log10(F.greatest(fdr, F.lit(1e-300))), F.lit(20.0))
    return F.greatest(log2fc, F.lit(0.0)) * weight * F.sqrt(pct_in + 1e-6)


def select_markers(df: DataFrame, strict: Column, fallback: Column, per_cluster: int = 12, most: int = 160) -> DataFrame:
    """Top rows per cluster from its best non-empty tier, one row per gene.

    Tiers: strict, else fallback, else everything.  The ranking is global, so a
    cluster is never a single task.
    """
    tier = F.when(strict, 0).when(fallback, 1).otherwise(2)
    tagged = df.withColumn("tier", tier)
    best = tagged.groupBy("cluster").agg(F.min("tier").alias("best"))
    kept = lookup(tagged, best, "cluster").where(F.col("tier") <= F.col("best")).drop("best", "tier")
    order = [F.desc("score"), F.desc("log2fc"), F.desc("pct_in"), F.col("gene")]
    top = group_index(kept, ["cluster"], [F.col("cluster"), *order], "place").where(F.col("place") < per_cluster)
    key = F.struct((-F.col("score")).alias("a"), (-F.col("log2fc")).alias("b"), (-F.col("pct_in")).alias("c"), "gene", "cluster")
    one = top.groupBy("gene").agg(F.min(key).alias("k")).select("k.gene", "k.cluster", (-F.col("k.a")).alias("score"), (-F.col("k.b")).alias("log2fc"), (-F.col("k.c")).alias("pct_in"))
    ranked = one.orderBy(*order).limit(most)
    return ranked


def row_zscore(values: DataFrame, row: str, value: str, limit: float = 2.5) -> DataFrame:
    stats = values.groupBy(row).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.when(F.col("_s") > 1e-9, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return lookup(values, stats, row).withColumn("z", F.greatest(F.least(z, F.lit(limit)), F.lit(-limit))).drop("_m", "_s")


def jaccard_pairs(calls: DataFrame, row: str, feature: str, first: Sequence[str], second: Sequence[str] | None = None) -> DataFrame:
    """Jaccard index of every gene pair inside a module or across two modules.

    Modules are explicit gene lists, so a row has a bounded number of pairs.
    """
    names = list(first) + list(second or [])
    x = calls.where(F.col(feature).isin(names)).select(row, feature).distinct()
    per = x.groupBy(row).agg(F.array_sort(F.collect_set(feature)).alias("g"))
    a = F.filter("g", lambda v: v.isin(list(first)))
    b = a if second is None else F.filter("g", lambda v: v.isin(list(second)))
    pairs = per.select(F.explode(a).alias("a"), b.alias("bs")).select("a", F.explode("bs").alias("b"))
    if second is None:
        pairs = pairs.where("a < b")
    inter = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    size = F.broadcast(x.groupBy(feature).agg(F.count(F.lit(1)).alias("k")))  # one row per listed gene
    sa = size.select(F.col(feature).alias("a"), F.col("k").alias("na"))
    sb = size.select(F.col(feature).alias("b"), F.col("k").alias("nb"))
    listed = [(p, q) for p in first for q in (second if second is not None else first) if second is not None or p < q]
    grid = calls.sparkSession.createDataFrame(listed, "a string, b string").join(sa, "a").join(sb, "b")
    full = grid.join(F.broadcast(inter), ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    union = F.col("na") + F.col("nb") - F.col("both")
    return full.select("a", "b", "both", F.when(union > 0, F.col("both") / union).otherwise(0.0).alias("jaccard"))
