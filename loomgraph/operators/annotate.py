"""Alignments to annotated sub-consensuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.core.order import lookup_groups
from loomgraph.functions.seq import is_placeholder

BIN = 4_096
NEAR = 10
BLOCK = 4_096


def best_alignments(align: DataFrame, query: str = "query", share: str = "match_fraction") -> DataFrame:
    """All alignments of a query that share its best match fraction.

    The best value is a combinable aggregate joined back on the query.
    """
    best = align.groupBy(query).agg(F.max(share).alias("_best"))
    return align.join(best, query).where(F.col(share) == F.col("_best")).drop("_best")


def overlaps(positions: DataFrame, features: DataFrame, bin_width: int = BIN) -> DataFrame:
    """Distinct (contig, start) positions with each feature [lo, hi) they fall in.

    The range condition becomes an equality on (contig, bin).  A feature of at
    most 100 kb covers a bounded number of bins; a bin has at most ``bin_width``
    distinct positions, however many alignments pile up on one of them.
    """
    p = positions.select("contig", "start").distinct().withColumn("_bin", F.floor(F.col("start") / bin_width))
    span = F.sequence(F.floor(F.col("lo") / bin_width), F.floor((F.col("hi") - 1) / bin_width))
    f = features.where("hi > lo").withColumn("_bin", F.explode(span))
    return p.join(f, ["contig", "_bin"]).where("start >= lo AND start < hi").drop("_bin")


def _set_text(name: str) -> Column:
    kept = F.when(~is_placeholder(name), F.col(name))
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(kept)), "|"), F.lit("")), F.lit("NA"))


def attention_rank(biotype: Column, contig: Column) -> Column:
    """rRNA before numbered or mitochondrial contigs before the rest."""
    numbered = F.exists(F.split(contig, r"\|"), lambda c: c.rlike("^[0-9]+$"))
    return F.when(biotype.contains("rRNA"), 1).when(numbered | contig.contains("MT"), 2).otherwise(3)


def annotate(align: DataFrame, features: DataFrame, fields: Sequence[str] = ("gene", "biotype")) -> DataFrame:
    """Alignments with the sorted sets of what they fall in.

    Sets are built once per distinct position and looked up, so a locus that
    collects a third of all alignments costs one position.
    """
    hits = overlaps(align, features)
    sets = hits.groupBy("contig", "start").agg(*[_set_text(c).alias(c) for c in fields], F.count(F.lit(1)).alias("n_features"))
    at = align.select("contig", "start").distinct().join(sets, ["contig", "start"], "left")
    found = F.col("n_features").isNotNull()
    filled = at.select(
        "contig",
        "start",
        *[F.when(found, F.col(c)).otherwise("genome" if c == "biotype" else "NA").alias(c) for c in fields],
        F.coalesce("n_features", F.lit(0)).alias("n_features"),
        F.when(found, attention_rank(F.col("biotype"), F.col("contig"))).otherwise(4).alias("attention"),
    )
    return lookup_groups(align.drop(*fields), filled, ["contig", "start"])


def near_duplicates(stats: DataFrame) -> DataFrame:
    """The surviving name of each cluster of close starts in (umi, contig).

    ``stats`` has umi, contig, fqn, start, reads, score.  Starts are taken in
    order; a start within 10 of the first one of the open cluster joins it, else
    it opens the next.  The survivor has most reads, then the best mean score.

    Only distinct starts matter for the clusters.  They are cut into blocks of
    ``BLOCK`` positions.  What a block needs from earlier ones is how far the
    open cluster still reaches (0 to 10 positions), so each block is turned into
    a table of 11 exits, the tables are chained per (umi, contig), and every
    block then assigns its starts on its own.  A chain has at most (contig
    length / BLOCK) links and a block at most BLOCK starts.
    """
    group = ["umi", "contig"]
    block = F.floor(F.col("start") / BLOCK)
    starts = stats.groupBy(*group, block.alias("block")).agg(F.array_sort(F.collect_set("start")).alias("starts"))
    base = F.col("block") * BLOCK

    def run(entry: Column) -> Column:
        reach = F.aggregate("starts", base + entry, lambda end, s: F.when(s >= end, s + NEAR + 1).otherwise(end))
        return F.greatest(reach - base - BLOCK, F.lit(0).cast("long"))

    exits = starts.withColumn("exits", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(NEAR + 1).cast("long")), run))
    chain = exits.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("block", "exits"))).alias("chain"))
    zero = F.lit(0).cast("long")
    state = F.struct(
        F.lit(-2).cast("long").alias("last"), zero.alias("carry"), F.array().cast("array<struct<block:bigint,entry:bigint>>").alias("out")
    )

    def link(acc: Column, cell: Column) -> Column:
        entry = F.when(cell["block"] == acc["last"] + 1, acc["carry"]).otherwise(zero)
        return F.struct(
            cell["block"].alias("last"),
            F.element_at(cell["exits"], (entry + 1).cast("int")).alias("carry"),
            F.concat(acc["out"], F.array(F.struct(cell["block"].alias("block"), entry.alias("entry")))).alias("out"),
        )

    entries = chain.select(*group, F.inline(F.aggregate("chain", state, link)["out"]))
    opened = starts.join(entries, [*group, "block"])
    # anchor of a start: -1 stands for the cluster carried in from the block before
    walk = F.aggregate(
        "starts",
        F.struct((base + F.col("entry")).alias("end"), F.lit(-1).cast("long").alias("anchor"), F.array().cast("array<struct<start:bigint,anchor:bigint>>").alias("out")),
        lambda acc, s: F.struct(
            F.when(s >= acc["end"], s + NEAR + 1).otherwise(acc["end"]).alias("end"),
            F.when(s >= acc["end"], s).otherwise(acc["anchor"]).alias("anchor"),
            F.concat(acc["out"], F.array(F.struct(s.alias("start"), F.when(s >= acc["end"], s).otherwise(acc["anchor"]).alias("anchor")))).alias("out"),
        ),
    )["out"]
    placed = opened.select(*group, "block", F.inline(walk))
    last = placed.where("anchor >= 0").groupBy(*group, (F.col("block") + 1).alias("block")).agg(F.max("anchor").alias("carried"))
    anchors = placed.join(last, [*group, "block"], "left").select(
        *group, "start", F.when(F.col("anchor") >= 0, F.col("anchor")).otherwise(F.col("carried")).alias("anchor")
    )
    member = F.struct((-F.col("reads")).alias("r"), (-F.col("score")).alias("s"), "start", "fqn")
    best = stats.groupBy(*group, "start").agg(F.min(member).alias("m"), F.count(F.lit(1)).alias("n"))
    joined = best.join(anchors, [*group, "start"])
    out = joined.groupBy(*group, "anchor").agg(F.min("m").alias("m"), F.sum("n").alias("n_members"))
    return out.select(*group, "anchor", F.col("m.fqn").alias("fqn"), "n_members")


def duplicate_stats(align: DataFrame) -> DataFrame:
    """Per (umi, contig, name): smallest start, most reads, mean score."""
    return align.groupBy("umi", "contig", "fqn").agg(
        F.min("start").alias("start"), F.max("reads").alias("reads"), F.avg("score").alias("score")
    )


def keep_survivors(rows: DataFrame, survivors: DataFrame) -> DataFrame:
    """Rows whose (umi, name) survived on any contig."""
    return rows.join(survivors.select("umi", "fqn").distinct(), ["umi", "fqn"], "left_semi")


def gene_list(gene: Column | str = "gene", biotype: Column | str = "biotype") -> Column:
    """Gene names of a row; any rRNA biotype collapses them to one name."""
    gene, biotype = (F.col(x) if isinstance(x, str) else x for x in (gene, biotype))
    kinds = F.split(biotype, r"\|")
    return (
        F.when(F.array_contains(kinds, "Mt_rRNA"), F.array(F.lit("Mt_rRNA")))
        .when(F.array_contains(kinds, "rRNA"), F.array(F.lit("rRNA")))
        .otherwise(F.split(gene, r"\|"))
    )


def gene_support(rows: DataFrame) -> DataFrame:
    """Weight of each gene; a row gives 1/n to each of its n distinct genes."""
    known = rows.where(~is_placeholder("gene") & ~is_placeholder("biotype"))
    genes = known.select(F.array_distinct(gene_list()).alias("genes"))
    return genes.select(F.explode("genes").alias("gene"), (1.0 / F.size("genes")).alias("w")).groupBy("gene").agg(F.sum("w").alias("weight"))


def support_thresholds(support: DataFrame, limits: Sequence[int] = (1, 5, 10)) -> DataFrame:
    return support.agg(*[F.count_if(F.col("weight") >= n).alias(f"at_least_{n}") for n in limits])


def merge_columns(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Row-level dedup, then distinct values per column joined by ``|``.

    Every set holds the annotations of one sub-consensus.
    """
    flat = rows.select(*keys, *columns).distinct()
    return flat.groupBy(*keys).agg(*[F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|").alias(c) for c in columns])
