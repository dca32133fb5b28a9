"""Reads to the molecule graph: the library pipeline as one chain of plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.core.order import dense_index
from loomgraph.core.session import cut
from loomgraph.core.skew import lookup
from loomgraph.operators import barcodes as B
from loomgraph.operators import components as C
from loomgraph.operators import consensus as K
from loomgraph.operators import pairing as P
from loomgraph.operators import reads as R
from loomgraph.sources.fastq import read_fastq
from loomgraph.sources.settings import LibrarySettings


@dataclass
class Library:
    parsed: DataFrame
    stacked: DataFrame
    clusters: DataFrame  # read_id, k, clust
    pairs: DataFrame
    edges: DataFrame
    components: DataFrame


def load_pairs(spark: SparkSession, s: LibrarySettings, range_bytes: int | None = None) -> DataFrame:
    """Mates that both pass the quality filter; one mate may be missing."""
    more = {} if range_bytes is None else {"range_bytes": range_bytes}
    fwd = read_fastq(spark, s.source_for, 1, **more)
    if not s.source_rev:
        return R.single_end(fwd, s.min_mean_qual)
    return R.join_mates(fwd.unionByName(read_fastq(spark, s.source_rev, 2, **more)), s.min_mean_qual)


def cluster_stack(stacked: DataFrame, k: int) -> DataFrame:
    """(read_id, k, clust) of one barcode stack."""
    mine = stacked.where(F.col("k") == k).select("read_id", "seq")
    uniq = cut(B.unique_sequences(mine))
    length = uniq.agg(F.max(F.length("seq"))).first()[0] or 0
    groups, _ = B.directional_clusters(uniq, length)
    return B.read_clusters(mine, uniq, groups).withColumn("k", F.lit(k))


def build(pairs: DataFrame, s: LibrarySettings) -> Library:
    """Parse, cluster, pair, filter and split."""
    parsed = cut(R.parse_reads(pairs, s.for_forms, s.rev_forms))
    stacked = cut(R.restack(parsed, s.uxis))
    R.require_uniform(stacked)
    clusters = None
    for k in sorted(s.uxis):
        part = cluster_stack(stacked, k)
        clusters = part if clusters is None else clusters.unionByName(part)
    forms = parsed.select("read_id", "for_index", "rev_index")
    clusters = cut(clusters.join(forms, "read_id"))
    counts = P.pair_counts(P.read_triples(clusters))
    chosen = cut(P.consensus_pairs(counts))
    edges, _ = P.filter_associations(P.consolidate(chosen), s.min_reads_per_assoc, s.min_uei_per_assoc, s.min_uei_per_umi)
    comps = C.components(C.bipartite_nodes(edges, "umi0", "umi1"), "i", "j")
    return Library(parsed, stacked, clusters, chosen, edges, comps)


def inserts_of(parsed: DataFrame, clusters: DataFrame, s: LibrarySettings, k: int = 0) -> DataFrame:
    """Insert of each read with the cluster of its barcode (low complexity left out)."""
    amp = parsed.select("read_id", F.array("for_amp", "rev_amp").alias("_all"), "for_index", "rev_index")
    value = None
    for slot in s.amplicons.get(k, []):
        cond = F.lit(True)
        if slot.for_index is not None:
            cond = cond & (F.col("for_index") == slot.for_index)
        if slot.rev_index is not None:
            cond = cond & (F.col("rev_index") == slot.rev_index)
        piece = F.get(F.col("_all"), F.lit(slot.position))
        value = F.when(cond, piece) if value is None else value.when(cond, piece)
    seqs = amp.select("read_id", (value if value is not None else F.col("_all")[0]).alias("insert_seq"))
    mine = clusters.where((F.col("k") == k) & (F.col("clust") >= 0)).select("read_id", F.col("clust").alias("umi"))
    return mine.join(seqs, "read_id")


def fragments(inserts: DataFrame, s: LibrarySettings, k: int = 0) -> tuple[DataFrame, DataFrame]:
    """Named sub-consensuses of side ``k`` and their fragments, trimmed to that side's least length."""
    named = K.numbered(K.consensus(inserts))
    return named, K.trimmed(named, s.terminators, s.amp_len[k] or 0)


def match_libraries(cdna: DataFrame, uei: DataFrame, subs: DataFrame) -> DataFrame:
    """Sub-consensuses of a cDNA library on the UEI clusters of the same barcodes.

    ``cdna`` and ``uei`` are (seq, clust).  Reads count once per shared member
    sequence; instead of one row per member, pairs of clusters carry the number
    of shared sequences as a weight.
    """
    shared = cdna.select("seq", F.col("clust").alias("umi")).join(uei.select("seq", F.col("clust").alias("uei_clust")), "seq")
    weights = shared.groupBy("umi", "uei_clust").agg(F.count(F.lit(1)).alias("n_shared"))
    return subs.join(weights, "umi").withColumn("n_reads", F.col("n_reads") * F.col("n_shared"))


def quick_labels(totals: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """(umi, reads, match): number of a known sequence among the members, or -1."""
    hits = lookup(members, known.select("seq", F.col("index").alias("match")), "seq").groupBy("umi").agg(F.min("match").alias("match"))
    return totals.join(hits, "umi", "left").withColumn("match", F.coalesce("match", F.lit(-1)))


def numbered_nodes(labels: DataFrame) -> DataFrame:
    return dense_index(labels.select("node_id"), ["node_id"], "index")
