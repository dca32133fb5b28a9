"""Catalog: pairings, association filter, components, consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.core.catalog import query
from loomgraph.operators import components as C
from loomgraph.operators import consensus as K
from loomgraph.operators import pairing as P
from loomgraph.sources import tables as T

COUNTS = "counts AS (SELECT uei, umi0, umi1, for_index, rev_index, count(*) AS n_reads FROM reads GROUP BY ALL)"
PAIRS = """pairs AS (SELECT uei, umi0, umi1, for_index, rev_index, n_reads FROM (
  SELECT *, rank() OVER (PARTITION BY uei ORDER BY n_reads DESC) AS rk, count(*) OVER (PARTITION BY uei, n_reads) AS ways FROM counts)
  WHERE rk = 1 AND ways = 1)"""
ASSOC = "assoc AS (SELECT umi0, umi1, 2 AS uei_type, count(*) AS n_uei, CAST(sum(n_reads) AS BIGINT) AS n_reads FROM pairs GROUP BY 1, 2)"


def filter_sql(min_reads: int, min_uei: int, per_umi: int, rounds: int = 8) -> str:
    """The filter unrolled for more rounds than it needs (it is idempotent)."""
    out = [f"f0 AS MATERIALIZED (SELECT * FROM assoc WHERE n_reads >= {min_reads} AND n_uei >= {min_uei})"]
    for r in range(1, rounds + 1):
        out.append(f"g{r} AS MATERIALIZED (SELECT * FROM f{r - 1} WHERE umi0 IN (SELECT umi0 FROM f{r - 1} GROUP BY umi0 HAVING sum(n_uei) >= {per_umi}))")
        out.append(f"f{r} AS MATERIALIZED (SELECT * FROM g{r} WHERE umi1 IN (SELECT umi1 FROM g{r} GROUP BY umi1 HAVING sum(n_uei) >= {per_umi}))")
    out.append(f"filtered AS (SELECT * FROM f{rounds})")
    return ", ".join(out)


BASE = f"{T.READS}, {COUNTS}, {PAIRS}, {ASSOC}"


def _counts(spark, folder):
    return P.pair_counts(T.read_rows(spark, folder).select("uei", "umi0", "umi1", "for_index", "rev_index"))


def _assoc(spark, folder):
    return P.consolidate(P.consensus_pairs(_counts(spark, folder)))


@query("uei_pair_counts", f"WITH {T.READS}, {COUNTS} SELECT * FROM counts", ("AGG10", "PRJ9"))
def uei_pair_counts(spark, folder):
    return _counts(spark, folder)


@query("uei_consensus_pairs", f"WITH {T.READS}, {COUNTS}, {PAIRS} SELECT * FROM pairs", ("WIN4",))
def uei_consensus_pairs(spark, folder):
    return P.consensus_pairs(_counts(spark, folder))


@query("read_triples", """SELECT o_orderkey AS read_id, o_custkey % 100 AS uei, o_custkey AS umi0, o_orderkey % 977 AS umi1,
  0 AS for_index, 1 AS rev_index FROM orders WHERE o_totalprice >= 50000""", ("JN5", "PRJ9"))
def read_triples(spark, folder):
    o = T.table(spark, folder, "orders")
    low = F.when(F.col("o_totalprice") < 50000, -1).otherwise(F.col("o_custkey"))
    entries = F.array(
        F.struct(F.lit(0).alias("k"), low.alias("clust")),
        F.struct(F.lit(1).alias("k"), (F.col("o_orderkey") % 977).alias("clust")),
        F.struct(F.lit(2).alias("k"), (F.col("o_custkey") % 100).alias("clust")),
    )
    long = o.select(F.col("o_orderkey").alias("read_id"), F.lit(0).alias("for_index"), F.lit(1).alias("rev_index"), F.inline(entries))
    return P.read_triples(long)


@query("assoc_consolidated", f"WITH {BASE} SELECT * FROM assoc", ("AGG11", "WIN5", "SET4"))
def assoc_consolidated(spark, folder):
    return _assoc(spark, folder)


@query("assoc_filter_fixpoint", f"WITH {BASE}, {filter_sql(4, 1, 5)} SELECT * FROM filtered", ("AGG12", "JN13"))
def assoc_filter_fixpoint(spark, folder):
    return P.filter_associations(_assoc(spark, folder), 4, 1, 5)[0]


@query("assoc_filter_empties", f"WITH {BASE}, {filter_sql(7, 1, 6)} SELECT * FROM filtered", ("AGG12",))
def assoc_filter_empties(spark, folder):
    return P.filter_associations(_assoc(spark, folder), 7, 1, 6)[0]


COMP = """shift AS (SELECT max(umi0) + 1 AS s FROM filtered),
half AS (SELECT umi0 AS a, umi1 + s AS b FROM filtered, shift),
sym AS MATERIALIZED (SELECT a, b FROM half UNION SELECT b, a FROM half UNION SELECT a, a FROM half UNION SELECT b, b FROM half),
prop(it, node, comp) AS (SELECT 0, a, a FROM sym WHERE a = b
  UNION ALL SELECT p.it + 1, s.a, min(p.comp) FROM prop p JOIN sym s ON s.b = p.node WHERE p.it < 40 GROUP BY p.it, s.a),
comps AS (SELECT node AS node_id, comp FROM prop WHERE it = 40)"""


def _graph(spark, folder, *limits):
    kept = P.filter_associations(_assoc(spark, folder), *limits)[0]
    return C.bipartite_nodes(kept, "umi0", "umi1")


def ranked_components(spark, folder, *limits):
    e = _graph(spark, folder, *limits)
    return C.component_sizes(C.components(e, "i", "j"))


@query("components", f"WITH RECURSIVE {BASE}, {filter_sql(5, 2, 2)}, {COMP} SELECT * FROM comps", ("GR3", "AGG32"))
def components(spark, folder):
    return C.components(_graph(spark, folder, 5, 2, 2), "i", "j")


@query("component_sizes_ranked", f"""WITH RECURSIVE {BASE}, {filter_sql(5, 2, 2)}, {COMP}
SELECT comp, count(*) AS comp_size, row_number() OVER (ORDER BY count(*) DESC, comp) - 1 AS comp_rank FROM comps GROUP BY comp""", ("AGG13", "WIN8", "GR4"))
def component_sizes_ranked(spark, folder):
    return ranked_components(spark, folder, 5, 2, 2)


@query("component_split_edges", f"""WITH RECURSIVE {BASE}, {filter_sql(5, 2, 2)}, {COMP},
sizes AS (SELECT comp, count(*) AS comp_size, row_number() OVER (ORDER BY count(*) DESC, comp) - 1 AS comp_rank FROM comps GROUP BY comp)
SELECT umi0, umi1, f.n_uei, f.n_reads, comp_rank FROM filtered f JOIN comps ON node_id = umi0 JOIN sizes USING (comp)
WHERE comp_rank < 10 AND comp_size >= 5""", ("GR4", "JN14", "SNK2"))
def component_split_edges(spark, folder):
    """Edges of the ten largest groups of at least five molecules."""
    from loomgraph.core.skew import lookup

    e = _graph(spark, folder, 5, 2, 2)
    labels = C.components(e, "i", "j")
    top = C.component_sizes(labels, min_size=5).where("comp_rank < 10").select("comp", "comp_rank")
    nodes = lookup(labels, top, "comp").select(F.col("node_id").alias("i"), "comp_rank")
    return lookup(e, nodes, "i").select("umi0", "umi1", "n_uei", "n_reads", "comp_rank")


@query("largest_component", f"""WITH RECURSIVE {BASE}, {filter_sql(5, 2, 2)}, {COMP}
SELECT node_id, comp FROM comps WHERE comp = (SELECT comp FROM comps GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1)""", ("GR8",))
def largest_component(spark, folder):
    return C.largest_component(C.components(_graph(spark, folder, 5, 2, 2), "i", "j")).select("node_id", "comp")


@query("giant_component_fraction", f"""WITH RECURSIVE {BASE}, {filter_sql(5, 2, 2)}, {COMP}, s AS (SELECT count(*) AS n FROM comps GROUP BY comp)
SELECT round(max(n) / sum(n), 9) AS giant_fraction, count(*) AS n_components FROM s""", ("GR29",))
def giant_component_fraction(spark, folder):
    g = C.giant_fraction(C.components(_graph(spark, folder, 5, 2, 2), "i", "j"))
    return g.select(F.round("giant_fraction", 9).alias("giant_fraction"), "n_components")


@query("extra_edges", f"""WITH {BASE}, {filter_sql(5, 2, 2)},
cand AS (SELECT umi0, umi1, CAST(sum(n_reads) AS BIGINT) AS n_reads FROM pairs GROUP BY 1, 2 HAVING sum(n_reads) >= 2)
SELECT c.umi0, c.umi1, c.n_reads FROM cand c WHERE umi0 IN (SELECT umi0 FROM filtered) AND umi1 IN (SELECT umi1 FROM filtered)
AND NOT EXISTS (SELECT 1 FROM filtered f WHERE f.umi0 = c.umi0 AND f.umi1 = c.umi1)""", ("JN15", "JN16", "AGG14", "SET3", "SET6"))
def extra_edges(spark, folder):
    pairs = P.consensus_pairs(_counts(spark, folder))
    group = P.filter_associations(P.consolidate(pairs), 5, 2, 2)[0]
    return P.extra_edges(pairs, group, 2)


@query("either_endpoint_labelled", f"""WITH {T.EDGES}, {T.LABELS}, l1 AS (SELECT node_id FROM node_labels WHERE label = 0),
l0 AS (SELECT s_suppkey AS node_id FROM supplier WHERE s_acctbal > 5000)
SELECT src AS umi0, dst AS umi1, n_uei, n_reads FROM edges WHERE src IN (SELECT node_id FROM l0) OR dst IN (SELECT node_id FROM l1)""", ("JN17",))
def either_endpoint_labelled(spark, folder):
    e = T.edges(spark, folder).select(F.col("src").alias("umi0"), F.col("dst").alias("umi1"), "n_uei", "n_reads")
    l0 = T.table(spark, folder, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("node_id"))
    l1 = T.part_labels(spark, folder).where("label = 0")
    return P.endpoint_labelled(e, l0, l1).select("umi0", "umi1", "n_uei", "n_reads")


@query("read_abundance_hist", f"""WITH {T.READS}, t AS (
  SELECT 'umi0' AS kind, umi0 AS id, count(*) AS n FROM reads GROUP BY ALL UNION ALL
  SELECT 'umi1', umi1, count(*) FROM reads GROUP BY ALL UNION ALL SELECT 'uei', uei, count(*) FROM reads GROUP BY ALL)
SELECT kind, count(*) FILTER (n = 1) AS once, count(*) FILTER (n = 2) AS twice, count(*) FILTER (n NOT IN (1, 2)) AS more FROM t GROUP BY kind""", ("AGG7", "AGG8"))
def read_abundance_hist(spark, folder):
    r = T.read_rows(spark, folder)
    kinds = F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("id")) for c in ("umi0", "umi1", "uei")]))
    totals = r.select(kinds).groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n"))
    return totals.groupBy("kind").agg(
        F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"), F.count_if(~F.col("n").isin(1, 2)).alias("more")
    )


# ---------------------------------------------------------------- consensus
STOPS, MIN_INSERT = ("ACGTAC", "GGTTC"), 10
CONS = """chars AS (SELECT umi, substr(insert_seq, 1, 10) AS kmer, p, substr(insert_seq, p, 1) AS b
  FROM (SELECT umi, insert_seq, unnest(range(1, length(insert_seq) + 1)) AS p FROM inserts WHERE length(insert_seq) > 0)),
votes AS (SELECT umi, kmer, p, count(*) FILTER (b = 'A') AS a, count(*) FILTER (b = 'C') AS c, count(*) FILTER (b = 'G') AS g,
  count(*) FILTER (b = 'T') AS t FROM chars GROUP BY ALL),
called AS (SELECT umi, kmer, p, CASE WHEN a > c AND a > g AND a > t THEN 'A' WHEN c > a AND c > g AND c > t THEN 'C'
  WHEN g > a AND g > c AND g > t THEN 'G' WHEN t > a AND t > c AND t > g THEN 'T' ELSE 'N' END AS base FROM votes),
seqs AS (SELECT umi, kmer, string_agg(base, '' ORDER BY p) AS consensus FROM called GROUP BY ALL),
sizes AS (SELECT umi, substr(insert_seq, 1, 10) AS kmer, count(*) AS n_reads FROM inserts WHERE length(insert_seq) > 0 GROUP BY ALL),
named AS (SELECT *, printf('%s.%07d.sub%d', CAST(umi AS VARCHAR), n_reads, sub) AS fqn FROM (
  SELECT *, row_number() OVER (PARTITION BY umi ORDER BY kmer) - 1 AS sub FROM seqs JOIN sizes USING (umi, kmer)))"""
FRAGS = """cuts AS (SELECT *, substr(consensus, 1, CAST(least(CASE WHEN strpos(consensus, 'ACGTAC') > 0 THEN strpos(consensus, 'ACGTAC') - 1 ELSE length(consensus) END,
  CASE WHEN strpos(consensus, 'GGTTC') > 0 THEN strpos(consensus, 'GGTTC') - 1 ELSE length(consensus) END) AS INT)) AS fragment FROM named),
frags AS (SELECT * FROM cuts WHERE length(fragment) >= 10)"""


def _named(spark, folder):
    return K.numbered(K.consensus(T.inserts(spark, folder)))


@query("consensus_sequence", f"WITH {T.INSERTS}, {CONS} SELECT umi, kmer, consensus, n_reads FROM named", ("AGG4", "PRJ10", "JN6"))
def consensus_sequence(spark, folder):
    return K.consensus(T.inserts(spark, folder))


@query("subconsensus_per_umi", f"WITH {T.INSERTS}, {CONS} SELECT umi, kmer, sub, n_reads, fqn FROM named", ("AGG5", "WIN24", "PRJ12"))
def subconsensus_per_umi(spark, folder):
    return _named(spark, folder).select("umi", "kmer", "sub", "n_reads", "fqn")


@query("fqn_fields", f"WITH {T.INSERTS}, {CONS} SELECT fqn, CAST(umi AS VARCHAR) AS umi_part, n_reads AS reads_part, sub AS sub_part FROM named", ("PRJ12",))
def fqn_fields(spark, folder):
    return _named(spark, folder).select("fqn", *K.split_fqn())


@query("trimmed_fragments", f"WITH {T.INSERTS}, {CONS}, {FRAGS} SELECT umi, sub, fqn, fragment FROM frags", ("PRJ11",))
def trimmed_fragments(spark, folder):
    return K.trimmed(_named(spark, folder), STOPS, MIN_INSERT).select("umi", "sub", "fqn", "fragment")


@query("fasta_lines", f"WITH {T.INSERTS}, {CONS}, {FRAGS} SELECT '>' || fqn || chr(10) || fragment AS value FROM frags", ("SNK4",))
def fasta_lines(spark, folder):
    return K.fasta_lines(K.trimmed(_named(spark, folder), STOPS, MIN_INSERT))


@query("left_join_fragments", f"""WITH {T.INSERTS}, {CONS}, {FRAGS}, tot AS (SELECT umi, CAST(sum(n_reads) AS BIGINT) AS umi_reads FROM named GROUP BY umi)
SELECT t.umi, umi_reads, sub, coalesce(fragment, 'N') AS fragment, coalesce(n_reads, 0) AS n_reads FROM tot t LEFT JOIN frags f ON f.umi = t.umi""", ("JN7", "AGG6"))
def left_join_fragments(spark, folder):
    named = _named(spark, folder)
    return K.fragments_per_umi(named, K.trimmed(named, STOPS, MIN_INSERT))


@query("fragment_abundance_hist", f"""WITH {T.INSERTS}, {CONS}, {FRAGS}
SELECT 'fragment' AS kind, count(*) FILTER (n = 1) AS once, count(*) FILTER (n = 2) AS twice, count(*) FILTER (n NOT IN (1, 2)) AS more
FROM (SELECT fragment, sum(n_reads) AS n FROM frags GROUP BY 1)""", ("AGG9",))
def fragment_abundance_hist(spark, folder):
    frags = K.trimmed(_named(spark, folder), STOPS, MIN_INSERT)
    return P.abundance_histogram(frags.groupBy("fragment").agg(F.sum("n_reads").alias("n")), "n", "fragment")


@query("label_entries", f"""WITH {T.ASSIGN}, g AS (SELECT umi, fqn, gene, contig, max(sub_reads) AS sub_reads, count(*) AS uei_reads FROM assign GROUP BY ALL)
SELECT umi, fqn, gene, contig, sub_reads, uei_reads,
  row_number() OVER (PARTITION BY umi ORDER BY sub_reads DESC, uei_reads DESC, fqn, gene) - 1 AS place FROM g""", ("AGG15", "T15"))
def label_entries(spark, folder):
    a = T.assignments(spark, folder)
    g = a.groupBy("umi", "fqn", "gene", "contig").agg(F.max("sub_reads").alias("sub_reads"), F.count(F.lit(1)).alias("uei_reads"))
    return K.label_entries(g)
