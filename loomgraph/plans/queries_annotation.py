"""Catalog: alignments, features, annotation, count matrices, cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.core.catalog import query
from loomgraph.functions import seq as S
from loomgraph.operators import annotate as A
from loomgraph.operators import counts as M
from loomgraph.sources import tables as T
from loomgraph.sources.genome import parse_gtf, parse_sam


# ---------------------------------------------------------------- text formats
def _sam_lines(spark, folder):
    li = T.table(spark, folder, "lineitem")
    width = T.digits(spark, folder, "l_partkey")[0]
    q, ln, b = F.col("l_quantity").cast("long"), F.col("l_linenumber"), F.col("l_partkey") % 30 + 1
    cigar = F.format_string("%dM%dI%dM%dD%dM", q, ln, b, ln, q)
    md = F.format_string("%dA%d^ACGT%dCT%d", q, b, ln, b)
    line = F.concat_ws(
        "\t",
        F.concat(F.lit("u"), F.col("l_suppkey").cast("string")),
        F.lit("0"),
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 25).cast("string")),
        F.col("l_orderkey").cast("string"),
        F.lit("255"),
        cigar,
        F.lit("*\t0\t0"),
        F.concat(F.repeat(F.lit("A"), q.cast("int") - F.lit(26)), S.base4_encode("l_partkey", width)),
        F.lit("*"),
        F.concat(F.lit("nM:i:"), (ln * 9).cast("string")),
        F.concat(F.lit("AS:i:"), q.cast("string")),
        F.concat(F.lit("MD:Z:"), md),
    )
    return li.select(line.alias("value"))


SAM = f"""sam AS (SELECT 'u' || CAST(l_suppkey AS VARCHAR) AS query, 'chr' || CAST(l_suppkey % 25 AS VARCHAR) AS contig, l_orderkey AS start, q AS score,
  printf('%dM%dI%dM%dD%dM', q, ln, b, ln, q) AS cigar, 2 * q + b AS matched, ln * 9 AS mism, 2 * q + b + ln AS ref_len,
  printf('%dA%d^ACGT%dCT%d', q, b, ln, b) AS md, q, b, ln,
  CASE WHEN q > 26 THEN repeat('A', CAST(q - 26 AS INT)) ELSE '' END || {T.b4_sql('l_partkey', 8)} AS seq
  FROM (SELECT *, CAST(floor(l_quantity) AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS ln, l_partkey % 30 + 1 AS b FROM lineitem)),
ok AS (SELECT *, CASE WHEN matched > 0 THEN 1 - CAST(mism AS DOUBLE) / matched ELSE 0 END AS share FROM sam
  WHERE 1 - CAST(mism AS DOUBLE) / matched > 0
  AND NOT regexp_matches(seq, 'A{{21}}|C{{21}}|G{{21}}|T{{21}}'))"""


@query("sam_scan", f"WITH {SAM} SELECT query, contig, start, score, cigar, md, round(share, 9) AS match_fraction FROM ok", ("SRC6", "PRJ13"))
def sam_scan(spark, folder):
    return parse_sam(_sam_lines(spark, folder)).withColumn("match_fraction", F.round("match_fraction", 9))


@query("alignment_mutations", f"""WITH {SAM} SELECT query, start, ref_len AS aln_len,
  concat_ws('+', printf('%d~%d~%d>A', start + q, start, ref_len), printf('%d~%d~%d>C', start + q + 1 + b + 4 + ln, start, ref_len),
  printf('%d~%d~%d>T', start + q + 1 + b + 4 + ln + 1, start, ref_len)) AS mutation FROM ok""", ("PRJ14", "PRJ15"))
def alignment_mutations(spark, folder):
    a = parse_sam(_sam_lines(spark, folder))
    return a.select("query", "start", S.cigar_length("cigar").alias("aln_len"), S.md_mismatches("cigar", "md", "start").alias("mutation"))


@query("best_alignments", f"""WITH {SAM}, r AS (SELECT *, rank() OVER (PARTITION BY query ORDER BY share DESC) AS rk FROM ok)
SELECT query, contig, start, score, round(share, 9) AS match_fraction FROM r WHERE rk = 1""", ("WIN6",))
def best_alignments(spark, folder):
    return A.best_alignments(parse_sam(_sam_lines(spark, folder))).select("query", "contig", "start", "score", F.round("match_fraction", 9).alias("match_fraction"))


def _gtf_lines(spark, folder):
    o = T.table(spark, folder, "orders")
    k = F.col("o_orderkey")
    attrs = F.concat(
        F.format_string('gene_id "G%d"; gene_name "N%d";', k, F.col("o_custkey")),
        F.when(F.col("o_orderstatus") == "F", F.lit(' gene_biotype "rRNA";')).when(F.col("o_orderstatus") == "O", F.lit(' gene_biotype "protein_coding";')).otherwise(F.lit("")),
        F.when(k % 2 == 0, F.format_string(' transcript_id "T%d"; transcript_name "TN%d";', k, k)).otherwise(F.lit("")),
    )
    start, span = k * 13 % 100000, F.floor(F.col("o_totalprice") / 4)
    line = F.concat_ws("\t", F.lit("chr1"), F.lit("src"), F.lit("exon"), (start + span).cast("string"), start.cast("string"), F.lit(".\t+\t."), attrs)
    return o.select(line.alias("value"))


@query("gtf_scan", """SELECT 'chr1' AS contig, 'exon' AS feature, o_orderkey * 13 % 100000 AS lo,
  o_orderkey * 13 % 100000 + CAST(floor(o_totalprice / 4) AS BIGINT) AS hi, 'N' || CAST(o_custkey AS VARCHAR) AS gene,
  CASE o_orderstatus WHEN 'F' THEN 'rRNA' WHEN 'O' THEN 'protein_coding' END AS biotype,
  CASE WHEN o_orderkey % 2 = 0 THEN 'T' ELSE 'G' END || CAST(o_orderkey AS VARCHAR) AS gene_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'TN' || CAST(o_orderkey AS VARCHAR) END AS tx, CAST(NULL AS VARCHAR) AS tx_biotype
FROM orders WHERE floor(o_totalprice / 4) <= 100000""", ("SRC7",))
def gtf_scan(spark, folder):
    return parse_gtf(_gtf_lines(spark, folder))


# ---------------------------------------------------------------- annotation
@query("interval_annotation", f"""WITH {T.ALIGN}, {T.FEATURES}, f AS (SELECT * FROM features WHERE hi - lo <= 100000),
hits AS (SELECT a.query, string_agg(DISTINCT f.gene, '|' ORDER BY f.gene) AS gene, count(f.rec) AS n_features
  FROM align a JOIN f ON a.contig = f.contig AND a.start >= f.lo AND a.start < f.hi GROUP BY 1)
SELECT a.query, a.contig, a.start, coalesce(h.gene, 'NA') AS gene, coalesce(h.n_features, 0) AS n_features, CASE WHEN h.query IS NULL THEN 4 ELSE 3 END AS attention
FROM align a LEFT JOIN hits h ON h.query = a.query""", ("JN8", "AGG17", "PRJ20"))
def interval_annotation(spark, folder):
    feats = T.features(spark, folder).where("hi - lo <= 100000").withColumn("biotype", F.lit("NONE"))
    out = A.annotate(T.alignments(spark, folder).select("query", "contig", "start"), feats)
    return out.select("query", "contig", "start", "gene", "n_features", "attention")


def _near_stats(spark, folder):
    a = T.alignments(spark, folder)
    rows = a.select("umi", "contig", F.concat_ws(".", "event_type", F.floor(F.col("start") / 60).cast("string")).alias("fqn"),
                    F.floor(F.col("start") / 60).alias("start"), F.floor("score").alias("reads"), F.round("score", 2).alias("score"))
    return rows


NEAR = """rows0 AS (SELECT umi, contig, event_type || '.' || CAST(start // 60 AS VARCHAR) AS fqn, start // 60 AS start,
  CAST(floor(score) AS BIGINT) AS reads, round(score, 2) AS score FROM align),
stats AS MATERIALIZED (SELECT umi, contig, fqn, min(start) AS start, max(reads) AS reads, avg(score) AS score FROM rows0 GROUP BY ALL),
anchors(umi, contig, a) AS (SELECT umi, contig, min(start) FROM stats GROUP BY ALL
  UNION ALL SELECT s.umi, s.contig, min(s.start) FROM anchors x JOIN stats s ON s.umi = x.umi AND s.contig = x.contig AND s.start > x.a + 10 GROUP BY s.umi, s.contig, x.a),
placed AS (SELECT s.*, x.a FROM stats s JOIN anchors x ON s.umi = x.umi AND s.contig = x.contig AND s.start BETWEEN x.a AND x.a + 10),
best AS (SELECT *, row_number() OVER (PARTITION BY umi, contig, a ORDER BY reads DESC, score DESC, start, fqn) AS rn, count(*) OVER (PARTITION BY umi, contig, a) AS n FROM placed)"""


@query("near_duplicate_stats", f"""WITH RECURSIVE {T.ALIGN}, {NEAR}
SELECT umi, contig, fqn, start, reads, round(score, 6) AS score FROM stats""", ("AGG18",))
def near_duplicate_stats(spark, folder):
    return A.duplicate_stats(_near_stats(spark, folder)).withColumn("score", F.round("score", 6))


@query("near_duplicates", f"""WITH RECURSIVE {T.ALIGN}, {NEAR}
SELECT umi, contig, a AS anchor, fqn, n AS n_members FROM best WHERE rn = 1""", ("WIN7",))
def near_duplicates(spark, folder):
    return A.near_duplicates(A.duplicate_stats(_near_stats(spark, folder)))


@query("surviving_rows", f"""WITH RECURSIVE {T.ALIGN}, {NEAR}
SELECT umi, fqn, contig, start, reads FROM rows0 r WHERE EXISTS (SELECT 1 FROM best b WHERE rn = 1 AND b.umi = r.umi AND b.fqn = r.fqn)""", ("JN9",))
def surviving_rows(spark, folder):
    rows = _near_stats(spark, folder)
    return A.keep_survivors(rows, A.near_duplicates(A.duplicate_stats(rows))).select("umi", "fqn", "contig", "start", "reads")


@query("gene_support_thresholds", f"""WITH {T.ASSIGN}, r AS (SELECT umi, fqn, bool_or(biotype = 'PROMO') AS rr, list(DISTINCT gene) AS genes FROM assign GROUP BY ALL),
g AS (SELECT CASE WHEN rr THEN ['rRNA'] ELSE genes END AS genes FROM r),
w AS (SELECT unnest(genes) AS gene, 1.0 / len(genes) AS w FROM g), s AS (SELECT gene, round(sum(w), 6) AS weight FROM w GROUP BY 1)
SELECT count(*) FILTER (weight >= 1) AS at_least_1, count(*) FILTER (weight >= 5) AS at_least_5, count(*) FILTER (weight >= 10) AS at_least_10 FROM s""", ("AGG16", "PRJ16"))
def gene_support_thresholds(spark, folder):
    rows = T.assignments(spark, folder).withColumn("biotype", F.when(F.col("biotype") == "PROMO", "rRNA").otherwise(F.col("biotype")))
    sets = A.merge_columns(rows, ["umi", "fqn"], ["gene", "biotype"])
    return A.support_thresholds(A.gene_support(sets).withColumn("weight", F.round("weight", 6)))


@query("merged_annotation", f"""WITH {T.ASSIGN} SELECT umi, fqn, string_agg(DISTINCT contig, '|' ORDER BY contig) AS contig,
  string_agg(DISTINCT gene, '|' ORDER BY gene) AS gene, string_agg(DISTINCT biotype, '|' ORDER BY biotype) AS biotype FROM assign GROUP BY ALL""", ("AGG19",))
def merged_annotation(spark, folder):
    return A.merge_columns(T.assignments(spark, folder), ["umi", "fqn"], ["contig", "gene", "biotype"])


@query("placeholder_features", """SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') AND p_size > 25 THEN '__genome__:' || p_type
  WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'n/a' ELSE p_brand END AS feature,
  CASE WHEN p_size > 25 THEN 'genome' ELSE p_type END AS bt, p_brand IN ('Brand#1', 'Brand#2') AS missing, regexp_matches(p_name, '^[ACGTNacgtn;|]+$') AS dna FROM part""", ("PRJ17", "PRJ18", "PRJ19"))
def placeholder_features(spark, folder):
    p = T.table(spark, folder, "part")
    rows = p.select(
        "p_partkey", "p_name", F.col("p_type").alias("contig"),
        F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), " n/a ").otherwise(F.col("p_brand")).alias("gene"),
        F.when(F.col("p_size") > 25, F.lit("genome")).otherwise(F.col("p_type")).alias("biotype"),
    )
    feat, bt = M.feature_name()
    return rows.select("p_partkey", feat.alias("feature"), bt.alias("bt"), S.is_placeholder("gene").alias("missing"), S.looks_like_dna("p_name").alias("dna"))


# ---------------------------------------------------------------- matrices
CALLS = """calls AS (SELECT umi, fqn, gene AS feature, min(biotype) AS biotype, max(sub_reads) AS sub_reads FROM assign GROUP BY ALL),
single AS (SELECT umi, fqn, min(feature) AS feature, min(biotype) AS biotype, min(sub_reads) AS sub_reads FROM calls GROUP BY ALL HAVING count(*) = 1)"""


def _calls(spark, folder, keep=False):
    return M.feature_calls(T.assignments(spark, folder), keep)


@query("node_feature_matrix", f"WITH {T.ASSIGN}, {CALLS} SELECT umi, feature, CAST(sum(sub_reads) AS BIGINT) AS n FROM single GROUP BY ALL", ("AGG22", "AGG23", "JN18", "T25"))
def node_feature_matrix(spark, folder):
    return M.count_matrix(_calls(spark, folder))


@query("node_feature_matrix_all", f"WITH {T.ASSIGN}, {CALLS} SELECT umi, feature, CAST(sum(sub_reads) AS BIGINT) AS n FROM calls GROUP BY ALL", ("AGG22",))
def node_feature_matrix_all(spark, folder):
    return M.count_matrix(_calls(spark, folder, True))


@query("feature_biotype", f"""WITH {T.ASSIGN}, {CALLS}, b AS (SELECT feature, biotype, CAST(sum(sub_reads) AS BIGINT) AS reads FROM single GROUP BY ALL)
SELECT feature, biotype, reads FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY reads DESC, biotype DESC) AS rn FROM b) WHERE rn = 1""", ("AGG22",))
def feature_biotype(spark, folder):
    return M.feature_biotypes(_calls(spark, folder))


@query("node_summary", f"""WITH {T.ASSIGN}, {CALLS}, s AS (SELECT umi, fqn, max(sub_reads) AS r FROM assign GROUP BY ALL)
SELECT umi, n_subclusters, total_sub_reads, coalesce(n_annotated, 0) AS n_annotated FROM (SELECT umi, count(*) AS n_subclusters, CAST(sum(r) AS BIGINT) AS total_sub_reads FROM s GROUP BY 1)
LEFT JOIN (SELECT umi, count(DISTINCT feature) AS n_annotated FROM single GROUP BY 1) USING (umi)""", ("AGG22", "SNK7"))
def node_summary(spark, folder):
    return M.node_summary(T.assignments(spark, folder), _calls(spark, folder))


@query("approx_distinct_features", None, ("AGG24", "AGG25"))
def approx_distinct_features(spark, folder):
    r = T.assignments(spark, folder)
    return r.agg(F.approx_count_distinct("fqn", 0.01).alias("n_fqn"), F.approx_count_distinct("gene", 0.01).alias("n_gene"), F.count(F.lit(1)).alias("entries"))


@query("matched_libraries", f"""WITH {T.INSERTS}, s AS (SELECT umi, substr(insert_seq, 1, 10) AS kmer, count(*) AS n_reads FROM inserts WHERE length(insert_seq) > 0 GROUP BY ALL),
c AS (SELECT DISTINCT l_suppkey AS umi, l_partkey AS seq FROM lineitem), w AS (SELECT umi, p_size AS uei_clust, count(*) AS n_shared FROM c JOIN part ON seq = p_partkey GROUP BY ALL)
SELECT umi, kmer, uei_clust, n_shared, n_reads * n_shared AS n_reads FROM s JOIN w USING (umi)""", ("JN10", "JN11", "JN12"))
def matched_libraries(spark, folder):
    """Sub-consensuses on the clusters of another library with the same barcodes."""
    from loomgraph.plans.library import match_libraries

    cdna = T.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("seq"), F.col("l_suppkey").alias("clust")).distinct()
    uei = T.table(spark, folder, "part").select(F.col("p_partkey").alias("seq"), F.col("p_size").alias("clust"))
    subs = T.inserts(spark, folder).where(F.length("insert_seq") > 0).groupBy("umi", F.substring("insert_seq", 1, 10).alias("kmer")).agg(F.count(F.lit(1)).alias("n_reads"))
    return match_libraries(cdna, uei, subs).select("umi", "kmer", "uei_clust", "n_shared", "n_reads")


@query("quick_labels", """WITH m AS (SELECT l_suppkey AS umi, min(p_partkey % 100) AS match FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 3 GROUP BY 1)
SELECT s_suppkey AS umi, s_nationkey AS n_reads, coalesce(match, -1) AS match FROM supplier LEFT JOIN m ON umi = s_suppkey""", ("T15",))
def quick_labels(spark, folder):
    from loomgraph.plans.library import quick_labels as ql

    members = T.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("umi"), F.col("l_partkey").alias("seq"))
    known = T.table(spark, folder, "part").where("p_size < 3").select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 100).alias("index"))
    totals = T.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("umi"), F.col("s_nationkey").alias("n_reads"))
    return ql(totals, members, known)


@query("coordinate_lines", f"WITH {T.points_sql(2)} SELECT CAST(node_id AS VARCHAR) || ',' || printf('%.10e', x0) || ',' || printf('%.10e', x1) AS value FROM points", ("SNK6",))
def coordinate_lines(spark, folder):
    from loomgraph.sources.exports import coordinate_lines as cl

    return cl(T.points(spark, folder, 2), ("x0", "x1"))


@query("attached_labels", """SELECT s_suppkey AS node_id, s_nationkey AS a, CASE WHEN s_acctbal > 0 THEN 1 END AS b FROM supplier""", ("SNK7", "SNK8", "T24"))
def attached_labels(spark, folder):
    from loomgraph.sources.exports import attach_labels

    s = T.table(spark, folder, "supplier").withColumnRenamed("s_suppkey", "node_id")
    rows = s.select("node_id", F.lit("a").alias("method"), F.col("s_nationkey").alias("label")).unionByName(s.where("s_acctbal > 0").select("node_id", F.lit("b").alias("method"), F.lit(1).alias("label")))
    return attach_labels(s.select("node_id"), rows, ["a", "b"])


# ---------------------------------------------------------------- hubs and cells
@query("log_normalised_counts", f"""WITH {T.HUB}, t AS (SELECT hub, sum(n) AS t FROM hub_counts GROUP BY 1)
SELECT hub, gene, round(ln(1 + n * 10000.0 / t), 6) AS value FROM hub_counts JOIN t USING (hub)""", ("PRJ28",))
def log_normalised_counts(spark, folder):
    return M.log_normalise(T.hub_counts(spark, folder), "hub").select("hub", "gene", F.round("value", 6).alias("value"))


@query("binarised_counts", f"WITH {T.HUB} SELECT hub, gene, CAST(1 AS BIGINT) AS n FROM hub_counts WHERE n >= 2", ("PRJ21", "PRJ22"))
def binarised_counts(spark, folder):
    return M.binarise(T.hub_counts(spark, folder), "n", 2)


NAMES = "named AS (SELECT l_suppkey AS node, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS feature, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def _spelled(spark, folder):
    li, p = T.table(spark, folder, "lineitem"), T.table(spark, folder, "part")
    name = F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    j = li.join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("l_suppkey").alias("node"), name.alias("feature")).agg(F.sum(F.col("l_linenumber").cast("long")).alias("n"))


@query("collapsed_names", f"WITH {NAMES} SELECT node, lower(feature) AS feature, CAST(sum(n) AS BIGINT) AS n FROM named GROUP BY ALL", ("AGG34", "AGG35", "PRJ23"))
def collapsed_names(spark, folder):
    return M.collapse_names(_spelled(spark, folder), "node", "feature")


@query("heaviest_spelling", f"""WITH {NAMES}, t AS (SELECT feature, row_number() OVER (PARTITION BY lower(feature) ORDER BY sum(n) DESC, feature) AS rn FROM named GROUP BY feature)
SELECT node, feature, n FROM named WHERE feature IN (SELECT feature FROM t WHERE rn = 1)""", ("AGG35", "AGG36"))
def heaviest_spelling(spark, folder):
    return M.heaviest_spelling(_spelled(spark, folder), "feature").select("node", "feature", "n")


@query("shared_genes", f"""WITH {T.HUB}, r AS (SELECT 'g' || CAST(p_size AS VARCHAR) AS gene, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1 HAVING sum(p_size) >= 500)
SELECT gene, total FROM r WHERE gene IN (SELECT gene FROM hub_counts)""", ("JN23", "SET5"))
def shared_genes(spark, folder):
    right = T.table(spark, folder, "part").select(F.concat(F.lit("G"), F.col("p_size").cast("string")).alias("gene"), F.col("p_size").cast("long").alias("n"))
    return M.shared_features(T.hub_counts(spark, folder), right, "gene", "n", 500)


@query("rrna_pseudo_features", f"""WITH {T.HUB}, k AS (SELECT *, CASE CAST(substr(gene, 2) AS INT) % 10 WHEN 1 THEN 'rRNA_sum' WHEN 2 THEN 'Mt_rRNA_sum' END AS pseudo FROM hub_counts)
SELECT hub, gene, n FROM k WHERE pseudo IS NULL UNION ALL SELECT DISTINCT hub, pseudo, CAST(1 AS BIGINT) FROM k WHERE pseudo IS NOT NULL""", ("AGG33",))
def rrna_pseudo_features(spark, folder):
    x = T.hub_counts(spark, folder)
    digit = F.substring("gene", 2, 9).cast("int") % 10
    kinds = x.select("gene").distinct().withColumn("biotype", F.when(digit == 1, "rRNA").when(digit == 2, "Mt rRNA").otherwise("protein coding"))
    return M.rrna_features(x, kinds, "hub", "gene")


@query("qc_gates", f"""WITH {T.HUB}, c AS (SELECT hub FROM hub_counts GROUP BY hub HAVING sum(n) >= 150 AND count(*) >= 25),
k AS (SELECT * FROM hub_counts WHERE hub IN (SELECT hub FROM c)), g AS (SELECT gene FROM k GROUP BY 1 HAVING count(*) >= 3)
SELECT hub, gene, n FROM k WHERE gene IN (SELECT gene FROM g)""", ("PRJ24",))
def qc_gates(spark, folder):
    return M.quality_gates(T.hub_counts(spark, folder), "hub", "gene", "n", 150, 25, 3).select("hub", "gene", "n")


@query("qc_gate_report", f"""WITH {T.HUB}, c AS (SELECT CASE WHEN sum(n) < 150 THEN 'fail_min_counts' WHEN count(*) < 25 THEN 'fail_min_genes' ELSE 'pass' END AS reason FROM hub_counts GROUP BY hub)
SELECT reason, count(*) AS n_cells FROM c GROUP BY 1""", ("PRJ24",))
def qc_gate_report(spark, folder):
    return M.gate_report(T.hub_counts(spark, folder), "hub", "n", 150, 25)


@query("gene_moments", f"""WITH {T.HUB}, t AS (SELECT count(DISTINCT hub) AS n FROM hub_counts), s AS (SELECT gene, CAST(sum(n) AS DOUBLE) AS s, CAST(sum(n * n) AS DOUBLE) AS ss, count(*) AS d FROM hub_counts GROUP BY 1)
SELECT gene, round(s / t.n, 6) AS mean, round(greatest(ss / t.n - (s / t.n) * (s / t.n), 0), 6) AS variance, round(d / t.n, 6) AS detection FROM s, t""", ("AGG41",))
def gene_moments(spark, folder):
    x = T.hub_counts(spark, folder)
    rows = x.agg(F.countDistinct("hub").alias("n_rows"))
    m = M.feature_moments(x, rows, "gene", "n")
    return m.select("gene", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), F.round("detection", 6).alias("detection"))


CELLS = "cells AS (SELECT c_custkey AS hub, c_nationkey * 10 + length(c_mktsegment) AS cell FROM customer)"


def _cells(spark, folder):
    return T.table(spark, folder, "customer").select(F.col("c_custkey").alias("hub"), (F.col("c_nationkey") * 10 + F.length("c_mktsegment")).alias("cell"))


@query("hub_to_cell", f"WITH {T.HUB}, {CELLS} SELECT cell, gene, count(*) AS n_hubs FROM hub_counts JOIN cells USING (hub) WHERE n >= 3 GROUP BY ALL", ("AGG31",))
def hub_to_cell(spark, folder):
    return M.hub_to_cell(T.hub_counts(spark, folder), _cells(spark, folder), least=3)


@query("cell_summary", f"""WITH {T.HUB}, {CELLS}, p AS (SELECT hub, count(*) AS genes FROM hub_counts WHERE n >= 20 GROUP BY 1)
SELECT cell, n_hubs, n_hubs_with_call, n_multigene_hubs, coalesce(n_genes, 0) AS n_genes FROM (
  SELECT cell, count(*) AS n_hubs, count(genes) AS n_hubs_with_call, count(*) FILTER (genes > 1) AS n_multigene_hubs FROM cells LEFT JOIN p USING (hub) GROUP BY 1)
LEFT JOIN (SELECT cell, count(DISTINCT gene) AS n_genes FROM hub_counts JOIN cells USING (hub) WHERE n >= 20 GROUP BY 1) USING (cell)""", ("AGG31", "AGG51"))
def cell_summary(spark, folder):
    return M.cell_summary(T.hub_counts(spark, folder), _cells(spark, folder), least=20)


CLUST = "clusters AS (SELECT c_custkey AS hub, c_mktsegment AS cluster FROM customer WHERE c_custkey IN (SELECT hub FROM hub_counts))"
MARK = """x AS (SELECT cluster, gene, n FROM hub_counts JOIN clusters USING (hub)),
ins AS (SELECT cluster, gene, CAST(sum(n) AS DOUBLE) AS s_in, count(*) AS d_in FROM x GROUP BY ALL),
alls AS (SELECT gene, sum(s_in) AS s_all, sum(d_in) AS d_all FROM ins GROUP BY 1), lib AS (SELECT cluster, sum(s_in) AS lib_in FROM ins GROUP BY 1),
siz AS (SELECT cluster, count(*) AS c_in FROM clusters GROUP BY 1), tot AS (SELECT sum(lib_in) AS lib_all FROM lib), ct AS (SELECT sum(c_in) AS c_all FROM siz), ng AS (SELECT count(*) AS k FROM alls),
mark AS (SELECT cluster, gene, log2(((s_in + 0.5) / (lib_in + 0.5 * k) * 1e6) / ((s_all - s_in + 0.5) / (lib_all - lib_in + 0.5 * k) * 1e6)) AS log2fc,
  CAST(d_in AS DOUBLE) / c_in AS pct_in, CAST(d_all - d_in AS DOUBLE) / (c_all - c_in) AS pct_out
  FROM ins JOIN alls USING (gene) JOIN lib USING (cluster) JOIN siz USING (cluster), tot, ct, ng)"""


def _markers(spark, folder):
    x = T.hub_counts(spark, folder)
    cl = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("hub"), F.col("c_mktsegment").alias("cluster")).join(x.select("hub").distinct(), "hub", "left_semi")
    return M.cluster_markers(x, cl, "hub", "gene")


@query("cluster_markers", f"WITH {T.HUB}, {CLUST}, {MARK} SELECT cluster, gene, round(log2fc, 6) AS log2fc, round(pct_in, 6) AS pct_in, round(pct_out, 6) AS pct_out FROM mark", ("AGG40", "PRJ37"))
def cluster_markers(spark, folder):
    return _markers(spark, folder).select("cluster", "gene", *[F.round(c, 6).alias(c) for c in ("log2fc", "pct_in", "pct_out")])


@query("marker_select", f"""WITH {T.HUB}, {CLUST}, {MARK}, r AS (SELECT cluster, gene, round(log2fc, 6) AS log2fc, round(pct_in, 6) AS pct_in, round(greatest(log2fc, 0) * sqrt(pct_in + 1e-6), 6) AS score FROM mark),
t AS (SELECT *, CASE WHEN log2fc >= 0.2 AND pct_in >= 0.6 THEN 0 WHEN log2fc >= 0.1 THEN 1 ELSE 2 END AS tier FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, log2fc DESC, pct_in DESC, gene) AS rn FROM t x WHERE tier <= (SELECT min(tier) FROM t y WHERE y.cluster = x.cluster)),
o AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY score DESC, log2fc DESC, pct_in DESC, cluster) AS g FROM k WHERE rn <= 12)
SELECT gene, cluster, score, log2fc, pct_in FROM o WHERE g = 1 ORDER BY score DESC, log2fc DESC, pct_in DESC, gene LIMIT 160""", ("WIN19", "PRJ37"))
def marker_select(spark, folder):
    m = _markers(spark, folder)
    m = m.withColumn("score", F.round(M.marker_score(F.col("log2fc"), None, F.col("pct_in")), 6))
    m = m.withColumn("log2fc", F.round("log2fc", 6)).withColumn("pct_in", F.round("pct_in", 6))
    return M.select_markers(m, (F.col("log2fc") >= 0.2) & (F.col("pct_in") >= 0.6), F.col("log2fc") >= 0.1)


@query("marker_zscore", f"""WITH {T.HUB}, {CLUST}, {MARK}, s AS (SELECT gene, avg(log2fc) AS m, stddev_pop(log2fc) AS s FROM mark GROUP BY 1)
SELECT cluster, gene, round(greatest(least(CASE WHEN s > 1e-9 THEN (log2fc - m) / s ELSE 0 END, 2.5), -2.5), 6) AS z FROM mark JOIN s USING (gene)""", ("WIN20",))
def marker_zscore(spark, folder):
    return M.row_zscore(_markers(spark, folder), "gene", "log2fc").select("cluster", "gene", F.round("z", 6).alias("z"))


MOD_A, MOD_B = ("g1", "g2", "g3", "g4", "g5"), ("g10", "g11", "g12")


def _jac_sql(a, b):
    within = a is b
    la, lb = ("(" + ", ".join(f"'{g}'" for g in m) + ")" for m in (a, b))
    return f"""WITH {T.HUB}, s AS (SELECT gene, count(*) AS k FROM hub_counts WHERE n >= 10 GROUP BY 1),
i AS (SELECT p.gene AS a, q.gene AS b, count(*) AS c FROM hub_counts p JOIN hub_counts q USING (hub) WHERE p.n >= 10 AND q.n >= 10 AND p.gene IN {la} AND q.gene IN {lb} GROUP BY ALL)
SELECT sa.gene AS a, sb.gene AS b, coalesce(c, 0) AS "both", round(coalesce(c, 0) / CAST(sa.k + sb.k - coalesce(c, 0) AS DOUBLE), 6) AS jaccard
FROM s sa JOIN s sb ON sa.gene IN {la} AND sb.gene IN {lb} {'AND sa.gene < sb.gene' if within else ''} LEFT JOIN i ON i.a = sa.gene AND i.b = sb.gene"""


@query("jaccard_within", _jac_sql(MOD_A, MOD_A), ("AGG43", "ST13"))
def jaccard_within(spark, folder):
    j = M.jaccard_pairs(M.binarise(T.hub_counts(spark, folder), "n", 10), "hub", "gene", MOD_A)
    return j.withColumn("jaccard", F.round("jaccard", 6))


@query("jaccard_cross", _jac_sql(MOD_A, MOD_B), ("AGG44", "ST13"))
def jaccard_cross(spark, folder):
    j = M.jaccard_pairs(M.binarise(T.hub_counts(spark, folder), "n", 10), "hub", "gene", MOD_A, MOD_B)
    return j.withColumn("jaccard", F.round("jaccard", 6))


@query("rarefied_rows", None, ("SRT6", "SRT7"))
def rarefied_rows(spark, folder):
    from loomgraph.operators.reads import rarefy

    r = rarefy(T.hub_counts(spark, folder), "hub", "gene", "n", 50, seed=3)
    return r.groupBy("hub").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_genes"))


@query("rarefaction_status", f"WITH {T.HUB} SELECT hub, CAST(sum(n) AS BIGINT) AS total, sum(n) >= 50 AS eligible FROM hub_counts GROUP BY 1", ("SRT7",))
def rarefaction_status(spark, folder):
    t = T.hub_counts(spark, folder).groupBy("hub").agg(F.sum("n").alias("total"))
    return t.withColumn("eligible", F.col("total") >= 50)
