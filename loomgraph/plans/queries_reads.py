"""Catalog: sequence functions, read patterns, barcode clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.core.catalog import query
from loomgraph.functions import seq as S
from loomgraph.operators import barcodes as B
from loomgraph.operators import reads as R
from loomgraph.operators.seqform import parse_form, parse_stack
from loomgraph.sources import tables as T

RC = T.revcomp_sql


def _stack(spark, folder, col):
    return T.reads(spark, folder).select("read_id", F.col(col).alias("seq"))


@query("uniq_seq_counts", f"""WITH {T.READS}
SELECT umi1_seq AS seq, row_number() OVER (ORDER BY umi1_seq) - 1 AS seq_idx, count(*) AS n_reads
FROM reads GROUP BY 1""", ("AGG1", "SRT1", "SRT3"))
def uniq_seq_counts(spark, folder):
    return B.unique_sequences(_stack(spark, folder, "umi1_seq"))


@query("revcomp_projection", f"""WITH {T.READS}
SELECT read_id, {RC('umi1_seq')} AS rc, {RC('uei_seq')} AS rc_uei FROM reads""", ("PRJ34",))
def revcomp_projection(spark, folder):
    return T.reads(spark, folder).select("read_id", S.revcomp("umi1_seq").alias("rc"), S.revcomp("uei_seq").alias("rc_uei"))


def _b4_decode_sql(x, width):
    return " + ".join(f"CAST(4 ** {width - 1 - i} AS BIGINT) * (strpos('ACGT', substr({x}, {i + 1}, 1)) - 1)" for i in range(width))


@query("base4_roundtrip", f"""WITH {T.READS}
SELECT DISTINCT uei, uei_seq, CAST({_b4_decode_sql('uei_seq', 10)} AS BIGINT) AS decoded,
       CAST(-1 AS BIGINT) AS bad FROM reads""", ("PRJ32", "PRJ33"))
def base4_roundtrip(spark, folder):
    r = T.reads(spark, folder).select("uei", "uei_seq").distinct()
    return r.withColumn("decoded", S.base4_decode("uei_seq")).withColumn("bad", S.base4_decode(F.concat("uei_seq", F.lit("N"))))


def _frac(x, length):
    parts = ", ".join(f"length({x}) - length(replace({x}, '{b}', ''))" for b in "ACGT")
    return f"round(CAST(greatest({parts}) AS DOUBLE) / {length}, 2)"


@query("max_base_fraction", f"""WITH {T.READS}
SELECT umi1_seq AS seq, {_frac('umi1_seq', 8)} AS max_frac, count(*) AS n_reads FROM reads GROUP BY 1""", ("PRJ8",))
def max_base_fraction(spark, folder):
    g = _stack(spark, folder, "umi1_seq").groupBy("seq").agg(F.count(F.lit(1)).alias("n_reads"))
    return g.select("seq", S.max_base_fraction("seq").alias("max_frac"), "n_reads")


@query("low_complexity_filter", f"""WITH {T.READS}, u AS (
  SELECT umi1_seq AS seq, row_number() OVER (ORDER BY umi1_seq) - 1 AS seq_idx FROM reads GROUP BY 1)
SELECT read_id, CASE WHEN {_frac('umi1_seq', 8)} >= 0.75 THEN -1 ELSE seq_idx END AS clust
FROM reads JOIN u ON umi1_seq = seq""", ("PRJ8", "JN3", "JN4"))
def low_complexity_filter(spark, folder):
    stacked = _stack(spark, folder, "umi1_seq")
    uniq = B.unique_sequences(stacked)
    own = uniq.select("seq_idx", F.col("seq_idx").alias("clust"))
    return B.read_clusters(stacked, uniq, own)


# Forms on synthetic mates: read1 = rev. complement of UMI0 + UEI, read2 = UMI1 + UEI.
def _forms(umi0, umi1, uei):
    """Forward and reverse forms for barcodes of these lengths; fixed letters keep their place from the nearer end."""
    end = umi0 + uei
    forward = (
        f"U_{'N' * (umi0 - 1)}T_{umi0}:0|U_AA{'N' * (uei - 2)}_{umi0}:{end}|A_{end}:",
        f"U_{'N' * umi0}_0:{umi0}|U_A{'N' * (uei - 5)}WSNN_{umi0}:{end}|A_{end}:",
        f"U_{'N' * (umi0 - 1)}G_{umi0}:0|A_{umi0}:",
    )
    reverse = (f"U_A{'N' * (umi1 - 1)}_0:{umi1}|A_{umi1}:", f"U_{'N' * umi1}_{umi1}:0|A_{umi1}:")
    return [parse_form(f) for f in forward], [parse_form(f) for f in reverse]


def _mates(spark, folder):
    r = T.reads(spark, folder)
    return r.select(
        F.col("read_id").alias("read_no"),
        F.concat(S.revcomp("umi0_seq"), F.col("uei_seq"), F.col("umi1_seq")).alias("read1"),
        F.concat(F.col("umi1_seq"), F.col("uei_seq")).alias("read2"),
    )


MATES = f"""mates AS (SELECT read_id, {RC('umi0_seq')} || uei_seq || umi1_seq AS read1, umi1_seq || uei_seq AS read2 FROM reads)"""
# 8:0 reads backwards: pattern letter k sits at position 8-k and is matched by its complement.
CLASSES = f"""classed AS (SELECT *,
  CASE WHEN substr(read1, 1, 1) = 'A' AND substr(read1, 9, 2) = 'AA' THEN 0
       WHEN substr(read1, 9, 1) = 'A' AND substr(read1, 15, 1) IN ('A', 'T') AND substr(read1, 16, 1) IN ('C', 'G') THEN 1
       WHEN substr(read1, 1, 1) = 'C' THEN 2 ELSE -1 END AS for_index,
  CASE WHEN substr(read2, 1, 1) = 'A' THEN 0 ELSE 1 END AS rev_index FROM mates)"""


def _parsed(spark, folder):
    return R.parse_reads(_mates(spark, folder), *_forms(*T.digits(spark, folder, "l_suppkey", "l_partkey", "l_orderkey")))


@query("seqform_classify", f"""WITH {T.READS}, {MATES}, {CLASSES}
SELECT read_id, for_index, rev_index FROM classed""", ("PRJ1", "PRJ2", "PRJ36"))
def seqform_classify(spark, folder):
    return _parsed(spark, folder).select("read_id", "for_index", "rev_index")


EXTRACT = f"""extracted AS (SELECT read_id, for_index, rev_index,
  CASE for_index WHEN 0 THEN {RC('substr(read1, 2, 7)')} WHEN 1 THEN substr(read1, 1, 8) WHEN 2 THEN {RC('substr(read1, 2, 7)')} END AS u0,
  CASE for_index WHEN 0 THEN substr(read1, 11, 8) WHEN 1 THEN substr(read1, 10, 9) END AS u1,
  CASE for_index WHEN 0 THEN substr(read1, 19) WHEN 1 THEN substr(read1, 19) WHEN 2 THEN substr(read1, 9) END AS for_amp,
  CASE rev_index WHEN 0 THEN substr(read2, 2, 7) ELSE {RC('substr(read2, 1, 8)')} END AS r0,
  substr(read2, 9) AS rev_amp FROM classed)"""


@query("uxi_extract", f"""WITH {T.READS}, {MATES}, {CLASSES}, {EXTRACT}
SELECT read_id, concat_ws(',', u0, u1) AS for_uxis, r0 AS rev_uxis, for_amp, rev_amp FROM extracted
WHERE for_index >= 0 AND rev_index >= 0""", ("PRJ3", "PRJ4", "PRJ5"))
def uxi_extract(spark, folder):
    p = R.accepted(_parsed(spark, folder))
    return p.select("read_id", F.array_join("for_uxis", ",").alias("for_uxis"), F.array_join("rev_uxis", ",").alias("rev_uxis"), "for_amp", "rev_amp")


@query("readcounts_by_form", f"""WITH {T.READS}, {MATES}, {CLASSES}
SELECT CASE WHEN for_index < 0 THEN -1 ELSE for_index END AS for_index,
       CASE WHEN for_index < 0 THEN -1 ELSE rev_index END AS rev_index, count(*) AS n FROM classed GROUP BY 1, 2""", ("AGG2", "SNK1"))
def readcounts_by_form(spark, folder):
    return R.form_counts(_parsed(spark, folder))


@query("stacked_uxis", f"""WITH {T.READS}, {MATES}, {CLASSES}, {EXTRACT}
SELECT read_id, 0 AS k, for_index, rev_index, {RC('u0')} AS seq FROM extracted WHERE for_index = 0
UNION ALL SELECT read_id, 0, for_index, rev_index, u0 FROM extracted WHERE for_index > 0
UNION ALL SELECT read_id, 1, for_index, rev_index, u1 FROM extracted WHERE for_index IN (0, 1)
UNION ALL SELECT read_id, 2, for_index, rev_index, r0 FROM extracted WHERE for_index IN (0, 1) AND rev_index = 1
UNION ALL SELECT read_id, 2, for_index, rev_index, r0 FROM extracted WHERE for_index = 2 AND rev_index = 0""", ("PRJ6", "SET1", "SRT2"))
def stacked_uxis(spark, folder):
    stacks = {
        0: parse_stack("0,*,0:revcomp+1,*,0+2,*,0"),
        1: parse_stack("0,*,1+1,*,1"),
        2: parse_stack("0,1,2+1,1,2+2,0,1"),
    }
    return R.restack(_parsed(spark, folder), stacks)


@query("uxi_length_report", f"""WITH {T.READS}
SELECT 0 AS k, min(length(umi0_seq)) AS min_len, max(length(umi0_seq)) AS max_len FROM reads
UNION ALL SELECT 1, min(length(umi1_seq)), max(length(umi1_seq)) FROM reads
UNION ALL SELECT 2, min(length(uei_seq)), max(length(uei_seq)) FROM reads""", ("PRJ7",))
def uxi_length_report(spark, folder):
    r = T.reads(spark, folder)
    stack = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("seq")) for k, c in enumerate(("umi0_seq", "umi1_seq", "uei_seq"))])
    return R.length_report(r.select("read_id", F.inline(stack)))


def _raw(spark, folder):
    """Raw mates with Phred+33 qualities that depend on the row's values."""
    o = T.table(spark, folder, "orders")
    no, cust = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.lit("r"), no.cast("string"))
    q1 = F.concat(F.repeat(F.chr(cust % 25 + 53), F.lit(3)), F.chr(no % 30 + 43))
    q2 = F.repeat(F.chr(no % 30 + 48), F.lit(8))
    m1 = o.select(F.lit(1).alias("mate"), no.alias("read_no"), name.alias("name"), S.base4_encode(cust, 20).alias("seq"), q1.alias("qual"))
    m2 = o.select(F.lit(2).alias("mate"), no.alias("read_no"), name.alias("name"), S.base4_encode(no, 20).alias("seq"), q2.alias("qual"))
    return m1.unionByName(m2)


RAW = f"""raw AS (SELECT o_orderkey AS read_no, 'r' || CAST(o_orderkey AS VARCHAR) AS name,
  {T.b4_sql('o_custkey', 20)} AS read1, {T.b4_sql('o_orderkey', 20)} AS read2,
  (3 * (o_custkey % 25 + 20) + o_orderkey % 30 + 10) / 4.0 AS q1, o_orderkey % 30 + 15 AS q2 FROM orders)"""


@query("mate_join", f"""WITH {RAW} SELECT read_no, name, read1, read2 FROM raw WHERE q1 >= 30 AND q2 >= 30""", ("SRC1", "JN1", "PRJ35"))
def mate_join(spark, folder):
    return R.join_mates(_raw(spark, folder), 30.0)


@query("single_end_reads", f"""WITH {RAW} SELECT read_no, name, read1, '' AS read2 FROM raw WHERE q1 >= 30""", ("SRC2",))
def single_end_reads(spark, folder):
    return R.single_end(_raw(spark, folder).where("mate = 1"), 30.0)


# ------------------------------------------------------------- clustering
UNIQ = """uniq AS (SELECT umi1_seq AS seq, row_number() OVER (ORDER BY umi1_seq) - 1 AS seq_idx, count(*) AS n_reads FROM reads GROUP BY 1)"""
MEMBERS = """keyed AS (SELECT pos, substr(seq, 1, pos - 1) || substr(seq, pos + 1) AS rest, seq_idx, n_reads
  FROM (SELECT *, unnest(range(1, 9)) AS pos FROM uniq)),
members AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY pos, rest) AS n_members,
  (pos - 1) * (SELECT count(*) FROM uniq) + dense_rank() OVER (PARTITION BY pos ORDER BY rest) - 1 AS eq_grp FROM keyed) WHERE n_members > 1),
below AS (SELECT *, coalesce(sum(n_reads) OVER (PARTITION BY pos, rest ORDER BY n_reads, CAST(seq_idx AS VARCHAR) || ','
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cumul_reads FROM members),
scores AS (SELECT seq_idx, CAST(max(n_reads) + sum(cumul_reads) AS BIGINT) AS rnd FROM below GROUP BY 1)"""


def _uniq(spark, folder):
    return B.unique_sequences(_stack(spark, folder, "umi1_seq"))


def _length(spark, folder):
    return T.digits(spark, folder, "l_partkey")[0]


@query("mismatch_groups", f"""WITH {T.READS}, {UNIQ}, {MEMBERS}
SELECT pos, rest, CAST(eq_grp AS BIGINT) AS eq_grp, seq_idx, n_reads, CAST(cumul_reads AS BIGINT) AS cumul_reads FROM below""", ("GR1", "WIN1", "SET2"))
def mismatch_groups(spark, folder):
    u, length = _uniq(spark, folder), _length(spark, folder)
    m = B.number_groups(u, B.mismatch_members(u, length), length)
    return B.reads_below(m, ["pos", "rest"]).select("pos", "rest", "eq_grp", "seq_idx", "n_reads", "cumul_reads")


@query("rnd_scores", f"""WITH {T.READS}, {UNIQ}, {MEMBERS} SELECT seq_idx, rnd FROM scores""", ("AGG3", "JN2"))
def rnd_scores(spark, folder):
    return B.rnd_scores(B.mismatch_members(_uniq(spark, folder), _length(spark, folder)), ["pos", "rest"])


@query("directional_clusters", f"""WITH RECURSIVE {T.READS}, {UNIQ}, {MEMBERS},
pairs AS MATERIALIZED (SELECT CAST(a.eq_grp AS VARCHAR) AS g, a.seq_idx AS up, b.seq_idx AS lo, sa.rnd AS up_rnd
  FROM members a JOIN members b ON a.pos = b.pos AND a.rest = b.rest
  JOIN scores sa ON sa.seq_idx = a.seq_idx JOIN scores sb ON sb.seq_idx = b.seq_idx
  WHERE sa.rnd > sb.rnd OR (sa.rnd = sb.rnd AND a.seq_idx < b.seq_idx)),
st(it, seq_idx, clust, crnd) AS (
  SELECT 0, seq_idx, seq_idx, rnd FROM scores
  UNION ALL
  SELECT it + 1, seq_idx, CASE WHEN b.crnd > s.crnd THEN b.clust ELSE s.clust END, greatest(s.crnd, coalesce(b.crnd, s.crnd))
  FROM (SELECT it, seq_idx, clust, crnd FROM st) s LEFT JOIN (
    SELECT lo, clust, crnd FROM (SELECT p.lo, t.clust, t.crnd, row_number() OVER (PARTITION BY p.lo ORDER BY t.crnd DESC, p.g, p.up_rnd DESC, p.up) AS rn
      FROM pairs p JOIN st t ON t.seq_idx = p.up) WHERE rn = 1) b ON b.lo = s.seq_idx
  WHERE it < 40)
SELECT u.seq_idx, coalesce(st.clust, u.seq_idx) AS clust FROM uniq u LEFT JOIN st ON st.seq_idx = u.seq_idx AND st.it = 40""", ("GR2", "WIN2", "WIN3"))
def directional_clusters(spark, folder):
    return B.directional_clusters(_uniq(spark, folder), _length(spark, folder))[0]


COMPOSITION = """chars AS (SELECT p AS pos, substr(seq, p + 1, 1) AS base, n_reads FROM (SELECT *, unnest(range(0, 8)) AS p FROM uniq)),
comp AS (SELECT pos, """ + ", ".join(f"CAST(sum(CASE WHEN base = '{b}' THEN n_reads ELSE 0 END) AS BIGINT) AS n_{b.lower()}" for b in "ACGT") + " FROM chars GROUP BY pos)"


@query("base_composition", f"WITH {T.READS}, {UNIQ}, {COMPOSITION} SELECT * FROM comp", ("AGG20",))
def base_composition(spark, folder):
    u = _stack(spark, folder, "umi1_seq").groupBy("seq").agg(F.count(F.lit(1)).alias("n_reads"))
    return B.base_composition(u)


@query("collision_probability", f"""WITH {T.READS}, {UNIQ}, {COMPOSITION}, e AS (
  SELECT pow(CAST(n_a AS DOUBLE) / t, 2) + pow(CAST(n_c AS DOUBLE) / t, 2) + pow(CAST(n_g AS DOUBLE) / t, 2) + pow(CAST(n_t AS DOUBLE) / t, 2) AS e
  FROM (SELECT *, n_a + n_c + n_g + n_t AS t FROM comp))
SELECT round(exp(sum(ln(e))) * (1 + sum((1 - e) / e)), 9) AS p1 FROM e""", ("AGG21",))
def collision_probability(spark, folder):
    u = _stack(spark, folder, "umi1_seq").groupBy("seq").agg(F.count(F.lit(1)).alias("n_reads"))
    return B.collision_probability(B.base_composition(u)).select(F.round("p1", 9).alias("p1"))


@query("subsample_depth", None, ("SRT4", "SRT5", "SRT11"))
def subsample_depth(spark, folder):
    r = T.read_rows(spark, folder).select("read_id", "for_index", "rev_index")
    depths = R.subsample_depths(r.count())
    s = R.subsample(r, "read_id", depths[0], seed=7)
    return s.groupBy("for_index", "rev_index").agg(F.count(F.lit(1)).alias("n"))


@query("text_motifs", """SELECT doc_id, CAST((length(text) - length(replace(text, 'ti', ''))) / 2 AS BIGINT) AS n_ti,
  CAST((length(text) - length(replace(text, 'ana', ''))) / 3 AS BIGINT) AS n_ana FROM documents
WHERE CAST((length(text) - length(replace(text, 'ti', ''))) / 2 AS BIGINT) + CAST((length(text) - length(replace(text, 'ana', ''))) / 3 AS BIGINT) = 2""", ("PRJ25",))
def text_motifs(spark, folder):
    """Exactly two motif hits over the whole text."""
    d = T.table(spark, folder, "documents")
    c = d.select("doc_id", S.motif_count("text", "ti").alias("n_ti"), S.motif_count("text", "ana").alias("n_ana"))
    return c.where(F.col("n_ti") + F.col("n_ana") == 2)
