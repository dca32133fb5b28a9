"""The given tables, and their projections onto the engine's own schemas.

Each projection has a DataFrame form and, for the comparison, a SQL form with
the same column names.  All of them run over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.seq import base4_digits, base4_encode


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def b4_sql(x: str, width: int) -> str:
    digits = [f"substr('ACGT', CAST(({x} >> {2 * i}) & 3 AS INT) + 1, 1)" for i in reversed(range(width))]
    return f"CASE WHEN {x} BETWEEN 0 AND {4**width - 1} THEN " + " || ".join(digits) + " ELSE error('too large for its numeral') END"


def revcomp_sql(x: str) -> str:
    return f"reverse(translate(regexp_replace({x}, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"


# ---------------------------------------------------------------- reads
# Digits of a barcode numeral; a table with larger keys gets as many as its largest key needs.
DIGITS = {"l_suppkey": 8, "l_partkey": 8, "l_orderkey": 10}


def digits(spark: SparkSession, folder: str, *keys: str) -> list[int]:
    """The length of the numerals of each key column of ``lineitem``: one for all rows, whatever their keys."""
    most = table(spark, folder, "lineitem").agg(*[F.max(k).alias(k) for k in keys]).first()
    return [max(DIGITS[k], base4_digits(most[k] or 0)) for k in keys]


def read_rows(spark: SparkSession, folder: str, *barcodes: Column) -> DataFrame:
    """Parsed reads: one row per read with form indices and the given barcode columns."""
    li = table(spark, folder, "lineitem")
    # barcodes are written once per line, before the line becomes several reads
    lines = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"),
        F.sequence(F.lit(1), F.col("l_linenumber")).alias("reps"),
        F.col("l_orderkey").alias("uei"),
        F.col("l_suppkey").alias("umi0"),
        F.col("l_partkey").alias("umi1"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("for_index"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("rev_index"),
        *barcodes,
    )
    reads_of = lines.withColumn("rep", F.explode("reps")).drop("reps")
    return reads_of.withColumn("read_id", F.col("line_id") * 10 + F.col("rep"))


def reads(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed reads with their three barcodes; a barcode has the same length in all rows."""
    umi0, umi1, uei = digits(spark, folder, "l_suppkey", "l_partkey", "l_orderkey")
    return read_rows(
        spark,
        folder,
        base4_encode("l_suppkey", umi0).alias("umi0_seq"),
        base4_encode("l_partkey", umi1).alias("umi1_seq"),
        base4_encode("l_orderkey", uei).alias("uei_seq"),
    )


READS = f"""reads AS (
  SELECT *, line_id * 10 + rep AS read_id FROM (
    SELECT l_orderkey * 10 + l_linenumber AS line_id, unnest(range(1, l_linenumber + 1)) AS rep,
           l_orderkey AS uei, l_suppkey AS umi0, l_partkey AS umi1,
           CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS for_index,
           CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS rev_index,
           {b4_sql('l_suppkey', 8)} AS umi0_seq, {b4_sql('l_partkey', 8)} AS umi1_seq,
           {b4_sql('l_orderkey', 10)} AS uei_seq
    FROM lineitem))"""


# ---------------------------------------------------------------- edges
def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted bipartite molecule graph."""
    li = table(spark, folder, "lineitem")
    return (
        li.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
        .agg(
            F.countDistinct("l_orderkey").alias("n_uei"),
            F.sum(F.col("l_linenumber").cast("long")).alias("n_reads"),
        )
        .withColumn("w", F.col("n_reads").cast("double"))
    )


EDGES = """edges AS (
  SELECT l_suppkey AS src, l_partkey AS dst, count(DISTINCT l_orderkey) AS n_uei,
         CAST(sum(l_linenumber) AS BIGINT) AS n_reads, CAST(sum(l_linenumber) AS DOUBLE) AS w
  FROM lineitem GROUP BY 1, 2)"""


def part_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster labels of the second side, -1 for noise."""
    p = table(spark, folder, "part")
    return p.select(
        F.col("p_partkey").alias("node_id"),
        F.when(F.col("p_size") > 40, -1).otherwise(F.col("p_size") % 5).cast("long").alias("label"),
    )


LABELS = """node_labels AS (
  SELECT p_partkey AS node_id, CAST(CASE WHEN p_size > 40 THEN -1 ELSE p_size % 5 END AS BIGINT) AS label FROM part)"""


# ---------------------------------------------------------------- inserts
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BASES26 = "ACGTACGTACGTACGTACGTACGTAC"


def inserts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole document texts folded onto the base alphabet as insert sequences."""
    d = table(spark, folder, "documents")
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), _LETTERS, _BASES26)
    return d.select((F.col("doc_id") % 40).alias("umi"), F.col("doc_id").alias("read_id"), seq.alias("insert_seq"))


INSERTS = f"""inserts AS (
  SELECT doc_id % 40 AS umi, doc_id AS read_id,
         translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_LETTERS}', '{_BASES26}') AS insert_seq
  FROM documents)"""


# ---------------------------------------------------------------- points
def points(spark: SparkSession, folder: str, dims: int = 2) -> DataFrame:
    e = table(spark, folder, "embeddings")
    xs = [F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(dims)]
    return e.select(F.col("vec_id").alias("node_id"), F.col("label").cast("long").alias("label"), *xs)


def points_sql(dims: int = 2) -> str:
    xs = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(dims))
    return f"points AS (SELECT vec_id AS node_id, CAST(label AS BIGINT) AS label, {xs} FROM embeddings)"


# ---------------------------------------------------------------- hub counts
def hub_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Hub by gene count matrix in long form.

    Lines meet their hub once: what follows per hub or per hub and gene needs no
    further exchange.  Gene numbers become names behind it.
    """
    li, o = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    lines = (
        li.select("l_orderkey", (F.col("l_partkey") % 50).cast("int").alias("part"), "l_linenumber")
        .join(o.select("o_orderkey", F.col("o_custkey").alias("hub")), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("hub", "part", "l_linenumber")
    )
    return (
        lines.repartition("hub")
        .groupBy("hub", "part")
        .agg(F.sum(F.col("l_linenumber").cast("long")).alias("n"))
        .select("hub", F.concat(F.lit("g"), F.col("part").cast("string")).alias("gene"), "n")
    )


HUB = """hub_counts AS (
  SELECT o_custkey AS hub, 'g' || CAST(l_partkey % 50 AS VARCHAR) AS gene, CAST(sum(l_linenumber) AS BIGINT) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


# ---------------------------------------------------------------- assignments
def assignments(spark: SparkSession, folder: str) -> DataFrame:
    """Flat annotation rows: one per alignment of a sub-consensus."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    p = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    s = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    return (
        li.join(p, F.col("l_partkey") == F.col("p_partkey"))
        .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_suppkey").alias("umi"),
            F.col("l_orderkey").alias("fqn"),
            F.concat(F.lit("chr"), F.col("s_nationkey").cast("string")).alias("contig"),
            F.col("p_brand").alias("gene"),
            F.col("p_type").alias("biotype"),
            F.col("l_linenumber").cast("long").alias("sub_reads"),
        )
    )


ASSIGN = """assign AS (
  SELECT l_suppkey AS umi, l_orderkey AS fqn, 'chr' || CAST(s_nationkey AS VARCHAR) AS contig,
         p_brand AS gene, p_type AS biotype, CAST(l_linenumber AS BIGINT) AS sub_reads
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


# ---------------------------------------------------------------- alignments
def alignments(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("query"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("contig"),
        (F.unix_timestamp("ts") - 1704067200).alias("start"),
        F.col("value").alias("score"),
        F.col("user_id").alias("umi"),
        "event_type",
    )


ALIGN = """align AS (
  SELECT event_id AS query, 'c' || CAST(user_id AS VARCHAR) AS contig,
         CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS start, value AS score, user_id AS umi, event_type
  FROM events)"""


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Every event opens a feature of 1 to 30 hours on its contig."""
    a = alignments(spark, folder)
    return a.select(
        F.col("query").alias("rec"),
        "contig",
        F.col("start").alias("lo"),
        (F.col("start") + 3600 * (1 + F.col("query") % 30)).alias("hi"),
        F.col("event_type").alias("gene"),
    )


FEATURES = """features AS (
  SELECT query AS rec, contig, start AS lo, start + 3600 * (1 + query % 30) AS hi, event_type AS gene FROM align)"""
