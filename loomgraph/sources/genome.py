"""SAM and GTF text to typed rows, with Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.seq import cigar_length, longest_homopolymer

# fixed values: filter limits
MAX_HOMOPOLYMER = 20
MAX_FEATURE_SPAN = 100_000


def _tag(line: Column, tag: str) -> Column:
    return F.regexp_extract(line, rf"\t{tag}:([^\t]*)", 1)


def parse_sam(lines: DataFrame, column: str = "value") -> DataFrame:
    """Alignments with their match fraction; header lines are skipped.

    Dropped: runs of one base above the limit in the read, and alignments
    without a positive match fraction (1 - mismatches / aligned bases).
    """
    line = F.col(column)
    f = F.split(line, "\t")
    mismatches = F.coalesce(_tag(line, "nM:i").try_cast("long"), F.lit(0))
    base = lines.where(~line.startswith("@")).select(
        f[0].alias("query"),
        f[2].alias("contig"),
        f[3].cast("long").alias("start"),
        F.coalesce(_tag(line, "AS:i").try_cast("long"), F.lit(0)).alias("score"),
        f[5].alias("cigar"),
        cigar_length(f[5], "M").alias("matched"),
        mismatches.alias("mismatches"),
        _tag(line, "MD:Z").alias("md"),
        f[9].alias("seq"),
    )
    share = F.when(F.col("matched") > 0, 1 - F.col("mismatches") / F.col("matched")).otherwise(0.0)
    out = base.withColumn("match_fraction", share)
    return out.where((longest_homopolymer("seq") <= MAX_HOMOPOLYMER) & (F.col("match_fraction") > 0)).drop("seq", "matched", "mismatches")


def _attribute(text: Column, key: str) -> Column:
    value = F.regexp_extract(text, rf'(?:^|[\s;]){key}\s+"?([^";\s]+)', 1)
    return F.when(value != "", value)


def parse_gtf(lines: DataFrame, column: str = "value") -> DataFrame:
    """Features [lo, hi) with the attributes used for annotation; NULL if absent."""
    line = F.col(column)
    f = F.split(line, "\t")
    start, end = f[3].cast("long"), f[4].cast("long")
    attr = f[8]
    rows = lines.where(~line.startswith("#")).select(
        f[0].alias("contig"),
        f[2].alias("feature"),
        F.least(start, end).alias("lo"),
        F.greatest(start, end).alias("hi"),
        _attribute(attr, "gene_name").alias("gene"),
        _attribute(attr, "gene_biotype").alias("biotype"),
        F.coalesce(_attribute(attr, "transcript_id"), _attribute(attr, "gene_id")).alias("gene_id"),
        _attribute(attr, "transcript_name").alias("tx"),
        _attribute(attr, "transcript_biotype").alias("tx_biotype"),
    )
    return rows.where(F.col("hi") - F.col("lo") <= MAX_FEATURE_SPAN)
