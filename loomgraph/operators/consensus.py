"""Insert consensus sequences and fragment tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.core.order import group_index
from loomgraph.core.session import cut
from loomgraph.core.skew import known_small
from loomgraph.functions.seq import BASES, trim_at

KMER = 10
HEAVY = 1 << 28  # letters of a group that one task reads alone
OUT_LETTERS = 1 << 22  # letters of consensus in a batch

_LETTER = np.frombuffer(BASES.encode(), np.uint8)
_CODE = np.full(256, len(BASES), np.uint8)
_CODE[_LETTER] = np.arange(len(BASES))


def grouped_inserts(inserts: DataFrame, kmer: int = KMER) -> DataFrame:
    """Distinct inserts per (UMI, leading k-mer) with their multiplicity.

    Copies of one molecule are mostly identical; collapsing them first keeps
    the per-base expansion small.
    """
    keyed = inserts.where(F.length("insert_seq") > 0).withColumn("kmer", F.substring("insert_seq", 1, kmer))
    return keyed.groupBy("umi", "kmer", "insert_seq").agg(F.count(F.lit(1)).alias("n"))


def _add(votes: np.ndarray, seq: str, times: int) -> np.ndarray:
    """``votes`` (places x bases) with those of one sequence; longer when it is."""
    code = _CODE[np.frombuffer(seq.encode(), np.uint8)]
    if len(code) > len(votes):
        votes = np.concatenate([votes, np.zeros((len(code) - len(votes), len(BASES)), np.int64)])
    at = np.flatnonzero(code < len(BASES))
    votes[at, code[at]] += times
    return votes


def _winners(votes: np.ndarray) -> str:
    """The strictly most frequent base of every place, else N."""
    best = votes.max(axis=1)
    sure = (best > 0) & ((votes == best[:, None]).sum(axis=1) == 1)
    return np.where(sure, _LETTER[votes.argmax(axis=1)], ord("N")).astype(np.uint8).tobytes().decode()


def _called(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(umi, kmer, consensus, n_reads, mixed) of groups that come one after the other.

    Only the votes of the group at hand are held, four numbers a place.
    """
    types, done, size = None, [], 0
    group, first, votes, n = None, "", None, 0

    def written() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], ["umi", "kmer", "consensus", "n_reads", "mixed"])

    for batch in batches:
        types = types or [batch.schema.field("umi").type, pa.string(), pa.string(), pa.int64(), pa.bool_()]
        for umi, kmer, seq in zip(*(batch.column(c).to_pylist() for c in ("umi", "kmer", "letters"))):
            if group != (umi, kmer):
                if group is not None:
                    done.append((*group, first if votes is None else _winners(votes), n, votes is not None))
                    size += len(done[-1][2])
                    if size > OUT_LETTERS:
                        yield written()
                        done, size = [], 0
                group, first, votes, n = (umi, kmer), seq, None, 0
            if votes is None and seq != first:
                votes = _add(np.zeros((0, len(BASES)), np.int64), first, n)
            if votes is not None:
                votes = _add(votes, seq, 1)
            n += 1
    if group is not None:
        done.append((*group, first if votes is None else _winners(votes), n, votes is not None))
        yield written()


def _votes_by_place(inserts: DataFrame, kmer: int) -> DataFrame:
    """(umi, kmer, consensus, n_reads) with one row a place: votes of a group are summed by all tasks."""
    g = grouped_inserts(inserts, kmer)
    size = g.groupBy("umi", "kmer").agg(F.sum("n").alias("n_reads"))
    per_char = g.select("umi", "kmer", "n", F.posexplode(F.split("insert_seq", "")).alias("pos", "base"))
    sums = [F.sum(F.when(F.col("base") == b, F.col("n")).otherwise(0)).alias(b) for b in BASES]
    votes = per_char.groupBy("umi", "kmer", "pos").agg(*sums)
    best = F.greatest(*BASES)
    winners = sum(((F.col(b) == best).cast("int") for b in BASES), F.lit(0))
    letter = F.when((best == 0) | (winners > 1), "N")
    for b in BASES:
        letter = letter.when(F.col(b) == best, b)
    called = votes.select("umi", "kmer", "pos", letter.alias("base"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda s: s["base"]), "")
    return called.groupBy("umi", "kmer").agg(seq.alias("consensus")).join(size, ["umi", "kmer"])


def consensus(inserts: DataFrame, kmer: int = KMER, heavy: int = HEAVY) -> DataFrame:
    """Majority base per position of each (UMI, k-mer) group.

    A base must be strictly more frequent than each other one, else N.  The
    result is as long as the longest member.  Inserts move to their group once
    and are counted there one after the other; groups of ``heavy`` letters and
    more, which one task should not read alone, are counted place by place.
    """
    keyed = inserts.where(F.length("insert_seq") > 0).withColumn("kmer", F.substring("insert_seq", 1, kmer))
    letters = F.sum(F.length("insert_seq"))
    # the few groups that long, at most one for each ``heavy`` letters of the table; a null UMI has no key to join by
    long = [] if known_small(inserts) else keyed.where("umi is not null").groupBy("umi", "kmer").agg(letters.alias("n")).where(F.col("n") >= heavy).select("umi", "kmer").collect()
    rest, apart = keyed, None
    if long:
        keys = F.broadcast(inserts.sparkSession.createDataFrame(long, keyed.select("umi", "kmer").schema))
        rest, apart = keyed.join(keys, ["umi", "kmer"], "left_anti"), keyed.join(keys, ["umi", "kmer"], "left_semi")
    # a letter that is no base votes for none, so it may stand as N
    flat = rest.select("umi", "kmer", F.regexp_replace("insert_seq", "[^ACGT]", "N").alias("letters"))
    grouped = flat.repartition("umi", "kmer").sortWithinPartitions("umi", "kmer")
    umi = keyed.schema["umi"].dataType.simpleString()
    out = grouped.mapInArrow(_called, f"umi {umi}, kmer string, consensus string, n_reads long, mixed boolean")
    # members of no UMI are no group when they differ
    out = out.where(~(F.col("mixed") & F.col("umi").isNull())).drop("mixed")
    return out if apart is None else out.unionByName(_votes_by_place(apart.select(*inserts.columns), kmer))


def numbered(consensi: DataFrame) -> DataFrame:
    """Sub-consensus numbers per UMI in k-mer order, and the formatted name.

    A UMI has at most one row per k-mer (4^10 for the usual length), which
    bounds the window.  Only keys go through it: the sequences are written once
    and meet their number by row.
    """
    rows = cut(consensi.withColumn("_row", F.monotonically_increasing_id()))
    w = Window.partitionBy("umi").orderBy("kmer")
    number = rows.select("_row", "umi", "kmer").withColumn("sub", (F.row_number().over(w) - 1).cast("long")).select("_row", "sub")
    return rows.join(number, "_row").drop("_row").withColumn(
        "fqn", F.format_string("%s.%07d.sub%d", F.col("umi").cast("string"), F.col("n_reads"), F.col("sub"))
    )


def totals_per_umi(named: DataFrame) -> DataFrame:
    return named.groupBy("umi").agg(F.sum("n_reads").alias("n_reads"), F.count(F.lit(1)).alias("n_sub"))


def split_fqn(fqn: str = "fqn") -> list:
    parts = F.split(F.col(fqn), r"\.")
    return [parts[0].alias("umi_part"), parts[1].cast("long").alias("reads_part"), F.regexp_extract(parts[2], r"sub(\d+)", 1).cast("long").alias("sub_part")]


def trimmed(named: DataFrame, stops: Sequence[str], min_length: int) -> DataFrame:
    """Sub-consensuses cut at the first terminator, too short ones dropped."""
    cut_seq = trim_at("consensus", list(stops), min_length)
    return named.withColumn("fragment", cut_seq).where(F.col("fragment").isNotNull()).drop("consensus")


def fragments_per_umi(named: DataFrame, frags: DataFrame) -> DataFrame:
    """Every UMI with its reads and one row per fragment; ``N`` without any.

    The rows of a UMI are in ``sub`` order; they are not folded into one text.
    """
    totals = named.groupBy("umi").agg(F.sum("n_reads").alias("umi_reads"))
    rows = frags.select("umi", "sub", "fragment", "n_reads")
    return totals.join(rows, "umi", "left").select(
        "umi", "umi_reads", "sub", F.coalesce("fragment", F.lit("N")).alias("fragment"), F.coalesce("n_reads", F.lit(0)).alias("n_reads")
    )


def fasta_lines(frags: DataFrame) -> DataFrame:
    return frags.select(F.format_string(">%s\n%s", F.col("fqn"), F.col("fragment")).alias("value"))


def label_entries(assign: DataFrame) -> DataFrame:
    """Place of each annotation row in its UMI: sub reads, then UEI reads, descending.

    The aligned lists of a label are these rows in order of ``place``.  Places
    come from a global order, so a UMI with very many rows is no single task.
    """
    order = [F.col("umi"), F.desc("sub_reads"), F.desc("uei_reads"), F.col("fqn"), F.col("gene")]
    return group_index(assign, ["umi"], order, "place")
