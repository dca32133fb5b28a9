"""Read parsing over a file stream.

The reference workflow restarts from the files it finds; here a stream with a
checkpoint does: only new read files are parsed, and barcode counts grow with
them.  Parsing is stateless and uses the batch operators unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators import reads as R
from loomgraph.operators.seqform import Form

PAIRS = "read_no long, name string, read1 string, read2 string"


def pair_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Mate pairs arriving as Parquet files."""
    return spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_parsed(pairs: DataFrame, for_forms: Sequence[Form], rev_forms: Sequence[Form], folder: str, state: str) -> StreamingQuery:
    """Parsed reads appended by form pair, once per input file."""
    parsed = R.parse_reads(pairs, for_forms, rev_forms)
    writer = parsed.writeStream.format("parquet").partitionBy("for_index", "rev_index").outputMode("append")
    return writer.option("path", folder).option("checkpointLocation", state).trigger(availableNow=True).start()


def count_forms(pairs: DataFrame, for_forms: Sequence[Form], rev_forms: Sequence[Form], name: str, state: str) -> StreamingQuery:
    """Running read counts per form pair; the state is one row per pair."""
    counts = R.form_counts(R.parse_reads(pairs, for_forms, rev_forms))
    writer = counts.writeStream.format("memory").queryName(name).outputMode("complete")
    return writer.option("checkpointLocation", state).trigger(availableNow=True).start()


def count_barcodes(pairs: DataFrame, for_forms: Sequence[Form], rev_forms: Sequence[Form], folder: str, state: str) -> StreamingQuery:
    """Partial barcode counts per batch; their sums are the counts so far.

    A batch adds one file set named after it, so a repeated batch overwrites
    itself and nothing is counted twice.
    """
    codes = R.accepted(R.parse_reads(pairs, for_forms, rev_forms)).select(F.explode(F.concat("for_uxis", "rev_uxis")).alias("seq"))

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("seq").agg(F.count(F.lit(1)).alias("n_reads")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return codes.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()


def barcode_totals(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).groupBy("seq").agg(F.sum("n_reads").alias("n_reads"))
