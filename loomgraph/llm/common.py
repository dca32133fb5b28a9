"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.core.session import shared_folder

#: Whitespace of the contracts: space and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the folder all executors share and read it again.

    Cuts the lineage like a reliable checkpoint, but compressed and readable by
    column; a lost executor costs nothing of what is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def set_aside(docs: DataFrame, used: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``docs`` with every column but the ``used`` ones under a name no operator takes; ``toDF(*docs.columns)`` turns it back."""
    return docs.toDF(*[c if c in used else f"_extra_{i}_" for i, c in enumerate(docs.columns)])


def fold(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part``; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of the string or binary ``column``; a longer value is a slice of its own."""
    for batch in batches:
        values = batch.column(column)
        if not len(values):
            continue
        wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
        at = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1]
        first = 0
        while first < len(values):
            stop = max(first + 1, int(np.searchsorted(at, int(at[first]) + size, "right")) - 1)
            yield batch.slice(first, stop - first)
            first = stop
