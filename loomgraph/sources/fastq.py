"""FASTQ files as a Spark data source.

Plain files are cut into byte ranges that are read in parallel; compressed ones
are one range each.  Rows carry their range and place in it, and ``read_numbers``
turns these into read ordinals with one number per range.
"""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

SCHEMA = "file int, range int, place long, name string, seq string, qual string"
RANGE_BYTES = 128 << 20


class FastqRange(InputPartition):
    def __init__(self, file: int, number: int, path: str, lo: int, hi: int):
        self.file, self.number, self.path, self.lo, self.hi = file, number, path, lo, hi


def _records(path: str, lo: int, hi: int) -> Iterator[tuple[str, str, str]]:
    """Records whose first byte lies in [lo, hi)."""
    packed = path.endswith(".gz")
    with gzip.open(path, "rb") if packed else open(path, "rb") as f:
        if lo > 0:
            f.seek(lo - 1)
            f.readline()  # up to the first line that starts in the range
            at = f.tell()
            while True:
                # a header is followed by a sequence and then a plus line
                f.seek(at)
                lines = [f.readline() for _ in range(4)]
                if not lines[0]:
                    return
                if lines[0].startswith(b"@") and lines[2].startswith(b"+") and len(lines[1].rstrip()) == len(lines[3].rstrip()):
                    break
                at += len(lines[0])
            f.seek(at)
        at = f.tell()
        while packed or at < hi:
            head, seq, plus, qual = (f.readline() for _ in range(4))
            if not head:
                return
            if not head.startswith(b"@") or not plus.startswith(b"+"):
                raise ValueError(f"broken FASTQ record in {path} near byte {at}")
            at += len(head) + len(seq) + len(plus) + len(qual)
            text = [x.rstrip(b"\r\n").decode("ascii", "replace") for x in (head, seq, qual)]
            yield text[0][1:].split(" ")[0], text[1], text[2]


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        paths = [p for item in options.get("path", "").split(",") if item for p in (sorted(glob.glob(item)) or [item])]
        self.paths, self.size = paths, int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for n, path in enumerate(self.paths):
            total = os.path.getsize(path)
            step = total if path.endswith(".gz") else self.size
            starts = range(0, max(total, 1), max(step, 1))
            out.extend(FastqRange(n, k, path, lo, min(lo + step, total)) for k, lo in enumerate(starts))
        return out

    def read(self, partition: FastqRange) -> Iterator[tuple]:
        for place, (name, seq, qual) in enumerate(_records(partition.path, partition.lo, partition.hi)):
            yield partition.file, partition.number, place, name, seq, qual


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str | StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, paths: Sequence[str], mate: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(mate, read_no, name, seq, qual) of one mate over several files in order."""
    spark.dataSource.register(FastqSource)
    raw = spark.read.format("fastq").option("path", ",".join(paths)).option("rangeBytes", str(range_bytes)).load()
    return read_numbers(raw).select(F.lit(mate).alias("mate"), "read_no", "name", "seq", "qual")


def read_numbers(raw: DataFrame) -> DataFrame:
    """Ordinals over files and ranges; only range sizes are put in order."""
    sizes = raw.groupBy("file", "range").agg((F.max("place") + 1).alias("n"))
    w = Window.orderBy("file", "range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sizes.select("file", "range", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))
    return raw.join(F.broadcast(starts), ["file", "range"]).withColumn("read_no", F.col("start") + F.col("place"))
