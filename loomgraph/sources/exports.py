"""Writers.  Spark's commit protocol makes every write all-or-nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_form(parsed: DataFrame, folder: str) -> None:
    """Accepted reads partitioned by their form pair, rejected ones apart."""
    ok = (F.col("for_index") >= 0) & (F.col("rev_index") >= 0)
    parsed.where(ok).write.mode("overwrite").partitionBy("for_index", "rev_index").parquet(f"{folder}/reads")
    parsed.where(~ok).write.mode("overwrite").option("compression", "gzip").json(f"{folder}/rejected")


def write_components(edges: DataFrame, folder: str) -> None:
    edges.write.mode("overwrite").partitionBy("comp_rank").parquet(folder)


def write_lines(lines: DataFrame, folder: str) -> None:
    """One text column, for FASTA and link lists."""
    lines.write.mode("overwrite").text(folder)


def coordinate_lines(coords: DataFrame, names: Sequence[str]) -> DataFrame:
    """Node number and coordinates with ten decimals, comma separated."""
    return coords.select(F.concat_ws(",", F.col("node_id").cast("string"), *[F.format_string("%.10e", F.col(c)) for c in names]).alias("value"))


def write_matrix(obs: DataFrame, var: DataFrame, x: DataFrame, info: dict[str, str], folder: str) -> None:
    """Annotated matrix as three tables and a one-row map."""
    obs.write.mode("overwrite").parquet(f"{folder}/obs")
    var.write.mode("overwrite").parquet(f"{folder}/var")
    x.write.mode("overwrite").parquet(f"{folder}/x")
    x.sparkSession.createDataFrame([(info,)], "uns map<string,string>").write.mode("overwrite").json(f"{folder}/uns")


def attach(obs: DataFrame, columns: DataFrame) -> DataFrame:
    """Coordinates or labels joined to the rows by node number."""
    return obs.join(columns, "node_id", "left")


def attach_labels(obs: DataFrame, labels: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One label column per clustering method."""
    wide = labels.groupBy("node_id").pivot("method", list(methods)).agg(F.max("label"))
    return obs.join(wide, "node_id", "left")
