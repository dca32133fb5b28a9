"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text.  A ledger
holds one row per (blob, rule, rule version) that has been scanned, findings or
not; a scan looks only at pairs the ledger lacks and the findings are joined
back to all paths that hold the blob.

Defined cases: a null text is an empty one; an empty text has no findings;
repeated rows are kept, one result each; an empty table gives an empty result;
other columns of the input are ignored.  Positions are code points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.spans import Rule, located

# The three patterns of the contract.
RULES = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        "char_length(g) >= 8",
    ),
    Rule("access", "AKIA[A-Z0-9]+", 0, "char_length(g) >= 16"),
    Rule("hex", "[0-9a-f]{32,}", 0),
)
#: Copies of one blob are dealt to this many tasks when findings go back to paths.
SALTS = 32

LEDGER = "blob string, rule string, version string, spans array<struct<start:bigint,end:bigint>>"


def blobs_of(versions: DataFrame, path: str, text: str) -> DataFrame:
    """(path, blob, text): one row per row of ``versions``."""
    body = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("text"))


def scan(versions: DataFrame, path: str, text: str, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows for the (blob, rule version) pairs that ``ledger`` lacks."""
    blobs = blobs_of(versions, path, text).select("blob", "text").dropDuplicates(["blob"])
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("todo", wanted)
    else:
        done = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("done"))  # at most one entry a rule version
        left = F.when(F.col("done").isNull(), wanted).otherwise(F.array_except(wanted, F.col("done")))
        todo = blobs.join(done, "blob", "left").withColumn("todo", left).drop("done").where(F.size("todo") > 0)
    found = located(todo, "blob", "text", rules, carry=("todo",))
    kinds = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    found = found.withColumn("r", F.element_at(kinds, F.col("k") + 1)).where(F.array_contains("todo", F.col("r")))
    spans = found.groupBy("blob", "r").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    pairs = todo.select("blob", F.explode("todo").alias("r"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return pairs.join(spans, ["blob", "r"], "left").select("blob", "r.rule", "r.version", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per blob with findings under the current rule versions: counts by kind and the spans by start, then kind."""
    place = F.lit(None).cast("int")
    for n, r in enumerate(rules):
        place = F.when((F.col("rule") == r.kind) & (F.col("version") == r.version), F.lit(n)).otherwise(place)
    hits = ledger.where(F.size("spans") > 0).withColumn("k", place).where("k is not null")
    marks = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("k").alias("k"), s["end"].alias("end"), F.col("rule").alias("kind")))
    counts = [F.sum(F.when(F.col("rule") == r.kind, F.size("spans")).otherwise(0)).cast("bigint").alias(f"n_{r.kind}") for r in rules]
    out = hits.withColumn("marks", marks).groupBy("blob").agg(*counts, F.array_sort(F.flatten(F.collect_list("marks"))).alias("marks"))
    return out.withColumn("spans", listed(F.col("marks"))).drop("marks")


def on_paths(versions: DataFrame, path: str, text: str, per_blob: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings of every path.  Blobs with findings are few rows; each is laid out once per salt, so copies spread."""
    paths = blobs_of(versions, path, text).select("path", "blob", F.pmod(F.xxhash64("path"), F.lit(SALTS)).alias("salt"))
    copies = per_blob.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    out = paths.join(copies, ["blob", "salt"], "left")
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0).cast("bigint")).alias(f"n_{r.kind}") for r in rules]
    return out.select("path", *counts, F.coalesce("spans", F.lit("")).alias("spans"))


def secret_report(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The contract's row for every document; ``ledger`` holds earlier scans, if any."""
    new = scan(docs, "doc_id", "text", RULES, ledger)
    every = new if ledger is None else new.unionByName(ledger)
    out = on_paths(docs, "doc_id", "text", findings(every))
    return out.select(
        F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans"
    )
