"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from loomgraph.core.session import local_session  # noqa: E402
from loomgraph.plans import catalog  # noqa: E402

HEADLINE = (
    "seqform_classify",
    "uei_consensus_pairs",
    "assoc_filter_fixpoint",
    "component_sizes_ranked",
    "directional_clusters",
    "consensus_sequence",
    "interval_annotation",
    "node_feature_matrix",
    "log_normalised_counts",
    "cluster_markers",
    "topk_prune",
    "coarsen_graph",
    "knn_exact",
    "rank_scores",
    "meta_log_odds",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    queries = catalog.queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
