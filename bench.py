"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from evolens import catalog  # noqa: E402
from evolens.session import local_session  # noqa: E402

HEADLINE = (
    "features_all",
    "history_sequence",
    "rule_labels",
    "metrics_with_time",
    "commits_normalise",
    "snapshots_latest",
    "file_metadata",
    "topk_commit_count",
    "topk_anomaly",
    "selection_quality",
    "longest_series",
    "cluster_medians",
    "percentile_rank",
    "interpretation_context",
    "before_after_delta",
    "validate_text",
    "strip_ungrounded",
    "prompt_table",
    "batch_infer_retry",
    "hash_embed",
    "knn_scoped",
    "knn_overfetch",
    "knn_windowed",
    "silhouette_exact",
    "isolation_forest",
    "kmeans_auto_k",
    "evolution_run",
)


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "evolens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["cluster_sizes"](spark, folder).count()  # start the session before timing
    seconds = {}
    for name in names or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
