"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query is run once on a warm session; its result is forced with a noop write, so rows are
computed in full but not moved to the driver. Model queries also give their parts: preparation, split, training and
prediction apart, with the numbers of rows, under "parts".
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

TIMES = ["preparation_time_sec", "selection_time_sec", "split_time_sec", "training_time_sec", "prediction_time_sec"]
QUERIES = [
    "class_distribution", "dedup_full_row", "duplicate_report", "null_counts", "label_counts", "describe_features",
    "except_distinct", "except_all", "cohens_d", "feature_auc", "separability_ranking", "correlation_matrix",
    "split_random", "split_exact", "split_stratified", "split_ordered", "split_head_except",
    "sample_with_replacement", "slot_draws", "scale_zscore_pop", "roc_auc", "pr_auc", "ladder_counts", "robustness_delta",
    "gold_write", "logreg_metrics", "strict_generalization", "weighted_forest_cross_dataset",
    "weighted_forest_learnable",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from flowlab.queries import REGISTRY
    from flowlab.session import get_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("flowlab-bench", **{
        "spark.master": f"local[{cpus}]",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(2 * int(cpus)),
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="flowlab-bench-"),
    })
    spark.sparkContext.setLogLevel("OFF")
    REGISTRY["class_distribution"](spark, folder).collect()
    seconds, parts = {}, {}
    for name in sys.argv[1:] or QUERIES:
        start = time.perf_counter()
        result = REGISTRY[name](spark, folder)
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        if set(TIMES) <= set(result.columns):
            # One row per run, at most a few dozen.
            runs = result.select("train_rows", "test_rows", *TIMES).collect()
            parts[name] = [
                {k: round(v, 3) if isinstance(v, float) else v for k, v in r.asDict().items()}
                | {"training_us_per_row": round(1e6 * r.training_time_sec / max(1, r.train_rows), 2)}
                for r in runs
            ]
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "parts": parts, "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
