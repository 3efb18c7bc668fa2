"""Time the headline queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelweave.plans.catalog import QUERIES  # noqa: E402
from panelweave.session import get_spark  # noqa: E402

HEADLINE = (
    "flagship",
    "bucket_sum_series",
    "hierarchy_levels",
    "impute_linear",
    "lags_1_to_h",
    "time_split",
    "accuracy_pooled",
    "accuracy_by_series",
    "backtest_accuracy",
    "ensemble_weighted",
    "global_vs_local",
    "final_benchmark",
    "decompose",
    "anomalies",
    "acf",
    "fc_level_smoothing",
    "fc_exp_smoothing",
    "fc_autoregressive",
    "recursive_forecast",
    "fc_elastic_net",
)


def run(spark, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bench")
    run(spark, "flagship", sf_dir)  # start-up and code generation are not what is measured
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
