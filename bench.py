"""Bench: headline queries on ``local[$BENCH_CPUS]``, one JSON line on standard output.

Every query writes its full result to the ``noop`` sink. The time is the median of
``$BENCH_RUNS`` (3) runs after one warm-up run; long queries are measured once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyspark  # noqa: E402

from likeness.plans import registry  # noqa: E402
from likeness.session import local_session  # noqa: E402

LONG = 20.0  # seconds; a query that warms up longer is measured once
HEADLINE = [
    "profile_lineitem", "profile_sketch", "pearson_lineitem", "cramers_orders", "contingency_lineitem", "column_evidence", "pk_candidates", "fk_overlap", "ref_clean",
    "pii_columns", "pii_token_hits", "semantic_types", "fk_by_name", "associations", "row_propagation", "gen_customers", "gen_orders_fk", "gen_price", "gen_stitched",
    "randomize_orders", "bounds_lineitem", "noise_lineitem", "knn_smooth_part", "resample_up", "row_index", "ts_frequency", "ts_model", "ts_generate",
    "copula_corr", "copula_sample", "single_synth", "multi_synth", "activity_rollup", "stream_rollup",
    "hier_synth", "ts_decompose", "ts_moving_average", "ts_generate_events", "text_synth", "dag_tiers", "knn_smooth_lines", "cramers_wide", "csv_documents", "key_shapes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus, "likeness-bench")
    known = registry.queries()
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        while len(taken) <= (runs if not taken or taken[0] < LONG else 1):
            t = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - t)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries, median of warm runs", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "spark": pyspark.__version__, "driver_memory": spark.conf.get("spark.driver.memory", ""),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
