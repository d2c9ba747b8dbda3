"""Benchmark: headline queries and the main job at $BENCH_SF_DIR.

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is planned from scratch (own stage tables) and executed in full
into Spark's no-op sink, so nothing is collected to the driver. "main_job"
is the job's main path in one run: baskets, counts, pairs, rules,
leave-one-out ranking and the evaluation tables.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trolley import queries as Q  # noqa: E402
from trolley.session import build_session  # noqa: E402

HEADLINE = [
    "baskets_sized",
    "item_freq",
    "pair_freq",
    "association_rules",
    "item_interaction",
    "basket_subsets",
    "topn_recs",
    "eval_per_item",
    "eval_overall",
    "nb_best_subset",
    "training_rows",
    "item_freq_since",
]


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    # One JVM holds all tasks.
    spark = build_session(
        f"local[{cpus}]", "trolley-bench", shuffle_partitions=4 * cpus, extra={"spark.driver.memory": "4g"}
    )
    spark.sparkContext.setLogLevel("ERROR")

    # Warm-up: JVM, Python workers and file listing, not timed.
    run_noop(Q.SPARK["item_freq"](spark, sf_dir))

    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        run_noop(Q.SPARK[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)

    t0 = time.perf_counter()
    r = Q.run(spark, sf_dir)
    for df in (r.item_freq, r.pair_freq, r.rules, r.ranked, r.eval_per_item, r.eval_overall):
        run_noop(df)
    times["main_job"] = round(time.perf_counter() - t0, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "sum_of_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
        "baskets": r.baskets.count(),
        "loo_samples": r.ranked.count(),
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
