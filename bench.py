"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores. Every query is
run in full into a sink that takes all columns of all rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from gleanset.catalog import registry  # noqa: E402
from gleanset.session import build_session  # noqa: E402

HEADLINE = (
    "dataset_build",
    "en_clean_counts",
    "english_clean_rows",
    "dedup_keep_first",
    "drop_conflicting",
    "duplicate_counts",
    "length_describe",
    "top_words",
    "stage_funnel",
    "balanced_split",
    "scarce_first_split",
    "proportional_sample",
    "chat_train_text",
    "prompt_schedule",
    "batch_infer",
    "detailed_results",
    "class_report",
    "model_comparison",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench",
        spark__master=f"local[{cpus}]",
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # Run the widest query once on the same tables, so that no query is charged for starting up.
    registry.QUERIES["dataset_build"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
