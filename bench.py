"""Wall time of the headline queries; prints one JSON line.

Each query is run once to warm up its classes and code and then timed, from building the plan to
the last row.  Rows go to the no-op sink, so every column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from declara.plans.queries import QUERIES
from declara.session import local_session

HEADLINE = [
    "q_compliance_score", "q_rule_results", "q_extract_fields", "q_extract_to_score", "q_text_repair",
    "q_box_metrics", "q_readability", "q_region_merge", "q_ensemble", "q_reading_order", "q_iou_pairs",
    "q_quality_rank", "q_keyframes", "q_panel_merge", "q_scan_page", "q_dash_summary", "q_dash_fields",
    "q_dash_trend", "q_dash_brands", "q_dash_height", "q_violations_log", "q_all_scans",
    "q_brand_authenticity", "q_doc_metadata", "q_keyword_search", "q_vector_search", "q_answers",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in QUERIES]
    spark = local_session("bench", cores, shuffle_partitions=int(cores), memory=os.environ.get("BENCH_MEMORY", "16g"))

    spark.conf.set("declara.deal", cores)

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(run(name), 3)
    print(json.dumps({
        "metric": "total wall time of headline queries, second run", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cores": cores,
        "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
