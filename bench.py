"""Time the headline queries; prints one JSON line.

Each query is run to completion twice and the second time counts, so that JVM warm-up is
not measured. Queries in ``BUILT`` are timed with all the tables they stand on built anew
(evidence, prompts, answers, steps). Those in ``reads`` only read such stored tables the
second time; what these cost is in ``BUILT`` and in ``first``, the first runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from faultline.catalog import registry, workspace  # noqa: E402
from faultline.session import build_session  # noqa: E402

HEADLINE = (
    "incident_metric_summary", "incident_logs", "incident_deployments", "last_deployment_before",
    "service_signals_volume", "detect_incidents", "detect_with_rules", "log_search", "incident_list",
    "chunk_documents", "hash_embed", "vector_topk", "vector_topk_dense", "incident_runbooks",
    "ingest_runbooks", "validate_contract", "telemetry_source", "append_logs", "upsert_services",
    "upsert_chunks", "check_integrity", "evidence_bundle", "build_prompts", "validate_reports",
    "investigation_detail", "investigation_report", "llm_call_rollup", "estimate_tokens",
    "incident_board", "timeline_rows",
)

BUILT = ("evidence_bundle", "investigation_report")
READS = (
    "build_prompts", "validate_reports", "investigation_detail", "incident_board", "timeline_rows",
    "telemetry_source", "incident_runbooks",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry()
    wanted = sys.argv[1:] or HEADLINE
    names = list(queries) if wanted == ["all"] else wanted
    first: dict[str, float] = {}
    timed: dict[str, float] = {}
    for target in (first, timed):
        for name in names:
            if target is timed and name in BUILT:
                workspace.forget()
            start = time.perf_counter()
            queries[name][0](spark, folder).write.format("noop").mode("overwrite").save()
            target[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries, warm",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "first": first,
                "reads": [name for name in names if name in READS],
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
