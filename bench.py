"""Headline questions on the given tables; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every
result is computed in full (written to the no-op sink); a small warm-up run comes first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from casetrail.plans import QUERIES  # noqa: E402
from casetrail.session import build  # noqa: E402

HEADLINE = [
    "validate_transactions", "validate_outcome_counts", "dedupe_first_arrival", "links_sent_to",
    "account_summary_all", "top_counterparties", "resolve_persons", "sanctions_screen", "search_by_name",
    "network_depth1", "network_depth2", "note_knn", "hash_embedding_buckets", "citation_audit",
    "evidence_lookup", "stream_ingest_links",
]


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true"})
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in ("validate_transactions", "account_summary_all", "sanctions_screen"):
        run(spark, name, small if os.path.isdir(small) else folder)
    seconds = {name: run(spark, name, folder) for name in names}
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
