"""Headline queries, one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from postlens.session import local_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    from postlens.plans import registry

    queries = registry.queries()
    names = (
        "normalize_postings", "new_postings", "rule_score", "skill_token_join", "run_summary",
        "duration_histogram", "latest_run", "first_scan_flag", "schedule_next", "selector_health",
        "node_table", "select_records", "listing_region", "greenhouse_postings", "extraction_score",
        "unnotified",
    )
    spark.range(1).count()
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
