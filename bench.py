"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is written to the ``noop`` sink, so every row and column is computed
and nothing is collected. The first run is cold (planning and code generation
included); the reported time is the better of two warm runs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from wirepulse.plans import catalog
from wirepulse.session import build_session

HEADLINE = (
    "prefilter_full", "canonical_url", "normalize_title", "url_key", "article_text", "dedupe_two_key", "dedupe_url",
    "deal_cooldown", "deal_source_merge", "confidence_gate", "render_alert", "latency_stats", "feed_rss_items",
    "verdict_validate", "batch_packing", "error_streak", "gap_detection", "source_state_asof", "daily_usage",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(run(spark, name, sf_dir), 3)
        warm[name] = round(min(run(spark, name, sf_dir) for _ in range(2)), 3)
        print(f"{name}: cold {cold[name]} warm {warm[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, warm total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
