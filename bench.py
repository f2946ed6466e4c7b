"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from wayfare.plans import catalog
from wayfare.session import session

HEADLINE = (
    "best_offers_by_hotel best_offers_min_by best_offers_fallback hotel_offers filter_all hotel_mapping_stats hotel_mapping_fallback orphan_offers index_stats index_intersection airport_any_counts "
    "price_range_counts price_bucket_counts bucket_search dedupe_key9 rec_personalized rec_similar rec_trending rec_value_deals ingest_offers_named validate_offers data_quality shortlist_items alerts_triggered "
    "sustained_slow_alerts latency_percentiles"
).split()
REPEATS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(REPEATS + 1):  # the first compiles
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
