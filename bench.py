"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from gristmill.plans import catalog
from gristmill.session import local_session

HEADLINE = ("knn_topk", "knn_filtered", "quantized_knn", "article_dedup", "retrieval_metrics", "paired_test", "mine_negatives", "in_batch_loss", "corpus_stats", "label_attach", "integrity_filter", "event_windows")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus))
    catalog.QUERIES["corpus_stats"](spark, folder).collect()  # starts the session
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.time()
            catalog.QUERIES[name](spark, folder).collect()
            runs.append(time.time() - began)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
