"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from passageloom.plans import registry  # noqa: E402
from passageloom.session import build_session  # noqa: E402

HEADLINE = [
    "chunk_words",
    "chunk_chars",
    "chunk_table",
    "index_refresh",
    "retrieve_filtered",
    "search_topk",
    "answer_prompt",
    "assemble_pages",
    "history_text",
    "qa_pairs",
    "src_latest",
    "activity_log",
    "activity_stream",
    "bleu",
    "rouge_l",
    "score_pairs",
    "score_pairs_stemmed",
    "score_summary",
    "describe_scores",
    "grouped_sum",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.all_queries()
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.time()
        # The noop sink computes every row and column and keeps none.
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    cold = {name: run(name) for name in names}
    warm = {name: run(name) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
