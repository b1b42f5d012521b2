"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from groundwell.conformance import load  # noqa: E402
from groundwell.plans.views import Corpus  # noqa: E402
from groundwell.session import local_session  # noqa: E402

HEADLINE = [
    "n08_search_text", "b10_classify_line", "j14_list_with_counts", "w01_latest_version_job", "k01_job_transition",
    "g06_duration_histogram", "q06_uniqueness", "j13_near_dup_pairs", "c09_assemble_chunk", "index_build", "r01_semantic_topk",
    "x07_select_citations", "e14_score_case", "r05_lexical_topk", "r11_retrieve", "e22_run_eval",
]


def build_index(spark, directory):
    """The stored index that the retrieval queries after it read: postings, dictionary, vectors."""
    return Corpus(spark, directory).index.chunks.select("chunk_id")


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores)
    queries = load().QUERIES | {"index_build": build_index}
    queries["f26_short_hash"](spark, directory).write.format("noop").mode("overwrite").save()  # start the JVM paths
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        queries[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(directory).name,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
