"""Seconds per headline query: one warm-up, then the median of three runs.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores; names as arguments
choose queries, ``all`` every registered one. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tidemark.plans.registry import load_all
from tidemark.session import local_session

HEADLINE = [
    "corpus_ngram_overlap",
    "corpus_bleu",
    "ngram_diversity",
    "corpus_ngram_diversity",
    "bigram_perplexity",
    "embedding_similarity",
    "embedding_diversity",
    "coherence",
    "capacity_timeline",
    "lock_conflicts",
    "checkpoint_cadence",
    "retention",
    "list_checkpoints",
    "job_timeline",
    "latency_percentiles",
    "quota_fold",
]


def timed(run, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    entries = load_all()
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(entries)
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    seconds = {}
    for name in names:
        timed(entries[name].run, spark, sf_dir)
        runs = [timed(entries[name].run, spark, sf_dir) for _ in range(repeat)]
        seconds[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
