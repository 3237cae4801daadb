"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run to completion through the ``noop`` sink (full
execution, nothing collected to the driver) and timed on its own.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "lexicon_filter",
    "pattern_edge",
    "pattern_chain3",
    "pattern_without",
    "masked_dataset",
    "prompt_dataset",
    "minimal_pairs",
    "ood_pairs",
    "task_batch",
    "ngram_sentence_score",
    "ngram_token_score",
    "ngram_masked_score",
    "metrics_by_group",
    "surprisal_distribution",
    "entropy_topk",
    "accuracy",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    from minpairs.plans.registry import QUERIES
    from minpairs.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    # warm the JVM and the file listing once, outside the timings
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    # one-offs that several queries share: the derived treebank, parsed once and
    # stored as parquet in the checkpoint folder, and the tables made of it
    from minpairs.plans import registry as R
    for name, build in (("treebank_ingest", R.treebank), ("build_index", R.index), ("build_pairs", R.stored_pairs),
                        ("build_bigram", R.bigram), ("build_bucketed_bigram", R.bucketed_bigram), ("build_trigram", R.trigram)):
        t0 = time.time()
        build(spark, sf_dir)
        times[name] = round(time.time() - t0, 3)
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_headline_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
