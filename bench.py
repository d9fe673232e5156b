"""Benchmark: headline queries on $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS].

Prints one JSON line: {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}.
Each query runs to completion through the no-op sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "chunk_tokens",          # clean + tokenize + overlapping windows
    "embed_hashed",          # hashed embedding of every chunk
    "retrieve_benchmark",    # flagship: corpus -> chunks -> embed -> exact top-50 per benchmark text
    "knn_exact",             # every vector's 50 nearest
    "knn_approx",            # product-quantised codes, lists chosen by measured recall
    "rebuild_collection",    # records -> first per id -> bucketed Parquet collection
    "insert_if_absent",      # keyed insert, replayed
    "hybrid_retrieve",       # exact-title leg + vector leg, cut at 52
    "assemble_prompt",
    "fuzzy_title_match",     # names against titles of a fitting length
    "bleu4",
    "rouge1_f",
    "evaluate",              # four metrics per pair incl. retrieval for grounding
    "ingest_stream",         # file stream -> chunks -> embed -> insert-if-absent
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from lodestar.plans import catalog
    from lodestar.session import local_session

    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16, app="lodestar-bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # warm-up on the smallest tables (JIT, Python workers, Arrow): the flagship touches the
    # regex, higher-order-function, Arrow-UDF and mapInPandas paths; timings below are steady state
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        catalog.QUERIES["retrieve_benchmark"](spark, warm_dir).write.format("noop").mode("overwrite").save()
    catalog.QUERIES["token_length"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
