"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Every query is executed in full with the ``noop`` sink (all columns computed,
nothing collected).  Steady state: each headline query first runs once, untimed,
on the sf0.001 tables (JVM start-up, code generation of the large text
expressions, Python workers) - one-off costs that a long job pays once per
executor.  Prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lensmap.plans import catalog  # noqa: E402
from lensmap.session import build_session  # noqa: E402

HEADLINE = [
    "R3_map_feedback",       # flagship: every vector mapped to its top-5 viewpoints
    "V1_cosine",
    "V2_l2",
    "V3_inner_product",
    "V5_knn_join",
    "T1_clean_text",         # regex cleaning over every whole document
    "T2_knowledge_text",
    "E1_embed",              # hashing embedder over every whole document
    "E2_embed_batch",        # dedup + cache + embed + join back
    "R2_build_feedback",     # documents -> texts -> embed -> map -> metadata
    "V10_semantic_search",   # user turns searched against the knowledge collection
    "C4_upsert_entities",
    "S1_json_dir_scan",
    "V5_knn_join_tiled",     # the paths that take over at scale
    "V11_ivf_search",
    "T11_feedback_projection",
    "S7_run_stats_sink",
    "X1_stream_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", app="lensmap-bench",
                          shuffle_partitions=int(cpus) * 2)
    # Warm-up (not timed): JVM, Python workers and the Arrow UDF path, on the
    # smallest tables next to the bench data if present.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for w in names:
        catalog.QUERIES[w](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        try:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # a failing query is reported, not fatal
            times[name] = None
            print(f"# {name}: FAILED {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
            continue
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(v for v in times.values() if v is not None), 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": total,
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
