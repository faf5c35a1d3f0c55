"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names, ``all`` for every query), BENCH_RUNS (default 1).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

# One or more per family: text folds, identity, joins, windows, aggregates, export.
HEADLINE = (
    "f5_corpus_health", "a3_doc_map_files", "b1_content_identity", "b4_markdown_headings",
    "b5_section_tree", "c4_structural_chunks", "c4_packed_lines", "c5_sentences",
    "c7_semantic_chunks", "c8_hybrid_chunks", "c9_token_windows", "c12_located_clauses",
    "c16_merged_chunks", "c21_chunk_index", "d5_classification_requests", "d6_parsed_replies",
    "d7_unlabeled_chunks", "d9_chunk_embeddings", "d11_nearest_centroid", "d13_scored_labels",
    "e1_current_reviews", "e3_review_queue", "e6_next_unreviewed", "e9_status_runs",
    "f2_document_label_status", "f4_category_coverage", "f7_results_table", "g1_chunk_records",
    "g5_sidecar_rows", "h1_deleted_documents",
)


def main() -> None:
    from corpusloom.session import local_session
    from corpusloom.workload.registry import load, runner

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    registered = load()
    names = list(registered) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)

    spark = local_session(cpus)
    # Start-up and first-compilation costs of the JVM belong to no query.
    runner(registered[HEADLINE[0]])(spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            runner(registered[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 3)
        print(f"{seconds[name]:8.2f}  {name}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
