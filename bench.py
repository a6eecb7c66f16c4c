"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) on
``local[$BENCH_CPUS]``.  Results go to a sink that keeps nothing, so the whole
query is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from rankwell.plans.catalog import load_all
from rankwell.session import local_session

HEADLINE = (
    "corpus_build_report",
    "corpus_build_all_reducers",
    "structure_dedupe",
    "quota_fill_slice",
    "corpus_description",
    "label_code_join",
    "evaluation_metrics",
    "per_language_metrics",
    "slice_promotion",
    "scorecard_slices",
    "label_audit",
    "conformal_fit",
    "risk_coverage_table",
    "growth_shape_fit",
    "dominant_term_projection",
    "tabular_features",
    "loop_carry_edges",
    "structure_signature",
    "transitive_closure",
    "global_edges",
    "entry_selection",
    "ngram_vocabulary",
    "first_splits",
    "message_round",
    "text_variants",
    "invariance_report",
    "token_bucket_batch",
    "request_scoring_stream",
    "library_cost_enrichment",
)


def main(argv: list[str]) -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, app="rankwell-bench")
    catalogue = load_all()
    names = argv or list(HEADLINE)
    # one warm-up so that class loading is not charged to the first query
    catalogue["class_distribution"].run(spark, sf_dir).write.format("noop").mode(
        "overwrite"
    ).save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalogue[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
