"""Time headline queries: prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

from seqloom.plans.catalog import load
from seqloom.session import local_session

HEADLINES = (
    "symbol_states", "frame_states_inc", "suffix_ancestors", "code_words", "non_overlapping_words",
    "information_rate_cum", "threshold_rates_cum", "find_threshold", "self_similarity_lrs",
    "transition_trn", "hmm_tensor", "repeated_patterns", "fragments", "predict_next", "log_loss",
    "query_best_path", "query_with_continuity", "track", "track_gestures", "align", "recognition",
    "follow_predicted", "improvise", "generate", "overlap_add", "metric_cosine", "transposed_distance",
    "segment_spans", "segmentation_agglomerative", "segmentation_spectral", "segmentation_structure_feature",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:] or HEADLINES
    spark, catalog = local_session("bench", cpus), load()
    catalog["symbol_states"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in only:
        t0 = time.perf_counter()
        catalog[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))


if __name__ == "__main__":
    main()
