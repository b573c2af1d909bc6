"""Run the headline queries and print one JSON line with their times."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from provenor.catalogue import QUERIES  # noqa: E402
from provenor.session import build_session  # noqa: E402

HEADLINE = [
    "sco_candidate_ranking", "sco_candidate_features", "sco_cohort_support", "agg_sample_qc", "agg_iqr_flags", "agg_two_group_test",
    "agg_group_moments", "agg_degree", "agg_neighbour_features", "agg_support_stats", "agg_histogram_grouped", "agg_entity_map",
    "agg_rollup_ids", "jon_fact_dim", "jon_keep_list", "jon_norm_key_map", "jon_incident_edges", "jon_induced_subgraph",
    "jon_entity_mentions", "win_best_evidence", "win_canonical_edges", "win_percent_rank", "win_global_rank", "win_context_budget",
    "src_nested_json", "src_parse_ws_lines", "src_section_from_header", "rsh_unpivot", "rsh_conditional_pivot", "rsh_heatmap",
    "ret_cosine_topk", "ret_chunk_sections", "ret_context", "snk_parquet_roundtrip", "dqc_dup_keys", "dqc_ranges",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.checkpoint.dir": Path(tempfile.mkdtemp(prefix="bench-")).as_uri(), "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["agg_extremes"](spark, sf).collect()  # start-up is not part of the measurement
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
