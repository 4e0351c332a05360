"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.  Every query
is timed with its whole work: nothing staged by an earlier query is reused.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "p04_normalize_title", "p13_infer_study_design", "p17_boolean_concept_search", "j06_match_existing_article",
    "j16_phrase_match", "d02_connected_components", "d06_merge_cluster", "d07_cluster_id", "a01_weighted_keyword_score",
    "l02_coarse_filter", "l09_top_k_similar", "w10_evidence_spans", "j14_resolve_spans", "j17_pairwise_inversions",
    "a02_preliminary_quality", "l03_rank_retained", "p22_batch_eligibility", "w15_stage_changes",
    "s02_scan_pubmed_xml", "k03_upsert_articles", "rank_corpus",
)


def main() -> None:
    from litmill import catalog
    from litmill.catalog import adapters
    from litmill.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:] or HEADLINE
    catalog.load()
    spark = local_session("bench", cpus)
    # One small query first, so that no timing includes starting the session.
    catalog.QUERIES["p02_normalize_pmid"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in wanted:
        adapters.forget()
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    line = {
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(found.group(1)) if found else None,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
