"""Benchmark: headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

    python bench.py            headline queries
    python bench.py --slow     the slowest queries, which the headline leaves out
    python bench.py --all      every registered query
    python bench.py NAME...    queries whose name contains a given part
"""

from __future__ import annotations

import json
import os
import sys
import time

# The slowest queries are left to --slow, as they would take longer than all others together.
SLOW = ["J1_linkage_cascade", "L6_line_position_label", "L8_block_assembly", "L14_paragraph_flows", "L25_document_model", "S9_note_html", "T17_glossary_relevance"]
HEADLINE = [
    "flagship_clean_sentences", "T1_sentence_segmentation", "T4_bigram_similarity", "T5_echo_strip", "T16_glossary_first_occurrence",
    "L3_line_text", "L10_block_classification", "L11_reading_order", "L12_running_headers", "L16_piece_geometry", "L21_outline",
    "J2_bibliographic_key", "J4_journal_whitelist", "J7_side_mirroring", "J9_as_of_latest", "J11_topmost_hit", "J13_untranslated_per_page", "J15_citation_neighbours",
    "Q3_bilingual_search", "Q7_related_ranking", "G4_translation_progress", "G10_ordered_string_aggregation", "W4_batch_packing", "W8_overlap_segmentation",
    "X1_weighted_mode", "M1_lww_upsert", "M3_tombstone_cascade", "M4_union_merge_with_epoch", "M6_outbox_capture", "R1_continuous_lww_state", "R3_debounce_bursts",
    "S5_prompt_lines", "S7_ris_export",
    "J3_fuzzy_title_top1", "L17_range_rectangles", "T10_citation_rendering",
]


def main(argv: list[str]) -> None:
    from quire.plans import load
    from quire.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries, _ = load()
    if "--all" in argv:
        names = list(queries)
    elif "--slow" in argv:
        names = SLOW
    elif argv:
        names = [n for n in queries if any(a in n for a in argv)]
    else:
        names = HEADLINE
    spark = local_session(cpus, "bench")
    # One small job loads the classes every query needs.
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
