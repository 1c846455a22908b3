"""Headline timings: one JSON line with seconds per query group.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores, BENCH_QUERIES a comma list of query names.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalens import build_session  # noqa: E402
from catalens.plans import load_all  # noqa: E402

HEADLINE = (
    "vector_self_retrieval", "vector_neighbours_150", "eval_summary", "near_duplicate_photos", "item_cards", "search_views", "rating_distribution", "latest_views", "activity_sessions",
    "value_quantiles", "leaderboard", "facet_counts", "search_hits", "text_features", "detected_entities", "phrase_hits", "glossary_word_hits", "review_feed", "reminder_items",
    "reaction_digest", "badge_progress", "severity_counts", "changes_upserted", "normalize_label_text",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all().QUERIES
    registry["rating_distribution"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    registry["normalize_label_text_nfkc"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # and the Python workers
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
