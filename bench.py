"""Runs the headline queries and prints one JSON line with seconds by query."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from reelsleuth.plans.registry import QUERIES  # noqa: E402

HEADLINE = [
    "digest_fallback_lookup", "A05_set_completeness", "A01_word_counts", "A03_stem_counts", "T02_weighted_containment", "T05_distinctive_fit", "T06_trigrams", "U02_trigram_overlap", "T07_transcript_verdict", "T08_transcript_place",
    "W05_bad_runs", "W08_play_all_runs", "W07_numbering_shift", "W02_window_margin", "W13_keep_version", "C41_disc_shape", "A13_weighted_checksum", "A16_musicbrainz_id", "C58_migrate_plan", "J23_verify_reconcile", "O01_assignment", "O02_set_placement",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for key in HEADLINE:
        began = time.time()
        QUERIES[key](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
