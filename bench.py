"""Headline queries timed on one machine; prints one JSON line.

Every query is forced in full (all rows and columns) into a sink that drops them.
The first run of each query is a warm-up; the fastest of the others counts.
"""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from kipimo.plans import registry  # noqa: E402

HEADLINE = [
    "normalise_text",
    "first_subword",
    "argmax_label",
    "word_error_rate",
    "char_error_rate",
    "align_words",
    "asr_by_category_model",
    "adaptation_gain",
    "error_totals",
    "error_by_category",
    "top_substitutions",
    "top_deletions",
    "cosine_pair",
    "similarity_by_category",
    "similarity_global",
    "semantic_separation",
    "sensitivity_score",
    "interpolate_linear",
    "resample_frames",
    "prepare_source",
    "preprocess_clip",
    "run_probes",
    "uncertainty_summary",
    "rejection_rate",
    "ablation_summary",
    "clip_accuracy",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    registry.load()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.kipimo.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        df = registry.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(name)
        seconds[name] = round(min(run(name) for _ in range(repeats)), 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
