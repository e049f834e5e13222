"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from presswork.plans import QUERIES  # noqa: E402
from presswork.plans.registry import INPUT_PARTITIONS  # noqa: E402
from presswork.session import get_session  # noqa: E402

HEADLINE = (
    "preprocess_text", "clean_html", "words_per_language", "learn_phrases", "apply_phrases", "build_vocab", "encode_tokens",
    "tfidf_features", "feature_store_roundtrip", "stratified_kfold", "balanced_subset", "kfold_centroids",
    "softmax_confidence", "nb_fit", "score_test_set", "ml_naive_bayes", "stream_score", "train_logreg",
    "class_report_full", "running_accuracy", "optimization_history", "halving_rung",
)
DEFAULT_PLAN = ("preprocess_text", "clean_html", "encode_tokens")  # timed again as the files are split


def seconds(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.TemporaryDirectory(prefix="presswork-bench-")
    spark = get_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__checkpoint__dir=shared.name,
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.conf.set(INPUT_PARTITIONS, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start-up is not part of any query
    times = {name: seconds(spark, name, sf_dir) for name in names}
    spark.conf.unset(INPUT_PARTITIONS)
    default_plan = {name: seconds(spark, name, sf_dir) for name in DEFAULT_PLAN if name in names}
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "default_plan": default_plan,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()
    shared.cleanup()


if __name__ == "__main__":
    main()
