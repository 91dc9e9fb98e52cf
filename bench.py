"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the local cores, BENCH_QUERIES a comma list
to run instead of the default selection.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridsieve.queries import QUERIES  # noqa: E402
from gridsieve.session import build_session  # noqa: E402

HEADLINE = [
    "m0_curated_leaderboard", "b4b5_column_profile", "b15_duplicate_keys", "e1_dedup_keep_best", "c4_longest_substring",
    "c9_descriptor_assembly", "d7_percentiles", "d8_column_medians", "d14_group_metrics", "d15_spearman",
    "d18_conformal_quantile", "d23_calibration_curve", "d25_target_encoding", "e6_stratified_split", "e9_group_kfold",
    "e11_poisson_bootstrap", "c17_knn_mean_distance", "c18_self_knn", "i1_ridge_closed_form", "i2_gbt_early_stopping",
    "i4_cv_scores", "i7_split_conformal", "i9_bootstrap_intervals", "i11_batch_scoring", "i12_candidate_screening", "i12_screening_flow",
    "i14_ad_labels", "i16_learning_curve", "i17_permutation_importance",
]


def scoring_step(spark, sf_dir):
    """(seconds, rows) of the ensemble's scores of a written candidate grid, with members fitted before."""
    from pyspark.sql import functions as F

    from gridsieve.operators import learn
    from gridsieve.queries.models import members
    from gridsieve.queries.screening import grid
    from gridsieve.session import new_path
    from gridsieve.sources.sinks import save_state

    candidates = grid(spark, sf_dir).withColumn("x1", F.pmod(F.xxhash64("host"), F.lit(50)).cast("double"))
    candidates, fits = save_state(candidates, new_path(spark, "bench-grid")), members(spark, sf_dir)
    start = time.time()
    learn.ensemble_interval(candidates, fits).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3), candidates.count()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.TemporaryDirectory(prefix="bench-")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.checkpoint.dir": shared.name,
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    # JVM and Python workers start outside the measurement
    QUERIES["d14_group_metrics"](spark, sf_dir).collect()
    QUERIES["i1_ridge_two_features"](spark, sf_dir).collect()
    seconds, rates = {}, {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    if "i12_screening_flow" in seconds:
        # fit, candidates, ensemble scores, novelty against all training rows, cap and ranks
        rates["candidate_rows_per_sec"] = round(QUERIES["c15_cross_grid"](spark, sf_dir).count() / seconds["i12_screening_flow"])
        seconds["candidate_scoring_step"], n = scoring_step(spark, sf_dir)
        rates["candidate_scoring_rows_per_sec"] = round(n / seconds["candidate_scoring_step"])
    if "c17_knn_mean_distance" in seconds:
        vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        pairs = vectors.where("label < 5").count() * vectors.where("label >= 5").count()
        rates["knn_pairs_per_sec"] = round(pairs / seconds["c17_knn_mean_distance"])
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), **rates,
    }))


if __name__ == "__main__":
    main()
