"""Physical plans: no pairwise joins anywhere, no Python in the expression operators, pruned scans."""

import re

import pytest

from gridsieve.queries import QUERIES

PYTHON_FREE = [
    "m0_curated_leaderboard", "b12_multi_filter_topk", "b15_duplicate_keys", "c1_dim_lookup_default", "c4_longest_substring",
    "c9_descriptor_assembly", "d7_percentiles", "d15_spearman", "d25_target_encoding",
    "e6_stratified_split", "e9_group_kfold", "h19_conformal_intervals", "i12_candidate_screening", "i17_linear_shapley",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# the seed index scans texts map-side in Arrow batches (a filter of the seeds instead of all substrings of a text)
@pytest.mark.parametrize("name", PYTHON_FREE + ["c4_longest_substring_table", "c17_knn_mean_distance", "i14_ad_labels", "i9_bootstrap_intervals"])
def test_no_pairwise_join(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", PYTHON_FREE)
def test_no_python_nodes(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups", plan)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["b12_multi_filter_topk"](spark, sf_dir))
    assert "PushedFilters: [In(o_orderpriority" in plan
    assert "o_orderdate" not in plan.split("ReadSchema")[-1]


def test_dedup_prunes_before_the_shuffle(spark, sf_dir):
    plan = plan_of(QUERIES["e1_dedup_keep_best"](spark, sf_dir))
    assert plan.count("WindowGroupLimit") >= 2
    assert plan.index("Final") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_no_text_is_shuffled_to_find_its_keys(spark, sf_dir):
    plan = plan_of(QUERIES["c4_longest_substring_texts"](spark, sf_dir))
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and not any("_text#" in line for line in exchanges) and "_stretch" not in plan


# customer and part are one small file each, so one task would do all the work per row
@pytest.mark.parametrize("name", ["d23_calibration_curve", "i9_bootstrap_intervals"])
def test_costly_rows_of_small_files_are_spread(spark, sf_dir, name):
    assert "REPARTITION_BY_NUM" in plan_of(QUERIES[name](spark, sf_dir))
