"""Splits, folds, ranks and quantiles: exactness, invariance, hot groups."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridsieve.functions import ranking
from gridsieve.operators import split


def greedy(sizes, n_folds):
    loads, groups = [0] * n_folds, [0] * n_folds
    for s in sorted(sizes, reverse=True):
        f = loads.index(min(loads))
        loads[f] += s
        groups[f] += 1
    return loads, groups


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=80), st.integers(1, 7))
def test_fold_plan_equals_one_by_one_greedy(sizes, n_folds):
    hist = list(pd.Series(sizes).value_counts().items())
    loads, groups = [0] * n_folds, [0] * n_folds
    for size, fold, first, last in split.group_fold_plan(hist, n_folds):
        loads[fold] += size * (last - first + 1)
        groups[fold] += last - first + 1
    assert (loads, groups) == greedy(sizes, n_folds)


def hot(spark, n=3000):
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 17}", float((i * 7919) % 101) if i % 5 else None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, x double")


def test_group_folds_keep_groups_whole(spark):
    out = split.group_kfold(hot(spark), "g", 4)
    assert out.count() == 3000
    assert out.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0


def test_group_folds_with_null_group(spark):
    df = hot(spark).withColumn("g", F.when(F.col("g") != "g1", F.col("g")))
    assert split.group_kfold(df, "g", 3).count() == 3000
    assert split.group_kfold(df, "g", None).select("fold").distinct().count() == df.select("g").distinct().count()


def test_split_is_invariant_under_repartition(spark):
    a = split.stratified_split(hot(spark), F.col("id"), "g").select("id", "split").toPandas().sort_values("id")
    b = split.stratified_split(hot(spark).repartition(13), F.col("id"), "g").select("id", "split").toPandas().sort_values("id")
    assert a["split"].tolist() == b["split"].tolist()
    shares = hot(spark).toPandas().merge(a, on="id").groupby("g")["split"].agg(lambda s: (s == "test").sum() - round(0.15 * len(s) + 1e-9))
    assert (shares.abs() <= 1).all()


def test_balanced_folds_and_learning_steps(spark):
    sizes = split.kfold(hot(spark), F.col("id"), 7, balanced=True).groupBy("fold").count().toPandas()["count"]
    assert sizes.max() - sizes.min() <= 1 and sizes.sum() == 3000
    steps = split.learning_subsets(hot(spark), F.col("id"), [0.1, 0.5, 1.0]).groupBy("step").count().toPandas()
    assert dict(zip(steps["step"], steps["count"])) == {0: 300, 1: 1200, 2: 1500}


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_quantiles_equal_numpy_for_any_bucket_count(spark, buckets):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    pdf = hot(spark).toPandas().dropna()
    got = ranking.exact_quantiles(hot(spark), "x", probs, ["g"], n_buckets=buckets).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert got.loc[g, "n"] == len(part)
        np.testing.assert_allclose(got.loc[g, "quantiles"], np.percentile(part["x"], [100 * p for p in probs]), rtol=1e-12)
    whole = ranking.column_quantiles(hot(spark), ["x", "id"], [0.5], buckets).toPandas().set_index("column")
    assert whole.loc["x", "quantiles"][0] == pytest.approx(pdf["x"].median())
    assert whole.loc["id", "quantiles"][0] == pytest.approx(1499.5)


def test_ranks_equal_pandas(spark):
    pdf = hot(spark).toPandas().dropna()
    want = pdf.assign(r=pdf["x"].rank()).drop_duplicates("x").set_index("x")["r"]
    got = ranking.average_ranks(hot(spark), "x").toPandas().set_index("x")["avg_rank"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_quantile_bins_equal_qcut(spark):
    pdf = hot(spark).toPandas().dropna()
    for bins in (10, 3):
        got = split.add_quantile_bin(hot(spark), "x", bins).filter("x is not null").orderBy("id").toPandas()["bin"]
        want = pd.qcut(pdf.sort_values("id")["x"], bins, labels=False, duplicates="drop")
        assert got.tolist() == want.tolist()
    ties = spark.createDataFrame([(float(v),) for v in [0] * 60 + list(range(40))], "x double")
    got = split.add_quantile_bin(ties, "x").orderBy("x").toPandas()["bin"].tolist()
    want = pd.qcut(pd.Series(sorted([0] * 60 + list(range(40)))), 10, labels=False, duplicates="drop").tolist()
    assert got == want


def test_empty_input(spark):
    empty = hot(spark).filter("id < 0")
    assert ranking.exact_quantiles(empty, "x", [0.5]).first()["quantiles"] == [None]
    assert split.add_quantile_bin(empty, "x").count() == 0
    assert split.minmax(hot(spark).withColumn("c", F.lit(2.0)), "c", "s").agg(F.max("s")).first()[0] == 2.0
