"""Ensembles grown over cells against MLlib's boosted trees and plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridsieve.operators import boosting, forest, learn

NAMES = ["a", "b", "c"]
PARAMS = {"maxIter": 5, "maxDepth": 4, "stepSize": 0.3}


@pytest.fixture(scope="module")
def data(spark):
    """Few values per feature, so that MLlib's bins are the values."""
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 20, 3000) / 4, rng.integers(0, 9, 3000), rng.choice([0.0, 1.0, 5.0], 3000, p=[0.01, 0.01, 0.98])])
    y = 7 + np.sin(x[:, 0]) * x[:, 1] + x[:, 2] + rng.normal(0, 0.2, 3000)
    pdf = pd.DataFrame(x, columns=NAMES).assign(y=y, w=rng.uniform(0.2, 1, 3000), id=range(3000), fold=np.arange(3000) % 3)
    return pdf, spark.createDataFrame(pdf).repartition(4)


def slots(n):
    return [(F.col("fold") == k).cast("int") for k in range(n)]


@pytest.mark.parametrize("rows", [1, 40])
def test_trees_are_those_of_the_library(data, rows):
    pdf, df = data
    cells = boosting.bin_rows(df, NAMES, "y", slots(3), "w")
    plans = [boosting.Plan([s for s in range(3) if s != k], k, minInstancesPerNode=rows, **PARAMS) for k in range(3)]
    forests, held = boosting.grow_all(cells, plans)
    x = pdf[NAMES].to_numpy()
    for k, (trees, sums) in enumerate(zip(forests, held, strict=True)):
        model = learn.fit_gbt(df.filter(F.col("fold") != k), NAMES, "y", "w", minInstancesPerNode=rows, **PARAMS)
        want = model.transform(df).select("id", "prediction").toPandas().sort_values("id")["prediction"].to_numpy()
        out = (pdf["fold"] == k).to_numpy()
        # equally good splits part the same training rows, but may part others differently
        np.testing.assert_allclose(trees.predict(x)[~out], want[~out], rtol=1e-9)
        error = ((pdf["y"] - trees.predict(x)) ** 2)[out]
        assert sums == pytest.approx((pdf["w"][out].sum(), (pdf["w"][out] * error).sum(), error.sum()), rel=1e-8)
        assert boosting.r2(sums, cells.sst()[k]) == pytest.approx(1 - error.sum() / ((pdf["y"][out] - pdf["y"][out].mean()) ** 2).sum(), rel=1e-8)


def test_copies_of_rows_make_no_more_cells_and_the_same_trees(spark, data):
    _, df = data
    fits = []
    for times in (1, 5):
        copies = df.crossJoin(spark.range(times).select(F.col("id").alias("copy")))
        cells = boosting.bin_rows(copies, NAMES, "y", [F.lit(1)], "w")
        fits.append((cells.table.count(), boosting.grow_all(cells, [boosting.Plan([0], **PARAMS)])[0][0]))
    assert fits[0][0] == fits[1][0] <= 20 * 9 * 3
    np.testing.assert_array_equal(fits[0][1].threshold, fits[1][1].threshold)
    np.testing.assert_allclose(fits[0][1].value, fits[1][1].value, rtol=1e-9, atol=1e-9)


def test_margins_made_anew_change_nothing(data):
    pdf, df = data
    cells = boosting.bin_rows(df, NAMES, "y", [F.lit(1)], "w")
    plan = boosting.Plan([0], maxIter=7, maxDepth=3, stepSize=0.2, subsamplingRate=0.6, featureSubsetStrategy="0.5")
    got = []
    for block in (2, 100):
        for done, _, grown in boosting.grow(cells, [plan], block):
            if done:
                got.append(grown(0).predict(pdf[NAMES].to_numpy()))
    np.testing.assert_allclose(got[0], got[1], rtol=1e-9)


def test_many_values_are_cut_into_equal_counts(spark):
    df = spark.range(5000).select((F.col("id") * 1.0).alias("a"), F.lit(3.0).alias("b"), F.col("id").cast("double").alias("y"))
    cuts, none = boosting.bin_edges(df, ["a", "b"])
    assert len(cuts) == 31 and not len(none)
    assert np.abs(np.diff(np.r_[-1, cuts, 4999]) - 5000 / 32).max() < 10


def test_missing_numbers_are_an_error(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0)], "a double, y double")
    with pytest.raises(Exception, match="must be numbers"):
        boosting.bin_rows(df, ["a"], "y", [F.lit(1)])


def test_boost_fits_no_model_per_block(spark, data, monkeypatch):
    """Rounds need no fit of the library, whose overhead per tree alone took i2_gbt_early_stopping beyond its limit."""
    from pyspark.ml.regression import GBTRegressor

    def refuse(*_):
        raise AssertionError("fitted by the library")

    monkeypatch.setattr(GBTRegressor, "fit", refuse)
    fit = forest.boost(data[1], NAMES, "y", F.col("id"), "w", max_rounds=4, patience=3, maxDepth=3, stepSize=0.3)
    assert len(fit.curve) == fit.rounds_used == 4 and all(type(e) is float for e in fit.curve)


def test_search_and_folds_grow_from_cells(spark, data, monkeypatch):
    """Trials and folds need no fit of the library, each of which scanned all rows per level."""
    from pyspark.ml.regression import GBTRegressor

    pdf, df = data
    want = {}
    for k in range(3):
        model = learn.fit_gbt(df.filter(F.col("fold") != k), NAMES, "y", "w", **PARAMS)
        want[k] = learn.metrics.regression_metrics(model.transform(df.filter(F.col("fold") == k)), "y", "prediction").first().r2_log

    def refuse(*_):
        raise AssertionError("fitted by the library")

    monkeypatch.setattr(GBTRegressor, "fit", refuse)
    table, whole = learn.boosted_cv(df, NAMES, "y", "fold", "w", whole=True, **PARAMS)
    assert {r.fold: r.r2 for r in table.collect()} == pytest.approx(want, abs=0.01)
    assert len(whole) == PARAMS["maxIter"]
    trials = [PARAMS, dict(PARAMS, maxIter=2, subsamplingRate=0.7, featureSubset=0.6, minInstancesPerNode=9)]
    found = {r.trial: r["mean"] for r in learn.search_gbt(df, NAMES, "y", "fold", trials, "w").collect()}
    assert found[0] == pytest.approx(np.mean(list(want.values())), abs=0.01) and 0.3 < found[1] < found[0]


def test_bootstrap_members_are_weighted_fits(spark, data):
    """Members grow from one table of cells, as the library would fit them on weighted rows."""
    pdf, df = data
    got = forest.bootstrap_forests(df, NAMES, "y", F.col("id"), 2, maxIter=3, maxDepth=3, stepSize=0.5)
    fit = lambda part, w: learn.fit_gbt(part, NAMES, "y", w, maxIter=3, maxDepth=3, stepSize=0.5)
    x = pdf[NAMES].to_numpy()
    for trees, model in zip(got, learn.bootstrap_models(df, F.col("id"), fit, 2), strict=True):
        want = forest.read_forest(spark, model, NAMES).predict(x)
        assert np.quantile(np.abs(trees.predict(x) - want), 0.98) < 1e-6
    assert np.abs(got[0].predict(x) - got[1].predict(x)).max() > 1e-3
