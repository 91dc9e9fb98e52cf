"""Tree members, patience, the search ledger and sampled attribution against plain computations."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridsieve.operators import attribution, ensemble, forest, learn, ridge
from gridsieve.queries import QUERIES
from gridsieve.session import new_path
from gridsieve.sources.sinks import is_written

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (600, 3))
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0) * x[:, 2] + rng.normal(0, 0.3, 600)
    pdf = pd.DataFrame(x, columns=NAMES).assign(y=y, w=rng.uniform(0.2, 1, 600), id=range(600), fold=np.arange(600) % 3)
    return pdf, spark.createDataFrame(pdf).repartition(4)


@pytest.fixture(scope="module")
def fitted(spark, data):
    model = learn.fit_gbt(data[1], NAMES, "y", "w", maxIter=6, maxDepth=3, stepSize=0.5)
    return model, forest.read_forest(spark, model, NAMES)


def test_arrays_predict_as_the_library(data, fitted):
    pdf, df = data
    model, trees = fitted
    want = model.transform(df).select("id", "prediction").toPandas().sort_values("id")["prediction"].to_numpy()
    np.testing.assert_allclose(trees.predict(pdf[NAMES].to_numpy()), want, rtol=1e-12)
    got = trees.transform(df).select("id", "prediction").toPandas().sort_values("id")["prediction"].to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-12)
    assert len(trees.first(2)) == 2 and len(trees.first(2).plus(trees)) == 8


def test_members_are_scored_in_one_scan(spark, data, fitted):
    pdf, df = data
    line = ridge.RidgeFit(["b"], np.array([2.0]), 1.0)
    scored = forest.with_predictions(df.select("id", *NAMES), [fitted[1], line])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" not in plan
    got = np.array([r.preds for r in scored.orderBy("id").collect()])
    np.testing.assert_allclose(got[:, 1], 1 + 2 * pdf["b"], rtol=1e-12)
    q = ensemble.quantile_columns(scored, "preds", (0.0, 0.25, 1.0), ("lo", "q", "hi")).orderBy("id").toPandas()
    np.testing.assert_allclose(q["q"], np.quantile(got, 0.25, axis=1), rtol=1e-9)
    d = scored.select("id", ensemble.array_disagreement().alias("d")).orderBy("id").toPandas()["d"]
    np.testing.assert_allclose(d, got.std(axis=1), rtol=1e-9, atol=1e-12)


def test_calibration_equals_the_long_form(spark, data, fitted):
    _, df = data
    members = [fitted[1], fitted[1].first(3), ridge.RidgeFit(["a"], np.array([0.5]), 0.2)]
    scored = forest.with_predictions(df.select("id", "y", *NAMES), members)
    long = learn.member_predictions(df.select("id", "y", *NAMES), members, ["id", "y"])
    want = ensemble.calibration_curve(long, ["id"], "y", n_levels=5).orderBy("nominal").collect()
    got = ensemble.array_calibration(scored, "y", n_levels=5).orderBy("nominal").collect()
    assert [tuple(r) for r in got] == [pytest.approx(tuple(r)) for r in want]


def test_stop_round():
    assert forest.stop_round([5, 4, 3, 4, 4, 2], 2) == (3, 5, True)
    assert forest.stop_round([5, 4, 3, 4], 2) == (3, 4, False)
    assert forest.stop_round([1, 1, 1], 2) == (1, 3, True)


def test_boosting_follows_its_curve(spark, data):
    pdf, df = data
    fits = [
        forest.boost(df, NAMES, "y", F.col("id"), "w", max_rounds=60, patience=6, block=block, eval_share=0.3, maxDepth=4, stepSize=0.6)
        for block in (4, 60)
    ]
    for fit in fits:
        assert fit.best_round == 1 + int(np.argmin(fit.curve)) and len(fit.curve) == fit.rounds_used <= 60
        assert fit.rounds_used == 60 or fit.rounds_used - fit.best_round == 6
        assert len(fit.forest) == fit.best_round and len(fit.every) == fit.rounds_used
        x = pdf[NAMES].to_numpy()
        np.testing.assert_allclose(fit.forest.predict(x), fit.every.first(fit.best_round).predict(x))
    held = forest.hash_split(df, F.col("id"), 0.3, 42).filter("split = 'test'").toPandas()
    fit = fits[0]
    for k in (1, 5, fit.rounds_used):
        error = held["y"] - fit.every.first(k).predict(held[NAMES].to_numpy())
        assert fit.curve[k - 1] == pytest.approx((held["w"] * error**2).sum() / held["w"].sum(), rel=1e-9)


def test_search_goes_on_where_it_was(spark, data):
    _, df = data
    folder, space = new_path(spark, "t-search"), dict(learn.SEARCH_SPACE, maxIter=(2, 3, "int"), maxDepth=(2, 3, "int"))
    trials = learn.sample_params(3, space=space)
    learn.search_gbt(df, NAMES, "y", "fold", trials[:1], "w", folder=folder)
    before = {tuple(r) for r in spark.read.parquet(f"{folder}/ledger").collect()}
    found = learn.search_gbt(df.limit(0), NAMES, "y", "fold", trials, "w", parallelism=3, folder=folder).collect()
    ledger = [tuple(r) for r in spark.read.parquet(f"{folder}/ledger").collect()]
    assert before <= set(ledger) and len(ledger) == 9 and is_written(spark, f"{folder}/folds")
    assert [r.n_folds for r in found] == [3] * 3 and sorted(r["mean"] for r in found)[::-1] == [r["mean"] for r in found]
    fresh = learn.search_gbt(df, NAMES, "y", "fold", trials, "w").collect()
    assert {r.trial: r["mean"] for r in fresh} == pytest.approx({r.trial: r["mean"] for r in found})


def test_sampled_values_are_shapley_values(spark, data, fitted):
    """All orders of three features, each with its reverse, give the exact values on average; sums are exact always."""
    pdf, df = data
    trees = fitted[1]
    base = attribution.background_rows(df, NAMES, F.col("id"), 5)
    few = df.filter("id < 40")
    got = attribution.sampled_contributions(few, ["id"], trees, base, F.col("id")).toPandas()
    sums = got.groupby("id")["phi"].sum().to_numpy()
    x = pdf[NAMES].to_numpy()[:40]
    np.testing.assert_allclose(sums, trees.predict(x) - trees.predict(base).mean(), rtol=1e-9, atol=1e-9)

    def exact(row, b):
        phi = np.zeros(3)
        for order in itertools.permutations(range(3)):
            z = b.copy()
            for j in order:
                before = trees.predict(z[None])[0]
                z[j] = row[j]
                phi[j] += trees.predict(z[None])[0] - before
        return phi / math.factorial(3)

    many = np.repeat(base, 30, axis=0)
    sampled = attribution.sampled_contributions(few.filter("id < 5"), ["id"], trees, many, F.col("id")).toPandas()
    for i in range(5):
        want = np.mean([exact(x[i], b) for b in base], axis=0)
        mine = sampled[sampled["id"] == i].set_index("feature").loc[NAMES, "phi"].to_numpy()
        np.testing.assert_allclose(mine, want, atol=0.12)
    again = attribution.sampled_contributions(few.repartition(3, "a"), ["id"], trees, base, F.col("id")).toPandas()
    pd.testing.assert_frame_equal(got.sort_values(["id", "feature"], ignore_index=True), again.sort_values(["id", "feature"], ignore_index=True))


def test_sampled_values_of_tables_and_of_paths_are_the_same(spark, data, fitted, monkeypatch):
    """Mixtures are looked up, not scored one by one; a tree whose table would be too large is scored."""
    _, df = data
    trees = fitted[1]
    base = attribution.background_rows(df, NAMES, F.col("id"), 5)
    few = df.filter("id < 300").withColumn("a", F.when(F.col("id") != 7, F.col("a")))
    path = new_path(spark, "t-phi")
    looked_up = attribution.sampled_contributions(few, ["id"], trees, base, F.col("id"), path=path).toPandas()
    wide = spark.read.parquet(path)
    assert wide.columns == ["id", "value", "phi"] and wide.count() == few.count()
    scored = []
    monkeypatch.setattr(forest, "predictions", lambda *a: scored.append(1))
    parts = attribution._steps(trees, base)
    x, keys = np.random.default_rng(2).normal(size=(50, 3)), np.arange(50)
    found = attribution._from_steps(parts, x, keys, len(base))
    monkeypatch.undo()
    assert not scored
    np.testing.assert_allclose(found, attribution._from_paths(trees, base, x, keys), atol=1e-12)
    monkeypatch.setattr(attribution, "TABLE", 8)
    assert attribution._steps(trees, base) is None
    walked = attribution.sampled_contributions(few, ["id"], trees, base, F.col("id")).toPandas()
    assert walked["value"].isna().sum() == 1
    pd.testing.assert_frame_equal(*(t.sort_values(["id", "feature"], ignore_index=True) for t in (looked_up, walked)), rtol=1e-9, atol=1e-12)


def test_sampled_shapley_query_shuffles_no_row(spark, sf_dir, monkeypatch):
    """The values of a row are summed where they lie: only totals are exchanged once they are made."""
    plans, made, frame = [], attribution.sampled_contributions, type(spark.range(1))
    first = frame.first

    def noted(*a, **k):
        plans.append(None)
        return made(*a, **k)

    def seen(df):
        if plans:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return first(df)

    monkeypatch.setattr(attribution, "sampled_contributions", noted)
    monkeypatch.setattr(frame, "first", seen)
    assert all(r.holds for r in QUERIES["i17_sampled_shapley"](spark, sf_dir).collect())
    texts = [p for p in plans if p]
    assert texts and not any("row_key" in line for p in texts for line in p.splitlines() if "hashpartitioning" in line)


def test_sampled_values_of_a_line_are_exact(data):
    pdf, df = data
    line = ridge.RidgeFit(["a", "c"], np.array([3.0, -1.0]), 5.0)
    base = attribution.background_rows(df, line.features, F.col("id"), 7)
    got = attribution.sampled_contributions(df, ["id"], line, base, F.col("id")).toPandas()
    for j, name in enumerate(line.features):
        own = got[got["feature"] == name].sort_values("id")["phi"].to_numpy()
        np.testing.assert_allclose(own, line.coefficients[j] * (pdf[name] - base[:, j].mean()), rtol=1e-9, atol=1e-9)


def test_explained_variance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) * [5, 2, 1, 0.1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(5)
    (train,), shares = learn.pca_projection(df, "v", 2)
    values, axes = np.linalg.eigh(np.cov(x.T))
    np.testing.assert_allclose(shares, values[::-1][:2] / values.sum(), rtol=1e-9)
    got = np.array([[r.pc1, r.pc2] for r in train.orderBy("id").collect()])
    want = (x - x.mean(0)) @ axes[:, ::-1][:, :2]
    np.testing.assert_allclose(np.abs(got), np.abs(want), rtol=1e-7, atol=1e-9)
    assert learn.vector_moments(df.limit(0), "v").n == 0


def test_trees_score_as_a_walk_from_node_to_node():
    rng = np.random.default_rng(6)
    left, right = np.zeros((3, 7), int), np.zeros((3, 7), int)
    left[:], right[:] = [1, 3, 2, 3, 4, 5, 6], [2, 4, 2, 3, 4, 5, 6]  # node 2 is a leaf above the last level
    feature, threshold, value = rng.integers(0, 2, (3, 7)), rng.normal(size=(3, 7)), rng.normal(size=(3, 7))
    trees = forest.Forest(["a", "b"], feature, threshold, left, right, value, np.array([1.0, 0.5, 0.25]), 2)
    x = np.asfortranarray(rng.normal(size=(forest.ROWS + 5, 2)))
    x[4, 1] = np.nan
    want = np.empty((len(x), 3))
    for i, row in enumerate(x):
        for t in range(3):
            node = 0
            for _ in range(2):
                node = left[t, node] if row[feature[t, node]] <= threshold[t, node] else right[t, node]
            want[i, t] = value[t, node] * trees.weights[t]
    np.testing.assert_array_equal(trees.each(x), want)
    np.testing.assert_array_equal(trees.first(2).each(x), want[:, :2])
