"""Ridge moments, MLlib fits, metrics and attribution against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridsieve.functions.hashing import member_poisson
from gridsieve.operators import attribution, ensemble, learn, metrics, ridge
from gridsieve.operators.candidates import candidate_grid

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal([0, 100, 5], [1, 3, 0.5], (500, 3))
    y = x @ [1.0, -0.2, 2.0] + rng.normal(0, 0.5, 500) + 30
    pdf = pd.DataFrame(x, columns=NAMES).assign(y=y, w=rng.uniform(0.1, 1, 500), id=range(500), fold=np.arange(500) % 5)
    return pdf, spark.createDataFrame(pdf).repartition(4)


def closed_form(x, y, w, alpha=1.0):
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    xc, yc = x - mx, y - my
    beta = np.linalg.solve(xc.T @ (xc * w[:, None]) + alpha * np.eye(x.shape[1]), xc.T @ (w * yc))
    return beta, my - mx @ beta


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_ridge_equals_closed_form_and_mllib(data):
    pdf, df = data
    beta, bias = closed_form(pdf[NAMES].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
    mom = ridge.moments(df, NAMES, "y", "w")
    fit = ridge.solve(mom, mom.total())
    np.testing.assert_allclose(fit.coefficients, beta, rtol=1e-9)
    assert fit.intercept == pytest.approx(bias, rel=1e-9)
    lr = learn.fit_ridge(df, NAMES, "y", "w").stages[-1]
    np.testing.assert_allclose(lr.coefficients.toArray(), beta, rtol=1e-6)


def test_cross_validation_and_ablation(data):
    pdf, df = data

    def fold_scores(cols):
        out = []
        for k in range(5):
            tr, va = pdf[pdf["fold"] != k], pdf[pdf["fold"] == k]
            beta, bias = closed_form(tr[cols].to_numpy(), tr["y"].to_numpy(), tr["w"].to_numpy())
            out.append(r2(va["y"].to_numpy(), va[cols].to_numpy() @ beta + bias))
        return out

    got = learn.ridge_cv(df, NAMES, "y", "fold", "w").orderBy("fold").toPandas()["r2"]
    np.testing.assert_allclose(got, fold_scores(NAMES), rtol=1e-8)
    table = learn.ridge_ablation(df, "y", "fold", {"all": NAMES, "no a": ["b", "c"], "one": ["a"]}, "w").toPandas()
    assert table["model"].tolist() == ["all", "no a"]
    assert table["lomo_r2"][1] == pytest.approx(np.mean(fold_scores(["b", "c"])), rel=1e-8)
    assert table["delta_r2"][0] == 0 and table["delta_r2"][1] == pytest.approx(table["lomo_r2"][1] - table["lomo_r2"][0])


def test_bootstrap_members_and_intervals(data):
    pdf, df = data
    members = learn.bootstrap_ridge(df, NAMES, "y", F.col("id"), 6, 7)
    k = df.select("id", *[member_poisson(F.col("id"), m, 7).alias(f"k{m}") for m in range(6)]).toPandas().sort_values("id")
    preds = []
    for m, fit in enumerate(members):
        beta, bias = closed_form(pdf[NAMES].to_numpy(), pdf["y"].to_numpy(), k[f"k{m}"].to_numpy(float))
        np.testing.assert_allclose(fit.coefficients, beta, rtol=1e-8)
        preds.append(pdf[NAMES].to_numpy() @ beta + bias)
    got = learn.ensemble_interval(df, members).orderBy("id").toPandas()
    want = np.percentile(np.stack(preds), [5, 50, 95], axis=0)
    np.testing.assert_allclose(got[["pred_p05_log", "pred_median_log", "pred_p95_log"]].to_numpy().T, want, rtol=1e-9)
    long = learn.member_predictions(df, members, ["id"])
    q = ensemble.ensemble_quantiles(long, ["id"]).orderBy("id").toPandas()
    np.testing.assert_allclose(q["median"], want[1], rtol=1e-9)
    exploded = ensemble.poisson_bootstrap(df.select("id"), F.col("id"), 6, 7).groupBy("member").agg(F.sum("boot_weight").alias("n"))
    assert {r["member"]: r["n"] for r in exploded.collect()} == {m: int(k[f"k{m}"].sum()) for m in range(6)}


def test_single_member_has_no_spread(spark):
    long = spark.createDataFrame([(1, 0, 2.5), (2, 0, 1.0), (2, 1, 3.0)], "row_id int, member int, pred double")
    q = ensemble.ensemble_quantiles(long, ["row_id"]).orderBy("row_id").collect()
    assert q[0]["p05"] == q[0]["median"] == q[0]["p95"] == 2.5
    d = ensemble.disagreement(long, ["row_id"]).orderBy("row_id").collect()
    assert [r["disagreement"] for r in d] == [0.0, 1.0]


def test_conformal_covers_fresh_rows(spark, data):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (20_000, 3))
    pdf = pd.DataFrame(x, columns=NAMES).assign(y=x @ [1.0, 2.0, 0.0] + rng.standard_t(4, 20_000), id=range(20_000))
    df = spark.createDataFrame(pdf)

    def fit(part):
        mom = ridge.moments(part, NAMES, "y")
        return ridge.solve(mom, mom.total())

    fitted, q = learn.split_conformal(df.filter("id < 14000"), F.col("id"), fit, "y", 0.1)
    q = q.first()
    inside = fitted.transform(df.filter("id >= 14000")).agg(
        F.avg((F.abs(F.col("y") - F.col("prediction")) <= q["q_hat"]).cast("double"))
    ).first()[0]
    # both the calibration and the test sample are random
    se = np.sqrt(0.09 / 6000 + 0.09 / q["n_cal"])
    assert abs(inside - 0.9) <= 3 * se
    with pytest.raises(ValueError):
        learn.given_model_conformal(data[1], fitted, "y")


def test_spearman_and_metrics_equal_pandas(data, spark):
    pdf, df = data
    tied = df.withColumn("p", F.round("y", 0))
    got = metrics.spearman(tied, "y", "p").first()
    assert got["rho"] == pytest.approx(pdf["y"].rank().corr(pdf["y"].round(0).rank()), rel=1e-4)
    m = metrics.regression_metrics(spark.createDataFrame([(1.0, 1.5), (2.0, 1.5), (3.0, 3.5)], "y double, p double"), "y", "p").first()
    assert m["r2_log"] == pytest.approx(1 - 0.75 / 2) and m["mae_log"] == pytest.approx(0.5)


def test_spearman_of_millions_of_rows(spark):
    """The cube of the row count is beyond a long."""
    df = spark.range(2_400_000).select((F.col("id") % 12).cast("double").alias("y"), (F.col("id") % 4).cast("double").alias("p"))
    one = pd.DataFrame({"y": np.arange(12.0), "p": np.arange(12) % 4})
    got = metrics.spearman(df, "y", "p").first()
    assert got["n_rows"] == 2_400_000
    assert got["rho"] == pytest.approx(one["y"].rank().corr(one["p"].rank()), rel=1e-9)


def test_encoding_comparison_of_millions_of_test_rows(spark):
    x = F.col("id") % 8
    df = spark.range(2_200_000).select(x.cast("double").alias("x"), (x * x).cast("double").alias("te"), (x * 3).cast("double").alias("y"), (F.col("id") % 5).alias("fold"))
    got = learn.encoding_comparison(df.filter("id < 1000"), df, "y", "fold", {"plain": ["x"], "both": ["x", "te"]}).collect()
    assert [row["spearman_rho"] for row in got] == pytest.approx([1.0, 1.0], rel=1e-9)


def test_published_selection_scores(spark):
    rows = [("A", 0.7738520771636284, 0.5269478146884539), ("B", 0.7737961292545068, 0.4346422342309064),
            ("C", 0.4191775100326985, -0.08609051860769612)]
    scored = metrics.composite_scores(spark.createDataFrame(rows, "model string, g double, t double"), "g", "t")
    got = {r["model"]: round(r["composite"], 4) for r in scored.collect()}
    assert got == {"A": 0.6751, "B": 0.6381, "C": 0.2515}
    assert metrics.select_best(scored).first()["model"] == "A"


def test_learning_curve_full_fraction_equals_cv(data):
    _, df = data
    curve = learn.ridge_learning_curve(df, NAMES, "y", "fold", F.col("id"), [0.3, 1.0])
    full = curve.filter("fraction = 1.0").orderBy("fold").toPandas()
    cv = learn.ridge_cv(df, NAMES, "y", "fold").orderBy("fold").toPandas()
    np.testing.assert_allclose(full["validation_r2"], cv["r2"], rtol=1e-9)
    assert (full["n_train"] == 400).all() and curve.count() == 10


def test_contributions_sum_to_prediction(data):
    pdf, df = data
    betas = dict(zip(NAMES, [1.0, -0.2, 2.0]))
    phi = attribution.linear_contributions(df, ["id"], betas)
    total = phi.groupBy("id").agg(F.sum("phi").alias("s")).orderBy("id").toPandas()["s"]
    lin = pdf[NAMES].to_numpy() @ list(betas.values())
    np.testing.assert_allclose(total, lin - lin.mean(), atol=1e-9)
    perm = attribution.permutation_importance(
        df, NAMES, "y", ridge.RidgeFit(NAMES, np.array([1.0, 0.0, 2.0]), 0.0), F.col("id")
    ).toPandas().set_index("feature")["drop"]
    assert perm["b"] == pytest.approx(0, abs=1e-9) and perm["a"] > 0.05


def test_boosted_trees_learn(data):
    _, df = data
    fitted = learn.fit_gbt(df, NAMES, "y", "w", F.col("id"), maxIter=5, maxDepth=3, stepSize=0.5)
    assert fitted.transform(df).agg(metrics.r2_expr("y", "prediction")).first()[0] > 0.5
    models = learn.bootstrap_models(
        df, F.col("id"), lambda part, w: learn.fit_gbt(part, NAMES, "y", w, maxIter=1, maxDepth=2), 2
    )
    assert learn.member_predictions(df, models, ["id"]).count() == 1000


def test_pca_explains_and_centres(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(50, 1, (200, 3)) * [5, 1, 0.1]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "id long, v array<double>")
    (train, same), shares = learn.pca_projection(df, "v", 2, [df])
    u, s, vt = np.linalg.svd(m - m.mean(0), full_matrices=False)
    np.testing.assert_allclose(shares, (s ** 2 / (s ** 2).sum())[:2], rtol=1e-9)
    got = train.orderBy("id").toPandas()[["pc1", "pc2"]].to_numpy()
    np.testing.assert_allclose(np.abs(got), np.abs((m - m.mean(0)) @ vt[:2].T), atol=1e-8)
    assert same.orderBy("id").toPandas()["pc1"].tolist() == pytest.approx(got[:, 0].tolist())


def test_grid_is_the_product_of_the_lists(spark):
    lists = {"a": ["x", "y"], "b": [1.0, 2.0, 3.0], "c": ["p"]}
    rows = candidate_grid(spark, lists).orderBy("row_id").collect()
    assert [(r["a"], r["b"], r["c"]) for r in rows] == [(a, b, c) for a in lists["a"] for b in lists["b"] for c in lists["c"]]
    with pytest.raises(ValueError):
        candidate_grid(spark, {"a": []})


def test_row_quantiles_and_counts_equal_the_column_forms(spark):
    from gridsieve.functions.hashing import poisson1_counts, poisson1_hex

    rng = np.random.default_rng(2)
    m = rng.normal(0, 1, (6, 7))
    m[0, 3] = np.nan
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "i int, preds array<double>")
    want = ensemble.quantile_columns(df).orderBy("i").select("p05", "median", "p95").toPandas().to_numpy()
    np.testing.assert_array_equal(ensemble.row_quantiles(m, (0.05, 0.5, 0.95)), want)
    words = [f"{x:08x}" for x in [0, 1 << 31, (1 << 32) - 1, 4294967293, 4294967292, *rng.integers(0, 1 << 32, 59).tolist()]]
    hexes = spark.createDataFrame([(w,) for w in words], "w string").select(poisson1_hex(F.col("w"))).collect()
    assert poisson1_counts(["".join(words)], 62)[0].tolist() == [r[0] for r in hexes][:62]


def test_moments_read_plain_columns(data):
    """An array column reaches a Python task as an object per row, which was most of i6_leaderboard's scans."""
    partials, _ = ridge._partials(data[1], NAMES, "y", "w", ["fold"])
    plan = partials._jdf.queryExecution().analyzed().toString()
    assert "MapInPandas" in plan and "array(" not in plan
