"""Model-based tables: fits, cross-validation, search, leaderboard, conformal and bootstrap intervals."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from gridsieve.functions import ranking
from gridsieve.functions.hashing import member_poisson
from gridsieve.functions.scalars import expm1_clipped
from gridsieve.operators import boosting, ensemble, forest, metrics, ridge
from gridsieve.operators.split import hash_split, learning_subsets
from gridsieve.session import ensure_checkpoint_dir, new_path
from gridsieve.sources.sinks import is_written, load_state, save_state

# Search ranges (low, high, scale).
SEARCH_SPACE = {
    "maxIter": (200, 1000, "int"),
    "maxDepth": (3, 7, "int"),
    "stepSize": (0.01, 0.2, "log"),
    "subsamplingRate": (0.6, 1.0, "float"),
    "featureSubset": (0.5, 1.0, "float"),
    "minInstancesPerNode": (5, 50, "int"),
}


def with_vector(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Numeric columns assembled to an ML vector."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def fit_ridge(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, alpha: float = 1.0) -> PipelineModel:
    """Weighted ridge as an MLlib pipeline (saveable), for the objective sum w (y - xb)^2 + alpha |b|^2.

    MLlib averages the loss and scales the label, hence the rescaled penalty.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    s = df.agg(F.sum(w).alias("w"), F.sum(w * y).alias("m"), F.sum(w * y * y).alias("q")).first()
    mean = s["m"] / s["w"]
    sd = max(s["q"] / s["w"] - mean * mean, 0.0) ** 0.5
    lr = LinearRegression(
        featuresCol="features", labelCol=label, predictionCol="prediction", solver="normal", standardization=False,
        elasticNetParam=0.0, regParam=alpha * sd / s["w"],
    )
    if weight:
        lr = lr.setWeightCol(weight)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return PipelineModel([assembler, lr.fit(assembler.transform(df))])


def fit_gbt(
    df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, key: Column | None = None,
    eval_share: float = 0.10, seed: int = 42, tol: float = 0.01, **params,
) -> PipelineModel:
    """Weighted boosted trees; with a key, a hashed evaluation share stops training early."""
    ensure_checkpoint_dir(df.sparkSession)
    gbt = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="prediction", seed=seed, **params)
    if weight:
        gbt = gbt.setWeightCol(weight)
    if key is not None:
        df = hash_split(df, key, eval_share, seed, out="_part").withColumn("_eval", F.col("_part") == "test")
        gbt = gbt.setValidationIndicatorCol("_eval").setParams(validationTol=tol)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return PipelineModel([assembler, gbt.fit(assembler.transform(df))])


def _score_frame(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def ridge_cv(
    df: DataFrame, features: Sequence[str], label: str, fold: str, weight: str | None = None, alpha: float = 1.0,
    model: str = "Ridge",
) -> DataFrame:
    """(model, fold, r2) for held-out folds (random or whole groups) from one pass over the data."""
    scores = ridge.cv_table(df, label, fold, {model: list(features)}, weight, alpha)
    return scores.select("model", F.col(fold).cast("int").alias("fold"), "r2")


def model_cv(
    df: DataFrame, label: str, fold: str, fit: Callable[[DataFrame], Model], model: str, parallelism: int = 2
) -> DataFrame:
    """(model, fold, r2) for any estimator: the input is cached once, folds fit in a small thread pool."""
    data = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        folds = [row[0] for row in data.select(fold).distinct().orderBy(fold).collect()]

        def one(k):
            fitted = fit(data.filter(F.col(fold) != k))
            held = fitted.transform(data.filter(F.col(fold) == k))
            return model, int(k), held.agg(metrics.r2_expr(label, "prediction")).first()[0]

        with ThreadPoolExecutor(parallelism) as pool:
            scores = list(pool.map(one, folds))
    finally:
        data.unpersist()
    return _score_frame(df.sparkSession, scores, "model string, fold int, r2 double")


def sample_params(n_trials: int, seed: int = 42, space: Mapping = SEARCH_SPACE) -> list[dict]:
    """Random draws from the search ranges."""
    rng = random.Random(seed)
    trials = []
    for _ in range(n_trials):
        draw = {}
        for name, (lo, hi, kind) in space.items():
            if kind == "int":
                draw[name] = rng.randint(lo, hi)
            elif kind == "log":
                draw[name] = float(np.exp(rng.uniform(np.log(lo), np.log(hi))))
            else:
                draw[name] = rng.uniform(lo, hi)
        trials.append(draw)
    return trials


def search_gbt(
    df: DataFrame, features: Sequence[str], label: str, fold: str, trials: Sequence[Mapping],
    weight: str | None = None, seed: int = 42, parallelism: int = 2, folder: str | None = None,
) -> DataFrame:
    """Mean held-out R2 per trial, best first: (trial, params, n_folds, mean, std).

    The fold table is written once below ``folder``, where every (trial, fold) score is appended as soon as it is known.
    A search started again with the same folder reads the written table and fits only what the ledger lacks. The table is
    summed to cells once for all trials and folds, and ``parallelism`` trials with all their folds grow side by side.
    """
    spark = df.sparkSession
    folder = folder or new_path(spark, "search")
    table, ledger = f"{folder}/folds", f"{folder}/ledger"
    columns = [*dict.fromkeys([*features, label, fold, *([weight] if weight else [])])]
    data = load_state(spark, table) if is_written(spark, table) else save_state(df.select(*columns), table)
    schema = "trial int, params string, fold int, r2 double"
    runs = []
    for i, trial in enumerate(trials):
        params = {k: v for k, v in trial.items() if k != "featureSubset"}
        if "featureSubset" in trial:
            params["featureSubsetStrategy"] = str(round(trial["featureSubset"], 4))
        runs.append((i, str(dict(sorted(params.items()))), params))
    folds = [row[0] for row in data.select(fold).distinct().orderBy(fold).collect()]
    # folds x trials rows
    known = spark.read.schema(schema).parquet(ledger).collect() if is_written(spark, ledger) else []
    done = {(r.trial, r.params, r.fold) for r in known}
    todo = [(run, at) for run in runs for at, k in enumerate(folds) if (run[0], run[1], int(k)) not in done]
    cells = boosting.bin_rows(data, features, label, [F.col(fold).eqNullSafe(F.lit(k)).cast("int") for k in folds], weight) if todo else None
    sst = cells.sst() if todo else []
    together = max(1, parallelism * len(folds))
    for start in range(0, len(todo), together):
        part = todo[start : start + together]
        plans = [boosting.Plan([s for s in range(len(folds)) if s != at], at, seed=seed, **run[2]) for run, at in part]
        for ended, held, _ in boosting.grow(cells, plans):
            scores = [(part[j][0][0], part[j][0][1], int(folds[part[j][1]]), boosting.r2(held[j], sst[part[j][1]])) for j in ended]
            if scores:  # scores are appended whole or not at all
                _score_frame(spark, scores, schema).coalesce(1).write.mode("append").parquet(ledger)
    wanted = _score_frame(spark, [(i, name) for i, name, _ in runs], "trial int, params string")
    scores = spark.read.schema(schema).parquet(ledger).join(wanted, ["trial", "params"])
    return metrics.cv_summary(scores, ["trial", "params"]).orderBy(F.desc("mean"), "trial")


def boosted_cv(
    df: DataFrame, features: Sequence[str], label: str, fold: str, weight: str | None = None, model: str = "GBT", seed: int = 42,
    whole: bool = False, **params,
) -> tuple[DataFrame, forest.Forest | None]:
    """(model, fold, r2) of boosted trees for held-out folds, and with ``whole`` the trees fitted on all of them.

    The written table ``df`` is summed to cells once, and all fits grow side by side.
    """
    folds = [row[0] for row in df.select(fold).distinct().orderBy(fold).collect()]
    every = range(len(folds))
    cells = boosting.bin_rows(df, features, label, [F.col(fold).eqNullSafe(F.lit(k)).cast("int") for k in folds], weight)
    plans = [boosting.Plan([s for s in every if s != at], at, seed=seed, **params) for at in every]
    plans += [boosting.Plan(list(every), seed=seed, **params)] if whole else []
    forests, held = boosting.grow_all(cells, plans)
    scores = [(model, int(k), boosting.r2(sums, total)) for k, sums, total in zip(folds, held, cells.sst())]
    return _score_frame(df.sparkSession, scores, "model string, fold int, r2 double"), forests[-1] if whole else None


def leaderboard(
    test: DataFrame, label: str, models: Mapping[str, Model], cv: DataFrame, group_cv: DataFrame
) -> DataFrame:
    """One row per model: CV and group-CV mean/std, test metrics and the selection score."""
    out = None
    for name, fitted in models.items():
        row = metrics.regression_metrics(fitted.transform(test), label, "prediction").withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    for table, prefix in ((cv, "cv"), (group_cv, "group_cv")):
        summary = metrics.cv_summary(table, ["model"]).select(
            "model", F.col("mean").alias(f"{prefix}_r2_mean"), F.col("std").alias(f"{prefix}_r2_std")
        )
        out = out.join(summary, "model", "left")
    return metrics.composite_scores(out, "group_cv_r2_mean", "r2_orig")


def split_conformal(
    df: DataFrame, key: Column, fit: Callable[[DataFrame], Model], label: str, alpha: float = 0.10,
    cal_share: float = 0.20, seed: int = 12,
) -> tuple[Model, DataFrame]:
    """(model fitted on the proper training part, q_hat row from the held-out calibration part)."""
    parts = hash_split(df, key, cal_share, seed, out="_cal")
    fitted = fit(parts.filter(F.col("_cal") == "train").drop("_cal"))
    scored = fitted.transform(parts.filter(F.col("_cal") == "test").drop("_cal"))
    return fitted, metrics.conformal_quantile(scored, label, "prediction", alpha)


def given_model_conformal(
    calibration: DataFrame, fitted: Model, label: str, alpha: float = 0.10, trained_on_calibration: bool | None = None
) -> DataFrame:
    """q_hat for an already fitted model, and whether it saw the calibration rows, which the caller must state.

    ``trained_on_calibration`` stays in the result: such a q_hat comes from residuals of training rows and under-covers.
    """
    if trained_on_calibration is None:
        raise ValueError("state trained_on_calibration: residuals of training rows under-cover")
    q = metrics.conformal_quantile(fitted.transform(calibration), label, "prediction", alpha)
    return q.withColumn("trained_on_calibration", F.lit(bool(trained_on_calibration)))


def bootstrap_ridge(
    df: DataFrame, features: Sequence[str], label: str, key: Column, n_members: int = 100, seed: int = 42,
    weight: str | None = None, alpha: float = 1.0,
) -> list[ridge.RidgeFit]:
    """All bootstrap members of a ridge ensemble from one pass."""
    mom = ridge.bootstrap_moments(df, features, label, key, n_members, seed, weight)
    return [ridge.solve(mom, mom.by_key[k], alpha) for k in sorted(mom.by_key)]


def bootstrap_models(
    df: DataFrame, key: Column, fit: Callable[[DataFrame, str], Model], n_members: int = 100, seed: int = 42,
    parallelism: int = 2,
) -> list[Model]:
    """Bootstrap members of any weighted estimator: cached input, member weights by hash, pooled fits."""
    data = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        def one(b):
            draw = member_poisson(key, b, seed)
            return fit(data.withColumn("boot_weight", draw.cast("double")).filter("boot_weight > 0"), "boot_weight")

        with ThreadPoolExecutor(parallelism) as pool:
            return list(pool.map(one, range(n_members)))
    finally:
        data.unpersist()


def ensemble_interval(
    df: DataFrame, members: Sequence[forest.Member], probs: Sequence[float] = (0.05, 0.5, 0.95),
    names: Sequence[str] = ("pred_p05_log", "pred_median_log", "pred_p95_log"),
) -> DataFrame:
    """Quantiles over linear or tree members per row: one map-only scan, whatever the number of members."""
    scored = forest.with_predictions(df, members, "_q", lambda found: ensemble.row_quantiles(found, probs))
    return scored.select(*df.columns, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def member_predictions(df: DataFrame, models: Sequence[forest.Member], row: Sequence[str]) -> DataFrame:
    """Long (row, member, pred) table of linear or tree members, from one scan."""
    scored = forest.with_predictions(df, models, "_preds")
    return scored.select(*row, F.posexplode("_preds").alias("member", "pred"))


def feature_groups(columns: Sequence[str], rules: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Columns per keyword group; a column belongs to the first group that matches its name."""
    groups: dict[str, list[str]] = {name: [] for name in rules}
    for c in columns:
        name = next((g for g, words in rules.items() if any(w.lower() in c.lower() for w in words)), None)
        if name:
            groups[name].append(c)
    return groups


def ridge_ablation(
    df: DataFrame, label: str, fold: str, variants: Mapping[str, Sequence[str]], weight: str | None = None, alpha: float = 1.0
) -> DataFrame:
    """Held-out R2 per feature variant (at least two features) and its delta to the first variant.

    All variants are sub-matrices of the same moments: the data is read once.
    """
    usable = {name: list(cols) for name, cols in variants.items() if len(cols) >= 2}
    scores = ridge.cv_table(df, label, fold, usable, weight, alpha).groupBy("model").agg(
        F.avg("r2").alias("lomo_r2"), F.stddev_pop("r2").alias("lomo_std")
    )
    spark, first = df.sparkSession, next(iter(usable))
    order = _score_frame(spark, [(i, n, len(c)) for i, (n, c) in enumerate(usable.items())], "ord int, model string, n_features int")
    base = scores.filter(F.col("model") == first).agg(F.max("lomo_r2").alias("b")).scalar()
    return order.join(scores, "model").select("ord", "model", "n_features", "lomo_r2", "lomo_std", (F.col("lomo_r2") - base).alias("delta_r2"))


def ridge_learning_curve(
    df: DataFrame, features: Sequence[str], label: str, fold: str, key: Column, fractions: Sequence[float],
    alpha: float = 1.0, seed: int = 42,
) -> DataFrame:
    """(fraction, fold, n_train, train_r2, validation_r2): nested hashed subsets of each training part.

    Moments per (fold, step) are accumulated over steps, so every fraction and fold comes from one pass.
    """
    fractions = sorted(fractions)
    stepped = learning_subsets(df, key, fractions, seed, [fold])
    mom = ridge.moments(stepped, features, label, None, [fold, "step"])
    folds = sorted({k[0] for k in mom.by_key})
    rows = []
    for k in folds:
        held = mom.total([key_ for key_ in mom.by_key if key_[0] == k])
        for i, frac in enumerate(fractions):
            part = mom.total([key_ for key_ in mom.by_key if key_[0] != k and key_[1] <= i])
            if part[0, 0] > 0:
                fit = ridge.solve(mom, part, alpha)
                rows.append((float(frac), int(k), int(round(part[0, 0])), ridge.r2(mom, part, fit), ridge.r2(mom, held, fit)))
    return _score_frame(
        df.sparkSession, rows, "fraction double, fold int, n_train long, train_r2 double, validation_r2 double"
    )


def encoding_comparison(
    train: DataFrame, test: DataFrame, label: str, fold: str, strategies: Mapping[str, Sequence[str]], alpha: float = 1.0
) -> DataFrame:
    """Group-CV R2, test R2 and Spearman rho per feature set."""
    features = sorted({c for cols in strategies.values() for c in cols})
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    mom = ridge.moments(train, features, label)
    scores = ridge.cv_table(train, label, fold, strategies, alpha=alpha).groupBy("model").agg(F.avg("r2").alias("m"))
    mean_r2 = {r["model"]: r["m"] for r in scores.collect()}  # one row per strategy
    held = test.select(label, *features).persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    try:
        for name, cols in strategies.items():
            lomo = mean_r2[name]
            scored = held.withColumn("prediction", ridge.solve(mom, mom.total(), alpha, cols).column())
            r2 = scored.agg(metrics.r2_expr(label, "prediction")).first()[0]
            rho = metrics.spearman(scored, label, "prediction").first()["rho"]
            rows.append((name, lomo, r2, rho))
    finally:
        held.unpersist()
        train.unpersist()
    return _score_frame(
        train.sparkSession, rows, "encoding_strategy string, lomo_r2 double, test_r2_log double, spearman_rho double"
    )


def score(fitted: Model, df: DataFrame, out: str = "pred_log") -> DataFrame:
    """Map-only scoring with the back-transformed prediction beside it; works on streams as well."""
    kept = [c for c in df.columns]
    return fitted.transform(df).select(
        *kept, F.col("prediction").alias(out), expm1_clipped("prediction").alias(out.replace("_log", "") + "_orig")
    )


def original_scale(df: DataFrame, lo: str = "p10_log", mid: str = "p50_log", hi: str = "p90_log") -> DataFrame:
    """Interval columns back-transformed (clipped at 0) beside the logarithmic ones, and their width."""
    names = {c: c.removesuffix("_log") + "_orig" for c in (lo, mid, hi)}
    out = df.withColumns({new: expm1_clipped(c) for c, new in names.items()})
    return out.withColumns({"width_log": F.col(hi) - F.col(lo), "width_orig": F.col(names[hi]) - F.col(names[lo])})


def rank_by_prediction(scored: DataFrame, pred: str, tie: str, out: str = "rank") -> DataFrame:
    """All rows with their position by descending prediction, ties by a numeric or text key, 1 first.

    Rows without a prediction come last, NaN before numbers as in any descending sort; null keys come first among ties. Rows are
    sorted by range over (prediction, key) and written; partitions are numbered in order, so a row's position is what the
    partitions before hold plus its place in its own. A prediction shared by many rows is spread over partitions by its keys.
    """
    spark = scored.sparkSession
    order = [F.col(pred).desc_nulls_last(), F.col(tie).asc_nulls_first()]
    # sorted first, so that the ids ascend with the order; a partition's number is above its rows' places
    ranked = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return ranking.numbered(save_state(ranked, new_path(spark, "ranked")), "_at", out)


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


@dataclass
class VectorMoments:
    """Number, mean and scatter of vectors: dimensions squared numbers, whatever the rows."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    def plus(self, other: VectorMoments) -> VectorMoments:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return VectorMoments(n, self.mean + gap * (other.n / n), self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n))

    def covariance(self) -> np.ndarray:
        return self.scatter / max(1, self.n - 1)


def vector_moments(df: DataFrame, vec: str) -> VectorMoments:
    """Moments of a vector column from one scan: each task centres on its own mean, and tasks merge in pairs on the executors.

    Null vectors are left out. What a merge holds is 64 tasks' moments.
    """
    dim = df.filter(F.col(vec).isNotNull()).select(F.size(vec)).first()
    if dim is None:
        return VectorMoments(0, np.zeros(0), np.zeros((0, 0)))
    d = dim[0]
    empty = VectorMoments(0, np.zeros(d), np.zeros((d, d)))

    def pack(m: VectorMoments, at: int) -> pd.DataFrame:
        return pd.DataFrame({"at": [at], "n": [m.n], "mean": [m.mean], "scatter": [m.scatter.ravel()]})

    def unpack(pdf: pd.DataFrame) -> list[VectorMoments]:
        rows = pdf.sort_values("at")
        return [VectorMoments(int(n), np.array(m), np.array(s).reshape(d, d)) for n, m, s in zip(rows["n"], rows["mean"], rows["scatter"])]

    def scan(batches):
        whole = empty
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                mean = x.mean(0)
                whole = whole.plus(VectorMoments(len(x), mean, (x - mean).T @ (x - mean)))
        if whole.n:
            yield pack(whole, TaskContext.get().partitionId())

    schema = "at long, n long, mean array<double>, scatter array<double>"

    def merge(key, pdf):
        return pack(reduce(VectorMoments.plus, unpack(pdf), empty), int(key[0]))

    vectors = df.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"))
    parts = save_state(vectors.mapInPandas(scan, schema), new_path(df.sparkSession, "moments"))
    while parts.count() > 64:
        parts = save_state(parts.groupBy(F.floor(F.col("at") / 64).alias("next")).applyInPandas(merge, schema), new_path(df.sparkSession, "moments"))
    rows = parts.toPandas()  # at most 64 rows
    return reduce(VectorMoments.plus, unpack(rows), empty) if len(rows) else empty


def pca_projection(train: DataFrame, vec: str, k: int = 2, others: Sequence[DataFrame] = ()) -> tuple[list[DataFrame], list[float]]:
    """Projections of the training rows and further tables on the training axes, and explained shares.

    Vectors are centred on the training mean; each axis is oriented so that its largest loading is positive.
    """
    mom = vector_moments(train, vec)
    if not mom.n:
        raise ValueError("no vectors to project")
    values, axes = np.linalg.eigh(mom.covariance())
    order = np.argsort(-values, kind="stable")[:k]
    loadings = axes[:, order]
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    loadings = loadings * np.where(signs == 0, 1.0, signs)
    total = float(np.clip(values, 0, None).sum())
    shares = [float(max(v, 0.0) / total) if total else 0.0 for v in values[order]]
    centre, axis = mom.mean, loadings.T

    def projected(df):
        e = F.col(vec).cast("array<double>")
        terms = [
            F.aggregate(F.zip_with(F.zip_with(e, _numbers(centre), lambda a, b: a - b), _numbers(a), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
            for a in axis
        ]
        return df.select(*df.columns, *[t.alias(f"pc{i + 1}") for i, t in enumerate(terms)])

    return [projected(df) for df in (train, *others)], shares
