"""Regression, rank, residual, coverage and conformal metrics as partial aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsieve.functions.ranking import average_ranks, bracketed_quantiles
from gridsieve.functions.scalars import expm1_clipped
from gridsieve.session import new_path
from gridsieve.sources.sinks import save_state


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r2_expr(y: str | Column, p: str | Column) -> Column:
    """1 - SSE / SST; NULL when the observations do not vary."""
    y, p = _col(y), _col(p)
    sst = F.var_pop(y) * F.count(y)
    return F.when(sst > 0, 1 - F.sum((y - p) * (y - p)) / sst)


def regression_aggs(y: str | Column, p: str | Column) -> list[Column]:
    """R2, MAE on the log scale and R2, MAE, RMSE on the original scale (predictions clipped at 0)."""
    y, p = _col(y), _col(p)
    yo, po = F.expm1(y), expm1_clipped(p)
    return [
        F.count(y).alias("n_rows"),
        r2_expr(y, p).alias("r2_log"),
        F.avg(F.abs(y - p)).alias("mae_log"),
        r2_expr(yo, po).alias("r2_orig"),
        F.avg(F.abs(yo - po)).alias("mae_orig"),
        F.sqrt(F.avg((yo - po) * (yo - po))).alias("rmse_orig"),
    ]


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = (), min_rows: int = 1) -> DataFrame:
    """Metrics of a table of observed and predicted values, optionally per group of a minimum size."""
    out = df.groupBy(*by).agg(*regression_aggs(y, p))
    return out.filter(F.col("n_rows") >= min_rows) if min_rows > 1 else out


def spearman(df: DataFrame, y: str, p: str) -> DataFrame:
    """Rank correlation with average ranks for ties: (n_rows, rho, t_stat).

    Works on counted (y, p) pairs, so copies of a pair weigh one row in the rank joins.
    """
    pairs = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    counted = pairs.groupBy(F.col(y).alias("_y"), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_w"))
    counted = save_state(counted, new_path(df.sparkSession, "pairs"))
    ry = average_ranks(counted, "_y", weight="_w").select("_y", F.col("avg_rank").alias("_ry"))
    rp = average_ranks(counted, "_p", weight="_w").select("_p", F.col("avg_rank").alias("_rp"))
    w, a, b = F.col("_w"), F.col("_ry"), F.col("_rp")
    one = counted.join(ry, "_y").join(rp, "_p").agg(
        F.sum(w).alias("n_rows"), F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb")
    )
    # the mean rank is (n + 1) / 2 on both sides; n cubed leaves the range of a long at two million rows
    n = F.col("n_rows").cast("double")
    base = n * (n + 1) * (n + 1) / F.lit(4.0)
    spread = F.sqrt((F.col("aa") - base) * (F.col("bb") - base))
    one = one.select("n_rows", F.when(spread > 0, (F.col("ab") - base) / spread).alias("rho"))
    left = 1 - F.col("rho") * F.col("rho")
    t = F.when(left > 0, F.col("rho") * F.sqrt((F.col("n_rows") - 2) / left)).otherwise(F.col("rho") * F.lit(float("inf")))
    return one.select("n_rows", "rho", t.alias("t_stat"))


def normality_test(df: DataFrame, residual: str | Column) -> DataFrame:
    """D'Agostino-Pearson K2 from population skewness and kurtosis: (n_rows, skewness, kurtosis, k2, p_value)."""
    x = _col(residual)
    m = df.agg(F.count(x).cast("double").alias("n"), F.skewness(x).alias("g1"), (F.kurtosis(x) + 3).alias("b2"))
    n, g1, b2 = F.col("n"), F.col("g1"), F.col("b2")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2 / (w2 - 1))
    z1 = delta * F.log(y / alpha + F.sqrt(y / alpha * (y / alpha) + 1))
    mean_b2 = 3 * (n - 1) / (n + 1)
    var_b2 = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x2 = (b2 - mean_b2) / F.sqrt(var_b2)
    skew_b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / skew_b * (2 / skew_b + F.sqrt(1 + 4 / (skew_b * skew_b)))
    core = (1 - 2 / a) / (1 + x2 * F.sqrt(2 / (a - 4)))
    cube_root = F.signum(core) * F.pow(F.abs(core), F.lit(1.0 / 3.0))
    z2 = (1 - 2 / (9 * a) - cube_root) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return m.select(
        n.cast("bigint").alias("n_rows"), g1.alias("skewness"), (b2 - 3).alias("kurtosis"),
        k2.alias("k2"), F.exp(-k2 / 2).alias("p_value"),
    )


def coverage(df: DataFrame, y: str, lo: str, hi: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of observations inside their interval and mean width on both scales."""
    covered = F.col(y).between(F.col(lo), F.col(hi))
    return df.groupBy(*by).agg(
        F.count(y).alias("n_rows"),
        F.sum(covered.cast("bigint")).alias("n_covered"),
        F.avg(covered.cast("double")).alias("coverage"),
        F.avg(F.col(hi) - F.col(lo)).alias("mean_width_log"),
        F.avg(F.expm1(hi) - F.expm1(lo)).alias("mean_width_orig"),
    )


def conformal_level(n: int, alpha: float) -> float:
    """Finite-sample corrected quantile level, at most 1."""
    return min(1.0, math.ceil((n + 1) * (1.0 - alpha)) / n)


def conformal_quantile(calibration: DataFrame, y: str, p: str, alpha: float = 0.10) -> DataFrame:
    """(n_cal, level, q_hat): the conformal quantile of the absolute residuals; NULL without any rows."""
    scores = calibration.select(F.abs(F.col(y) - F.col(p)).alias("_s"))
    n, (q_hat,) = bracketed_quantiles(scores, ["_s"], [lambda n: conformal_level(n, alpha)])["_s"]
    row = (n, conformal_level(n, alpha), q_hat) if n else (None, None, None)
    return calibration.sparkSession.createDataFrame([row], "n_cal long, level double, q_hat double")


def add_conformal_interval(df: DataFrame, p: str, q_hat: DataFrame | float, lo: str = "lower_log", hi: str = "upper_log") -> DataFrame:
    """Symmetric interval around the prediction on both scales."""
    q = F.lit(float(q_hat)) if isinstance(q_hat, (int, float)) else q_hat.select("q_hat").scalar()
    return df.withColumns({lo: F.col(p) - q, hi: F.col(p) + q}).withColumns({
        "pred_orig": expm1_clipped(p), "lower_orig": expm1_clipped(lo), "upper_orig": expm1_clipped(hi),
    })


def cv_summary(scores: DataFrame, by: Sequence[str], score: str = "r2") -> DataFrame:
    """Mean and population standard deviation over folds."""
    return scores.groupBy(*by).agg(
        F.count(score).alias("n_folds"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std")
    )


def composite_scores(metrics: DataFrame, group_r2: str, test_r2: str, out: str = "composite") -> DataFrame:
    """0.6 x group-CV R2 plus 0.4 x test R2, both floored at 0."""
    return metrics.withColumn(
        out, 0.6 * F.greatest(F.col(group_r2), F.lit(0.0)) + 0.4 * F.greatest(F.col(test_r2), F.lit(0.0))
    )


def select_best(scored: DataFrame, model: str = "model", score: str = "composite") -> DataFrame:
    """The model with the highest score, ties to the alphabetically last name."""
    best = F.max_by(F.struct(model, score), F.struct(score, model))
    return scored.agg(best.alias("b")).select("b.*")


def delta_to_baseline(df: DataFrame, baseline: Column, value: str, out: str) -> DataFrame:
    """Difference of each row's value to the baseline row's value."""
    base = df.filter(baseline).agg(F.max(value).alias("b")).scalar()
    return df.withColumn(out, F.col(value) - base)


def metric_pivot(long: DataFrame, metrics: Sequence[str], model: str = "model") -> DataFrame:
    """(model, metric, value) to one row per model."""
    return long.groupBy(model).agg(*[
        F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics
    ])


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keyed upsert: new values win, everything else is kept."""
    incoming = new.select(*keys, F.col(value).alias("_new"))
    return existing.join(incoming, list(keys), "full_outer").select(*keys, F.coalesce("_new", value).alias(value))


def domain_counts(df: DataFrame, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows inside and outside, and the percentage inside."""
    return df.groupBy(*by).agg(
        F.count_if(F.col(flag)).alias("n_within"), F.count_if(~F.col(flag)).alias("n_outside"),
        (100 * F.avg(F.col(flag).cast("double"))).alias("pct_within"),
    )
