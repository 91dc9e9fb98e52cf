"""Imputation, label encoding and cross-fitted target encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsieve.functions.ranking import column_quantiles, null_safe_join, text_codes
from gridsieve.session import new_path
from gridsieve.sources.sinks import save_state


def fit_medians(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact column medians of the training rows as a one-row table."""
    meds = column_quantiles(train, cols, [0.5])
    return meds.agg(*[
        F.max(F.when(F.col("column") == c, F.col("quantiles")[0])).alias(c) for c in cols
    ])


def apply_medians(df: DataFrame, medians: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL numbers become the fitted median (one-row scalar subquery, no join)."""
    fitted = medians.select(F.struct(*cols).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), fitted[c]) for c in cols})


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Alphabetical code 0..n-1 per distinct value; NULL stays without one. Values are ranked by range."""
    return df.join(text_codes(df, col, out), col, "left")


def _shrunk(n: Column, s: Column, q: Column, g_mean: Column, g_var: Column) -> Column:
    """Category mean shrunk towards the global mean by its signal-to-noise ratio (empirical Bayes)."""
    mean = s / n
    var = F.greatest(q / n - mean * mean, F.lit(0.0))
    weight = n * g_var / (n * g_var + var)
    return F.when(n * g_var + var > 0, weight * mean + (1 - weight) * g_mean).otherwise(mean)


def _moments(rows: Sequence) -> tuple[float, float, float]:
    """Count, mean and sum of squared deviations of merged parts."""
    n = sum(r["n"] for r in rows)
    if not n:
        return 0.0, 0.0, 0.0
    mean = sum(r["n"] * r["mean"] for r in rows) / n
    m2 = sum(r["n"] * r["var"] + r["n"] * (r["mean"] - mean) ** 2 for r in rows)
    return float(n), mean, m2


def _part_moments(train: DataFrame, target: str, parts: Column) -> list:
    """Count, mean, variance of the target per part: a handful of rows, read by the driver."""
    return train.filter(F.col(target).isNotNull()).groupBy(parts.alias("part")).agg(
        F.count(target).alias("n"), F.avg(target).alias("mean"), F.var_pop(target).alias("var")
    ).collect()


def _category_sums(train: DataFrame, keys: Sequence[str], target: str, centre: float) -> DataFrame:
    """Counts, sums and sums of squares of the centred target (centring keeps the squares small)."""
    y = F.col(target) - F.lit(centre)
    return train.groupBy(*keys).agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))


def fit_target_encoding(train: DataFrame, cat: str, target: str) -> DataFrame:
    """(category, encoding, global_mean) from all training rows; for rows outside the training set."""
    n, centre, m2 = _moments(_part_moments(train, target, F.lit(0)))
    stats = _category_sums(train, [cat], target, centre)
    g_var = F.lit(m2 / n if n else 0.0)
    enc = _shrunk(F.col("n"), F.col("s"), F.col("q"), F.lit(0.0), g_var)
    return stats.filter(F.col("n") > 0).select(
        cat, (enc + F.lit(centre)).alias("encoding"), F.lit(centre).alias("global_mean")
    )


def apply_target_encoding(df: DataFrame, fitted: DataFrame, cat: str, out: str) -> DataFrame:
    """Joins the fitted encodings; unseen categories take the global mean."""
    # written, so that its size is known and a short list of categories is broadcast: rows are not dealt by category
    fitted = save_state(fitted, new_path(df.sparkSession, "encoding"))
    default = fitted.agg(F.max("global_mean").alias("g")).scalar()
    joined = null_safe_join(df, fitted.select(cat, "encoding"), [cat], "left")
    return joined.withColumn(out, F.coalesce("encoding", default)).drop("encoding")


def cross_fit_target_encoding(train: DataFrame, cat: str, target: str, fold: str, out: str) -> DataFrame:
    """Encodes each training row from the rows of the other folds only.

    Everything comes from one (category, fold) aggregate: a category's statistics without a
    fold are its totals minus that fold's own sums. The driver reads one row per fold.
    """
    parts = _part_moments(train, target, F.col(fold))
    _, centre, _ = _moments(parts)
    g_mean, g_var = F.lit(0.0), F.lit(0.0)
    for part in parts:
        n, mean, m2 = _moments([p for p in parts if p["part"] != part["part"]])
        here = F.col(fold) == F.lit(part["part"])
        g_mean = F.when(here, F.lit(mean - centre if n else 0.0)).otherwise(g_mean)
        g_var = F.when(here, F.lit(m2 / n if n else 0.0)).otherwise(g_var)
    stats = _category_sums(train, [cat, fold], target, centre)
    per_cat = stats.groupBy(cat).agg(F.sum("n").alias("cn"), F.sum("s").alias("cs"), F.sum("q").alias("cq"))
    rest = null_safe_join(stats, per_cat, [cat])
    n = F.col("cn") - F.col("n")
    s = F.col("cs") - F.coalesce("s", F.lit(0.0))
    q = F.col("cq") - F.coalesce("q", F.lit(0.0))
    enc = F.when(n > 0, _shrunk(n, s, q, g_mean, g_var)).otherwise(g_mean) + F.lit(centre)
    fitted = save_state(rest.select(cat, fold, enc.alias(out)), new_path(train.sparkSession, "encoding"))
    return null_safe_join(train, fitted, [cat, fold])


def fit_encodings(
    train: DataFrame, cats: Sequence[str], target: str, fold: str, path: str
) -> tuple[DataFrame, DataFrame, float]:
    """Target encodings of many text columns from one pass: (out-of-fold table, full table, global mean).

    All columns are counted together as (column, value, fold) sums. The sums are written below
    ``path`` because every later join reads them: one shuffle of the data however many columns.
    """
    parts = _part_moments(train, target, F.col(fold))
    n_all, centre, m2_all = _moments(parts)
    packed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cats])
    long = train.select(F.explode(packed).alias("s"), fold, target).select("s.*", fold, target)
    sums = _category_sums(long, ["column", "value", fold], target, centre)
    sums.write.mode("overwrite").parquet(f"{path}/sums")
    sums = train.sparkSession.read.parquet(f"{path}/sums")
    per_value = sums.groupBy("column", "value").agg(F.sum("n").alias("cn"), F.sum("s").alias("cs"), F.sum("q").alias("cq"))
    g_mean, g_var = F.lit(0.0), F.lit(0.0)
    for part in parts:
        n, mean, m2 = _moments([p for p in parts if p["part"] != part["part"]])
        here = F.col(fold) == F.lit(part["part"])
        g_mean = F.when(here, F.lit(mean - centre if n else 0.0)).otherwise(g_mean)
        g_var = F.when(here, F.lit(m2 / n if n else 0.0)).otherwise(g_var)
    rest = null_safe_join(sums, per_value, ["column", "value"])
    n = F.col("cn") - F.col("n")
    s = F.col("cs") - F.coalesce("s", F.lit(0.0))
    q = F.col("cq") - F.coalesce("q", F.lit(0.0))
    inside = F.when(n > 0, _shrunk(n, s, q, g_mean, g_var)).otherwise(g_mean) + F.lit(centre)
    var = F.lit(m2_all / n_all if n_all else 0.0)
    outside = _shrunk(F.col("cn"), F.col("cs"), F.col("cq"), F.lit(0.0), var) + F.lit(centre)
    rest.select("column", "value", fold, inside.alias("encoding")).write.mode("overwrite").parquet(f"{path}/folds")
    full = per_value.filter("cn > 0").select("column", "value", outside.alias("encoding"), F.lit(centre).alias("global_mean"))
    full.write.mode("overwrite").parquet(f"{path}/full")
    read = train.sparkSession.read.parquet
    return read(f"{path}/folds"), read(f"{path}/full"), centre


def apply_encodings(
    df: DataFrame, table: DataFrame, cats: Sequence[str], default: float, fold: str | None = None
) -> DataFrame:
    """Replaces text columns by their encodings; ``fold`` selects the out-of-fold ones. Unseen values take the default."""
    for c in cats:
        keys = [c] + ([fold] if fold else [])
        side = table.filter(F.col("column") == c).select(F.col("value").alias(c), *([fold] if fold else []), "encoding")
        df = null_safe_join(df, side, keys, "left").withColumn("_te", F.coalesce("encoding", F.lit(default)))
        df = df.drop("encoding", c).withColumnRenamed("_te", c)
    return df
