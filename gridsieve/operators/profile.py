"""Descriptive tables: null shares, KPIs, counts, histograms, box statistics, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsieve.functions.ranking import exact_quantiles, null_safe_join
from gridsieve.operators.curate import column_profile, in_top_categories
from gridsieve.session import new_path
from gridsieve.sources.sinks import save_state


def null_shares(df: DataFrame) -> DataFrame:
    """(column, null_pct), largest first."""
    return column_profile(df).select("column", (100 * F.col("null_share")).alias("null_pct")).orderBy(
        F.desc("null_pct"), "column"
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(col, n_rows), most frequent first; NULL is not counted."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), F.asc(col))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def category_shares(df: DataFrame, cols: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Share of each listed category per column, one row per column, absent categories 0.

    Shares are of the column's non-NULL rows. One conditional aggregate: no pivot shuffle.
    """
    aggs = []
    for i, c in enumerate(cols):
        n = F.count(c)
        for j, v in enumerate(categories):
            hits = F.sum((F.col(c) == F.lit(v)).cast("bigint"))
            aggs.append(F.when(n > 0, hits / n).otherwise(F.lit(0.0)).alias(f"s{i}_{j}"))
    one = df.agg(*aggs)
    packed = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"s{i}_{j}").alias(str(v)) for j, v in enumerate(categories)])
        for i, c in enumerate(cols)
    ])
    return one.select(F.explode(packed).alias("s")).select("s.*")


def group_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], **kw) -> DataFrame:
    """Exact quantiles per group as named columns."""
    q = exact_quantiles(df, value, probs, by, **kw)
    return q.select(*by, F.col("n").alias("n_rows"), *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)])


def group_median_std(df: DataFrame, by: Sequence[str], value: str, **kw) -> DataFrame:
    """Median and sample standard deviation per group; the latter is NULL for a single row."""
    med = group_quantiles(df, by, value, [0.5], ["median"], **kw)
    std = df.groupBy(*by).agg(F.stddev_samp(value).alias("std"))
    return null_safe_join(med, std, by)


def box_stats(df: DataFrame, by: str, value: str, top: int | None = None, whisker: float = 1.5) -> DataFrame:
    """Five-number summary per (top) category plus the outermost values inside the fences."""
    data = in_top_categories(df, by, top) if top else df
    q = group_quantiles(data, [by], value, [0, 0.25, 0.5, 0.75, 1], ["min", "q1", "median", "q3", "max"])
    q = save_state(q, new_path(df.sparkSession, "boxes"))  # of known size: the rows are not dealt by category
    span = (F.col("q3") - F.col("q1")) * whisker
    fences = q.select(F.col(by), (F.col("q1") - span).alias("_lo"), (F.col("q3") + span).alias("_hi"))
    inside = null_safe_join(data.select(by, value), fences, [by]).filter(F.col(value).between(F.col("_lo"), F.col("_hi")))
    ends = inside.groupBy(by).agg(F.min(value).alias("whisker_lo"), F.max(value).alias("whisker_hi"))
    return null_safe_join(q, ends, [by], "left")


def histogram(df: DataFrame, value: str | Column, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width histogram (bin, lower, upper, n_rows), last bin closed, empty bins included.

    Limits not given come from one min/max aggregate. Values outside given limits are not counted.
    """
    x = F.col(value) if isinstance(value, str) else value
    data = df.select(x.cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    span = data.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("s")).scalar()
    low = F.lit(float(lo)) if lo is not None else span["lo"]
    high = F.lit(float(hi)) if hi is not None else span["hi"]
    width = (high - low) / F.lit(float(bins))
    bin_ = F.when(width > 0, F.least(F.floor((F.col("_x") - low) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counted = (
        data.filter((F.col("_x") >= low) & (F.col("_x") <= high)).groupBy(bin_.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counted, "bin", "left").select(
        "bin", (low + F.col("bin") * width).alias("lower"), (low + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"),
    )


def correlations(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of each column with the target over pairwise complete rows: one aggregate."""
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    packed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("corr")) for i, c in enumerate(cols)])
    return one.select(F.explode(packed).alias("s")).select("s.*")
