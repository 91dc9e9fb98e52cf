"""Splits, folds, quantile bins and resampling, all decided by key hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsieve.functions.hashing import hash32, uniform
from gridsieve.functions.ranking import exact_quantiles, hash_rank, null_safe_join


def quantile_edges(df: DataFrame, value: str, bins: int = 10) -> list[float]:
    """Distinct quantile edges (at most bins + 1 numbers, read by the driver)."""
    row = exact_quantiles(df, value, [i / bins for i in range(bins + 1)]).first()
    return sorted(set(row["quantiles"])) if row and row["quantiles"] else []


def add_quantile_bin(df: DataFrame, value: str, bins: int = 10, out: str = "bin") -> DataFrame:
    """Quantile bins, right-closed, lowest value included, duplicate edges merged."""
    inner = quantile_edges(df, value, bins)[1:-1]
    code = F.lit(0)
    for edge in inner:
        code = code + (F.col(value) > F.lit(edge)).cast("int")
    return df.withColumn(out, F.when(F.col(value).isNotNull(), code))


def stratified_split(
    df: DataFrame, key: Column, strata: str, test_share: float = 0.15, seed: int = 42, out: str = "split"
) -> DataFrame:
    """In each stratum the first round(share * n) rows in hash order become ``test``."""
    ranked = hash_rank(df, key, seed, [strata])
    test = F.col("hash_rank") <= F.round(F.col("group_size") * F.lit(float(test_share)))
    return ranked.withColumn(out, F.when(test, "test").otherwise("train")).drop("hash_rank", "group_size")


def hash_split(df: DataFrame, key: Column, test_share: float, seed: int = 42, out: str = "split") -> DataFrame:
    """Plain random split by hash threshold; map-only."""
    return df.withColumn(out, F.when(uniform(key, seed) < F.lit(float(test_share)), "test").otherwise("train"))


def kfold(df: DataFrame, key: Column, n_folds: int = 5, seed: int = 42, balanced: bool = False, out: str = "fold") -> DataFrame:
    """Fold number by hash; ``balanced`` deals rows out in hash order so fold sizes differ by at most one."""
    if not balanced:
        return df.withColumn(out, F.pmod(hash32(key, seed), F.lit(n_folds)).cast("int"))
    ranked = hash_rank(df, key, seed)
    return ranked.withColumn(out, F.pmod(F.col("hash_rank") - 1, F.lit(n_folds)).cast("int")).drop(
        "hash_rank", "group_size"
    )


def _deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` equal groups each fold gets when every group goes to the lightest fold.

    The i-th group lands on the i-th smallest element of the fold sequences load + t * size, so a
    threshold search replaces the one-by-one walk.
    """
    lo, hi = min(loads), max(loads) + size * (count + 1)
    while lo < hi:  # smallest level at which at least `count` groups fit below or at it
        mid = (lo + hi) // 2
        if sum(max(0, (mid - load) // size + 1) for load in loads) >= count:
            hi = mid
        else:
            lo = mid + 1
    given = [max(0, (lo - 1 - load) // size + 1) for load in loads]
    for f, load in enumerate(loads):  # the rest sit exactly on the level, lowest fold first
        if sum(given) == count:
            break
        if lo >= load and (lo - load) % size == 0:
            given[f] += 1
    return given


def group_fold_plan(sizes: Sequence[tuple[int, int]], n_folds: int) -> list[tuple[int, int, int, int]]:
    """(size, fold, first_rank, last_rank) rows from a histogram of group sizes [(size, n_groups)].

    Largest groups first, each to the lightest fold. Groups of equal size are interchangeable,
    so the plan needs the size histogram only, not the groups.
    """
    loads, plan = [0] * n_folds, []
    for size, count in sorted(sizes, reverse=True):
        rank = 1
        for fold, k in enumerate(_deal(loads, size, count)):
            if k:
                plan.append((size, fold, rank, rank + k - 1))
                rank += k
                loads[fold] += size * k
    return plan


def group_kfold(
    df: DataFrame, group: str, n_folds: int | None = 5, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Whole groups per fold, balanced greedily by size. ``n_folds=None`` gives one fold per group.

    The driver reads only the histogram of group sizes; which group of a size class goes where
    is decided by its hash rank inside the class.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    if n_folds is None:
        one_each = hash_rank(sizes, F.coalesce(F.col(group).cast("string"), F.lit("")), seed)
        folds = one_each.select(group, (F.col("hash_rank") - 1).alias(out))
        return null_safe_join(df, folds, [group])
    histogram = [(r["_size"], r["n"]) for r in sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()]
    plan = df.sparkSession.createDataFrame(
        group_fold_plan(histogram, n_folds) or [(0, 0, 0, 0)], f"_size long, {out} int, _first long, _last long"
    )
    ranked = hash_rank(sizes, F.coalesce(F.col(group).cast("string"), F.lit("")), seed, ["_size"])
    folds = ranked.join(plan, "_size").filter(F.col("hash_rank").between(F.col("_first"), F.col("_last")))
    return null_safe_join(df, folds.select(group, out), [group])


def learning_subsets(
    df: DataFrame, key: Column, fractions: Sequence[float], seed: int = 42, by: Sequence[str] = ()
) -> DataFrame:
    """Nested training prefixes: rows tagged with the smallest fraction step that includes them.

    ``step <= i`` selects the subset of fraction i, so the table is not copied per fraction.
    """
    ranked = hash_rank(df, key, seed, by)
    step = F.lit(len(fractions))
    for i, frac in reversed(list(enumerate(sorted(fractions)))):
        step = F.when(F.col("hash_rank") <= F.floor(F.col("group_size") * F.lit(float(frac)) + 1e-9), F.lit(i)).otherwise(step)
    return ranked.withColumn("step", step).drop("hash_rank", "group_size")


def minmax(df: DataFrame, value: str, out: str) -> DataFrame:
    """Scaling to [0, 1] by one min/max aggregate; a constant column stays as it is."""
    s = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s")).scalar()
    span = s["hi"] - s["lo"]
    return df.withColumn(out, F.when(span > 0, (F.col(value) - s["lo"]) / span).otherwise(F.col(value)))
