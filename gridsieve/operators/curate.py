"""Row filters, key deduplication, column pruning and drop lineage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def at_least(df: DataFrame, col: str, bound) -> DataFrame:
    """Lower-bound filter. NULL is dropped; an absent column makes it a no-op."""
    return df.filter(F.col(col) >= F.lit(bound)) if col in df.columns else df


def not_equal_keep_null(df: DataFrame, col: str, value) -> DataFrame:
    """Drops rows equal to ``value`` and keeps NULL; a no-op for an absent column."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(value))) if col in df.columns else df


def positive(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull() & (F.col(col) > 0))


def drop_reasons(df: DataFrame, steps: Sequence[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """Tags each row with the first step whose keep-condition it fails."""
    reason = F.lit(kept)
    for name, keep in reversed(list(steps)):
        reason = F.when(F.coalesce(keep, F.lit(False)), reason).otherwise(F.lit(name))
    return df.withColumn("drop_reason", reason)


def drop_lineage(tagged: DataFrame) -> DataFrame:
    """Rows per drop reason: one partial aggregate, one row per step."""
    return tagged.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n_rows"))


def keep_best(df: DataFrame, keys: Sequence[str], score: str, tiebreak: Sequence[str | Column]) -> DataFrame:
    """One row per key: highest score, NULL scores last. NULL keys form one group.

    ``row_number() = 1`` is pruned inside every map task before the shuffle
    (window group limit), so a hot key sends one row per task.
    """
    order = [F.col(score).desc_nulls_last(), *[F.col(c) if isinstance(c, str) else c for c in tiebreak]]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") == 1).drop("_rn")


def duplicated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs more than once.

    Counts are pre-aggregated and the rows semi-joined, so a hot key is split by the
    adaptive skew join instead of passing through one window task.
    """
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    renamed = repeated.select(*[F.col(k).alias(f"_d_{k}") for k in keys])
    cond = None
    for k in keys:
        here = F.col(k).eqNullSafe(F.col(f"_d_{k}"))
        cond = here if cond is None else cond & here
    return df.join(renamed, cond, "left_semi")


def column_profile(df: DataFrame) -> DataFrame:
    """(column, n_rows, null_share, is_constant) for all columns from one aggregate.

    A column is constant if min equals max (NULL-safe): exact, and no distinct shuffle.
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        aggs += [
            F.sum(F.col(c).isNull().cast("bigint")).alias(f"n{i}"),
            F.min(c).eqNullSafe(F.max(c)).alias(f"c{i}"),
        ]
    one = df.agg(*aggs)
    packed = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.col("_rows").alias("n_rows"),
            (F.col(f"n{i}") / F.col("_rows")).alias("null_share"),
            F.col(f"c{i}").alias("is_constant"),
        )
        for i, c in enumerate(df.columns)
    ])
    return one.select(F.explode(packed).alias("s")).select("s.*")


def prune_columns(df: DataFrame, max_null_share: float = 0.95, protected: Sequence[str] = ()) -> DataFrame:
    """Drops near-empty and constant columns; reads one profile row per column."""
    dropped = [
        r["column"]
        for r in column_profile(df).collect()
        if r["column"] not in protected
        and (r["n_rows"] == 0 or r["null_share"] >= max_null_share or r["is_constant"])
    ]
    return df.drop(*dropped)


def multi_filter(df: DataFrame, in_lists: Mapping[str, Sequence] = {}, flags: Mapping[str, bool | None] = {}) -> DataFrame:
    """Conjunction of optional filters; an empty list or a None flag filters nothing."""
    for col, values in in_lists.items():
        if values:
            df = df.filter(F.col(col).isin(*values))
    for col, wanted in flags.items():
        if wanted is not None:
            df = df.filter(F.col(col) == F.lit(wanted))
    return df


def cap_by_reference_max(df: DataFrame, col: str, reference: DataFrame, ref_col: str, factor: float = 3.0) -> DataFrame:
    """Keeps rows with ``col <= factor * max(reference.ref_col)`` (scalar subquery)."""
    cap = reference.agg(F.max(ref_col).alias("cap")).scalar()
    return df.filter(F.col(col) <= F.lit(float(factor)) * cap)


def min_group_count(df: DataFrame, keys: Sequence[str], at_least: int) -> DataFrame:
    """Groups with at least the given number of rows: (keys, n_rows)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= at_least)


def top_categories(df: DataFrame, col: str, n: int) -> DataFrame:
    """The n most frequent non-NULL values, ties by value: (col, n_rows)."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), F.asc(col)).limit(n)


def in_top_categories(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows belonging to the n most frequent values."""
    return df.join(top_categories(df, col, n).select(col), col, "left_semi")


def top_rows(df: DataFrame, order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows in the given order; the optional rank column numbers only those n rows."""
    top = df.orderBy(*order).limit(n)
    if rank is None:
        return top
    return top.withColumn(rank, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))


def hash_sample(df: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """Repeatable sample of n rows: the n smallest key hashes (a distributed top-n)."""
    return df.orderBy(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}"))), key.cast("string")).limit(n)
