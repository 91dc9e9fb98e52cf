"""Distributed ranks, running totals and exact quantiles.

A window over a whole table (or over one hot group) would run in a single task. Here the
ordering column is cut into range buckets first. Per-bucket totals are a small table whose
running sum gives each bucket its offset, and the row-scale window runs inside a bucket.
Equal values are pre-aggregated to one counted row, so a hot value weighs one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridsieve.functions.hashing import TWO_32, hash32
from gridsieve.session import default_buckets, new_path
from gridsieve.sources.sinks import save_state

INF = float("inf")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; keeps the left key columns."""
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        here = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = here if cond is None else cond & here
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def range_edges(df: DataFrame, cols: Sequence[str], n: int, accuracy: int = 2_000) -> dict[str, list[float]]:
    """Near-equal-count cut points per column: one aggregate, at most ``n`` numbers each.

    Only the balance of the buckets depends on these edges; every result is exact for any edges.
    """
    shares = [i / n for i in range(1, n)]
    row = df.agg(*[
        F.percentile_approx(F.col(c).cast("double"), shares, accuracy).alias(f"e{i}") for i, c in enumerate(cols)
    ]).first()
    return {c: sorted(set(row[f"e{i}"] or [])) for i, c in enumerate(cols)}


def add_range_bucket(df: DataFrame, col: str, edges: Sequence[float], out: str = "_bucket") -> DataFrame:
    """Bucket id by binary search over the edges (monotone in the column)."""
    cuts = [e for e in edges if e == e and abs(e) != INF]
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    stage = Bucketizer(splits=[-INF, *cuts, INF], inputCol=f"{out}_in", outputCol=out, handleInvalid="keep")
    return stage.transform(df.withColumn(f"{out}_in", F.col(col).cast("double"))).drop(f"{out}_in")


def numbered(ordered: DataFrame, at: str, out: str) -> DataFrame:
    """Positions from 1 in place of ``at``, a monotonically increasing id in a table written in sorted order.

    Such an id holds the number of its partition above the place in it. What the partitions before hold is a table of one
    row per partition, so it may be broadcast.
    """
    part, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0).cast("bigint")).alias("_before"))
    joined = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(out, F.col("_before") + place + 1).drop("_part", "_before", at)


def text_codes(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """(value, code) of the distinct non-NULL values of a text column: positions in ascending order, from 0.

    Values are sorted by range and written; codes come from the sizes of the ranges.
    """
    values = df.filter(F.col(col).isNotNull()).select(col).distinct().repartitionByRange(col).sortWithinPartitions(col)
    written = save_state(values.withColumn("_at", F.monotonically_increasing_id()), new_path(df.sparkSession, "values"))
    return numbered(written, "_at", out).withColumn(out, F.col(out) - 1)


def bucket_offsets(counted: DataFrame, by: Sequence[str], bucket: str, weight: Column) -> DataFrame:
    """(by, bucket) -> rows before the bucket and rows in the group. One row per bucket."""
    totals = counted.groupBy(*by, bucket).agg(F.sum(weight).alias("_in_bucket"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = group.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *by, bucket,
        F.coalesce(F.sum("_in_bucket").over(before), F.lit(0).cast("bigint")).alias("_before"),
        F.sum("_in_bucket").over(group).alias("total"),
    )


def cumulative_counts(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    n_buckets: int | None = None,
    edges: Sequence[float] | None = None,
    bucket: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Distinct non-NULL values with ``n`` (rows), ``cum`` (rows <= value) and ``total``, per group.

    ``bucket`` names a column that is already a monotone bucket of ``value`` within each group, and
    ``weight`` one that says for how many rows a row stands. The input runs once: its counts are written,
    and edges, offsets and positions come from them.
    """
    by, spark = list(by), df.sparkSession
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    keys = [*by, *([bucket] if bucket else []), value]
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(rows.cast("bigint").alias("n"))
    counted = save_state(counted, new_path(spark, "counts"))
    if bucket is None:
        if edges is None:
            edges = range_edges(counted, [value], n_buckets or default_buckets(spark))[value]
        counted = add_range_bucket(counted, value, edges)
        bucket = "_bucket"
    offsets = bucket_offsets(counted, by, bucket, F.col("n"))
    if not by:  # one row per bucket: a small side whatever the input, so the counted rows stay put
        offsets = F.broadcast(offsets)
    inside = W.partitionBy(*by, bucket).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return null_safe_join(counted, offsets, [*by, bucket]).select(
        *by, value, "n", (F.col("_before") + F.sum("n").over(inside)).alias("cum"), "total"
    )


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """Distinct values with their average rank (ties share the mean position)."""
    cum = cumulative_counts(df, value, by, **kw)
    return cum.select(
        *by, value, "n",
        (F.col("cum") - (F.col("n") - 1) / F.lit(2.0)).alias("avg_rank"),
        (F.col("cum") - F.col("n") + 1).alias("min_rank"),
    )


def _position(p: float | Callable[[Column], Column], total: Column) -> Column:
    """0-based fractional position of a quantile; a callable derives the level from the row count."""
    return (total - 1) * (p(total) if callable(p) else F.lit(float(p)))


def pick_quantiles(
    cum: DataFrame, value: str, probs: Sequence[float | Callable[[Column], Column]], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolation quantiles from a cumulative count table (one row per group)."""
    aggs = [F.max("total").alias("n")]
    first = F.col("cum") - F.col("n")
    for i, p in enumerate(probs):
        pos = _position(p, F.col("total"))
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (first <= rank) & (rank < F.col("cum"))
            aggs.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{tag}{i}"))
    picked = cum.groupBy(*by).agg(*aggs)
    out = []
    for i, p in enumerate(probs):
        pos = _position(p, F.col("n"))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append(lo + (hi - lo) * (pos - F.floor(pos)))
    return picked.select(*by, "n", F.array(*out).alias("quantiles"))


#: Points of the sketch that brackets quantiles, its accuracy, and distinct values that one task may sort.
GRID, ACCURACY, FEW = 256, 4096, 200_000
Level = float | Callable[[int], float]


def bracketed_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[Level], grid: int = GRID, accuracy: int = ACCURACY
) -> dict[str, tuple[int, list[float | None]]]:
    """Exact linear-interpolation quantiles of numeric columns: {column: (rows, values)}; NULLs do not count.

    One scan sketches every column, which brackets each quantile between two values; a second scan counts the rows
    below the bracket and the values inside, map-side, and writes only these. A bracket that the sketch
    misplaced is moved and counted again, so the result does not depend on the sketch. A level may be a function of the
    number of rows. The driver holds ``grid`` numbers per column.
    """
    cols, spark = list(cols), df.sparkSession
    data = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    shares = [i / grid for i in range(grid + 1)]
    row = data.agg(*[a for i in range(len(cols)) for a in (
        F.count(f"c{i}").alias(f"n{i}"), F.percentile_approx(f"c{i}", shares, accuracy).alias(f"s{i}")
    )]).first()
    low, high = float("-inf"), float("nan")  # NaN sorts above every number
    wanted = {}  # quantile: column, ranks below and above, share between them, bracket
    for i in range(len(cols)):
        n, points = row[f"n{i}"], row[f"s{i}"]
        for j, p in enumerate(probs):
            if n:
                pos = (n - 1) * (p(n) if callable(p) else float(p))
                at = int(pos / max(n - 1, 1) * grid)
                bracket = (points[at - 1] if at > 0 else low, points[at + 2] if at + 2 <= grid else high)
                wanted[i * len(probs) + j] = (i, math.floor(pos), math.ceil(pos), pos - math.floor(pos), bracket)
    found: dict[int, float] = {}
    while wanted:
        entries = []
        for q, (i, *_, (lo, hi)) in wanted.items():
            x = F.col(f"c{i}")
            value = F.when(x >= lo, x)  # NULL stands for a row below
            entries.append(F.when(x <= hi, F.struct(F.lit(q).alias("q"), value.alias("value"))))
        long = data.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.*")
        counted = save_state(long.groupBy("q", "value").agg(F.count(F.lit(1)).alias("n")), new_path(spark, "brackets"))
        inside = F.col("value").isNotNull()
        sums = counted.groupBy("q").agg(
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("below"),
            F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("inside"), F.count_if(inside).alias("distinct"),
        )
        held = {r.q: r for r in sums.collect()}  # one row per quantile
        ready, again = {}, {}
        for q, (i, first, last, share, (lo, hi)) in wanted.items():
            below, within = (held[q].below, held[q].inside) if q in held else (0, 0)
            if first < below:
                again[q] = (i, first, last, share, (low, lo))
            elif last >= below + within:
                again[q] = (i, first, last, share, (lo if first < below + within else hi, high))
            else:
                ready[q] = (below, first, last, share)
        if ready:
            rows = counted.filter(inside)
            if max(held[q].distinct for q in ready) <= FEW:
                upto = F.sum("n").over(W.partitionBy("q").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))
                cum = rows.select("q", "value", "n", upto.alias("cum"))
            else:
                cum = cumulative_counts(rows, "value", ["q"], weight="n")
            edges = spark.createDataFrame([(q, b, f, t) for q, (b, f, t, _) in ready.items()], "q int, below long, first long, last long")
            cum = cum.join(F.broadcast(edges), "q")  # one row per quantile
            here = lambda rank: (F.col("below") + F.col("cum") - F.col("n") <= rank) & (rank < F.col("below") + F.col("cum"))
            picked = cum.groupBy("q").agg(*[F.max(F.when(here(F.col(k)), F.col("value"))).alias(k) for k in ("first", "last")])
            for r in picked.collect():
                share = ready[r.q][3]
                found[r.q] = r["first"] + (r["last"] - r["first"]) * share if share else r["first"]
        wanted = again
    return {c: (row[f"n{i}"], [found.get(i * len(probs) + j) for j in range(len(probs))]) for i, c in enumerate(cols)}


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), accuracy: int | None = None, **kw
) -> DataFrame:
    """Exact quantiles per group (``n``, ``quantiles``) without holding a group in one task.

    The built-in ``percentile`` keeps a value map per group, which is fine for small groups
    only. ``accuracy`` switches to the one-pass approximate sketch.
    """
    if accuracy is not None:
        return df.groupBy(*by).agg(
            F.count(value).alias("n"),
            F.percentile_approx(F.col(value).cast("double"), list(probs), accuracy).alias("quantiles"),
        )
    if not by:
        return column_quantiles(df, [value], probs).select("n", "quantiles")
    return pick_quantiles(cumulative_counts(df, value, by, **kw), value, probs, by)


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], grid: int = GRID) -> DataFrame:
    """Exact quantiles of several columns at once: (column, n, quantiles); a column without numbers has NULLs."""
    rows = [(c, n, q) for c, (n, q) in bracketed_quantiles(df, cols, probs, grid).items()]
    return df.sparkSession.createDataFrame(rows, "column string, n long, quantiles array<double>")


def hash_rank(
    df: DataFrame,
    key: Column,
    seed: int | str = 42,
    by: Sequence[str] = (),
    n_buckets: int | None = None,
    rank: str = "hash_rank",
    total: str = "group_size",
) -> DataFrame:
    """Adds each row's position in (hash, key) order within its group, and the group size.

    Hashes are uniform, so equal-width buckets split even a group that holds most rows.
    """
    n = n_buckets or default_buckets(df.sparkSession)
    tagged = df.withColumn("_h", hash32(key, seed)).withColumn("_k", key.cast("string"))
    tagged = tagged.withColumn("_bucket", F.floor(F.col("_h") * F.lit(float(n)) / F.lit(TWO_32)).cast("int"))
    offsets = bucket_offsets(tagged.select(*by, "_bucket"), by, "_bucket", F.lit(1)).withColumnRenamed("total", total)
    if not by:
        offsets = F.broadcast(offsets)
    inside = W.partitionBy(*by, "_bucket").orderBy("_h", "_k")
    return (
        null_safe_join(tagged, offsets, [*by, "_bucket"])
        .withColumn(rank, F.col("_before") + F.row_number().over(inside))
        .drop("_h", "_k", "_bucket", "_before")
    )
