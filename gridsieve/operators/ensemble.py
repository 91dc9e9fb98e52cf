"""Ensemble summaries over members: quantiles, disagreement, calibration curves, bootstrap weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsieve.functions.hashing import DRAWS_PER_DIGEST, digest_draws, poisson1_counts, poisson1_hex
from gridsieve.session import new_path
from gridsieve.sources.sinks import save_state


def poisson_bootstrap(df: DataFrame, key: Column, n_members: int, seed: int = 42) -> DataFrame:
    """One row per (row, member) with Poisson(1) weight > 0: (.., member, boot_weight).

    Weights are hashes of (key, member, seed), so replicates are identical on every retry.
    """
    blocks = F.explode(F.sequence(F.lit(0), F.lit((n_members - 1) // DRAWS_PER_DIGEST)))
    cols = df.columns
    digests = df.select("*", blocks.alias("_block")).withColumn(
        "_digest", digest_draws(key, F.col("_block"), seed)
    )
    draws = F.array(*[
        F.struct(
            (F.col("_block") * DRAWS_PER_DIGEST + i).cast("int").alias("member"),
            poisson1_hex(F.substring("_digest", 8 * i + 1, 8)).alias("boot_weight"),
        )
        for i in range(DRAWS_PER_DIGEST)
    ])
    out = digests.select(*cols, F.explode(draws).alias("_m")).select(*cols, "_m.member", "_m.boot_weight")
    return out.filter((F.col("boot_weight") > 0) & (F.col("member") < n_members))


def bootstrap_sums(df: DataFrame, key: Column, by: Sequence[str], value: str, n_members: int, seed: int = 42) -> DataFrame:
    """(by, n_draws array<long>, sums array<double>): Poisson weights and weighted sums of every member per group.

    One scan: a task adds up all members of its rows, so rows are not copied per member. The weights are those of
    poisson_bootstrap; a row whose value is NULL has no part in it. Whole numbers and fractions are added up apart, so that
    the order of the rows hardly shows in the sums.
    """
    blocks = -(-n_members // DRAWS_PER_DIGEST)
    digests = F.concat(*[digest_draws(key, b, seed) for b in range(blocks)])
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), digests.alias("_d"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            counts, values = poisson1_counts(pdf["_d"], n_members).astype(np.int64), pdf["_v"].to_numpy()
            finite = np.isfinite(values)
            whole = np.where(finite, np.floor(values), values)
            rest = np.where(finite, values - whole, 0.0)
            groups = pdf.groupby(list(by), dropna=False, sort=False).indices.values() if by else [np.arange(len(pdf))]
            groups = list(groups)
            out = pdf[list(by)].iloc[[g[0] for g in groups]].reset_index(drop=True)
            out["n_draws"] = [counts[g].sum(0) for g in groups]
            out["sums"] = [whole[g] @ counts[g] for g in groups]
            out["rests"] = [rest[g] @ counts[g] for g in groups]
            yield out

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*by).schema.fields)
    parts = rows.mapInPandas(add, kinds + "n_draws array<long>, sums array<double>, rests array<double>")
    each = {c: [F.sum(F.col(c)[i]) for i in range(n_members)] for c in ("n_draws", "sums", "rests")}
    sums = [a + b for a, b in zip(each["sums"], each["rests"], strict=True)]
    return parts.groupBy(*by).agg(F.array(*each["n_draws"]).alias("n_draws"), F.array(*sums).alias("sums"))


#: Rows that share a part of the last level of an exact bootstrap, on average at most, and parts of each level.
LEAF, FAN_BITS = 4096, 8


def exact_bootstrap(df: DataFrame, key: Column, n_members: int, seed: int = 42, leaf: int = LEAF) -> DataFrame:
    """The rows with ``boot_weights``: how often each member draws the row, n draws of n rows with replacement.

    A multinomial draw splits: the n draws of a member are dealt to hash buckets of rows in proportion to their sizes, level
    by level, FAN parts at a time, and in the last level to the rows. Every split is seeded by (seed, level, bucket)
    and serves all members at once, so no replicate makes a pass of its own and nothing depends on partitions. ``key``
    identifies a row; buckets hold rows by the hash of it. What a task holds is one bucket of rows.
    """
    spark, fan, columns = df.sparkSession, 1 << FAN_BITS, df.columns
    tagged = df.withColumn("_h", F.xxhash64(key.cast("string"), F.lit(seed))).withColumn("_k", key.cast("string"))
    tagged = save_state(tagged, new_path(spark, "bootstrap"))
    n = tagged.count()
    levels = 0
    while n > leaf * fan**levels:
        levels += 1
    path = lambda level: F.shiftrightunsigned("_h", 64 - FAN_BITS * level) if level else F.lit(0).cast("long")
    draws = spark.createDataFrame([(0, [n] * n_members)], "part long, draws array<long>")
    sizes = tagged.groupBy(path(levels).alias("part")).agg(F.count(F.lit(1)).alias("n")) if levels else None
    sizes = save_state(sizes, new_path(spark, "bootstrap")) if levels else None

    def generator(level: int, part: int) -> np.random.Generator:
        return np.random.Generator(np.random.PCG64([seed, level, part]))

    for level in range(levels):
        up = F.shiftrightunsigned("part", FAN_BITS * (levels - level))
        child = F.shiftrightunsigned("part", FAN_BITS * (levels - level - 1))
        children = sizes.groupBy(up.alias("part"), child.alias("child")).agg(F.sum("n").alias("n"))
        children = children.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("child", "n"))).alias("children"))  # at most FAN

        def deal(batches: Iterator[pd.DataFrame], level=level) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part, own, todo in zip(pdf["part"], pdf["children"], pdf["draws"], strict=True):
                    share = np.array([c["n"] for c in own], float)
                    dealt = generator(level, int(part)).multinomial(np.asarray(todo, np.int64), share / share.sum())
                    yield pd.DataFrame({"part": [c["child"] for c in own], "draws": list(dealt.T)})

        draws = save_state(draws.join(children, "part").mapInPandas(deal, "part long, draws array<long>"), new_path(spark, "bootstrap"))

    def rows_of(rows: pa.Table, todo: pa.Table) -> pa.Table:
        order = rows.select(["_h", "_k"]).to_pandas().reset_index().sort_values(["_h", "_k"], kind="stable")["index"].to_numpy()
        rows = rows.take(pa.array(order))
        dealt = np.zeros((n_members, 0), np.int64)
        if len(rows):
            amounts = np.array(todo.column("draws")[0].as_py(), np.int64)
            part = int(todo.column("part")[0].as_py())
            dealt = generator(levels, part).multinomial(amounts, np.full(len(rows), 1 / len(rows)))
        weights = pa.array([w.tolist() for w in dealt.T], pa.list_(pa.int32()))
        return rows.select(columns).append_column("boot_weights", weights)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    grouped = tagged.withColumn("_part", path(levels)).groupBy("_part")
    return grouped.cogroup(draws.groupBy("part")).applyInArrow(rows_of, f"{kinds}, boot_weights array<int>")


def ensemble_quantiles(
    members: DataFrame, row: Sequence[str], pred: str = "pred", probs: Sequence[float] = (0.05, 0.5, 0.95),
    names: Sequence[str] = ("p05", "median", "p95"),
) -> DataFrame:
    """Quantiles across members per row. A group holds one value per member, so it is bounded."""
    q = members.groupBy(*row).agg(F.percentile(pred, F.array(*[F.lit(float(p)) for p in probs])).alias("_q"))
    return q.select(*row, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def disagreement(members: DataFrame, row: Sequence[str], pred: str = "pred") -> DataFrame:
    """Population standard deviation of the predictions per row."""
    return members.groupBy(*row).agg(F.stddev_pop(pred).alias("disagreement"))


def calibration_curve(members: DataFrame, row: Sequence[str], y: str, pred: str = "pred", n_levels: int = 19) -> DataFrame:
    """Nominal against empirical coverage at levels 1/(n+1) .. n/(n+1).

    One percentile call per row yields the bounds of all levels.
    """
    levels = [(i + 1) / (n_levels + 1) for i in range(n_levels)]
    probs = [p for c in levels for p in ((1 - c) / 2, 1 - (1 - c) / 2)]
    q = members.groupBy(*row, y).agg(F.percentile(pred, F.array(*[F.lit(p) for p in probs])).alias("_q"))
    packed = F.array(*[
        F.struct(F.lit(round(c, 10)).alias("nominal"), F.col("_q")[2 * i].alias("lo"), F.col("_q")[2 * i + 1].alias("hi"))
        for i, c in enumerate(levels)
    ])
    long = q.select(y, F.explode(packed).alias("s")).select(y, "s.*")
    inside = F.col(y).between(F.col("lo"), F.col("hi")).cast("double")
    return long.groupBy("nominal").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(inside).alias("empirical"))


def array_quantile(values: Column, p: float) -> Column:
    """Linear-interpolation quantile of a sorted, non-empty array column."""
    at = (F.size(values) - 1) * F.lit(float(p))
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def row_quantiles(values: np.ndarray, probs: Sequence[float]) -> np.ndarray:
    """Linear-interpolation quantiles of each row of a matrix, as array_quantile takes them; NaN is the largest value."""
    ordered = np.sort(values, axis=1)
    at = (values.shape[1] - 1) * np.array(probs, float)
    low, high = ordered[:, np.floor(at).astype(int)], ordered[:, np.ceil(at).astype(int)]
    return low + (high - low) * (at - np.floor(at))


def quantile_columns(
    df: DataFrame, preds: str = "preds", probs: Sequence[float] = (0.05, 0.5, 0.95), names: Sequence[str] = ("p05", "median", "p95")
) -> DataFrame:
    """Quantiles over the members' predictions in an array per row: map-only, one sort of the array."""
    sorted_ = df.withColumn("_sorted", F.array_sort(preds))
    return sorted_.select(*df.columns, *[array_quantile(F.col("_sorted"), p).alias(n) for p, n in zip(probs, names)])


def array_disagreement(preds: str = "preds") -> Column:
    """Population standard deviation over the members' predictions in an array."""
    n = F.size(preds)
    mean = F.aggregate(preds, F.lit(0.0), lambda s, x: s + x) / n
    return F.sqrt(F.aggregate(preds, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)


def array_calibration(df: DataFrame, y: str, preds: str = "preds", n_levels: int = 19) -> DataFrame:
    """Nominal against empirical coverage from an array of members' predictions per row.

    Coverage is summed map-side, one number per level; rows are neither copied per member nor shuffled.
    """
    levels = [(i + 1) / (n_levels + 1) for i in range(n_levels)]
    sorted_ = df.select(F.col(y).alias("_y"), F.array_sort(preds).alias("_s"))
    inside = [
        F.avg(F.col("_y").between(array_quantile(F.col("_s"), (1 - c) / 2), array_quantile(F.col("_s"), 1 - (1 - c) / 2)).cast("double"))
        for c in levels
    ]
    packed = F.array(*[F.struct(F.lit(round(c, 10)).alias("nominal"), F.count(F.lit(1)).alias("n_rows"), a.alias("empirical")) for c, a in zip(levels, inside)])
    return sorted_.agg(packed.alias("l")).select(F.explode("l").alias("s")).select("s.*")
