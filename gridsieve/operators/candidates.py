"""Candidate grids, partner choice and the screening table."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridsieve.functions.hashing import hash32, uniform
from gridsieve.functions.ranking import add_range_bucket, range_edges, text_codes
from gridsieve.functions.scalars import composition_label, cut, expm1_clipped, relative_width, upper_bound
from gridsieve.operators.curate import cap_by_reference_max, keep_best, top_rows
from gridsieve.session import default_buckets, new_path
from gridsieve.sources.sinks import save_state


def candidate_grid(spark: SparkSession, lists: Mapping[str, Sequence], row_id: str = "row_id") -> DataFrame:
    """All combinations of the value lists, last list fastest.

    Every row is decoded from its number in a distributed range, so the grid is generated in
    parallel at any size and nothing is joined.
    """
    for name, values in lists.items():
        if not values:
            raise ValueError(f"list {name} is empty")
    total = math.prod(len(v) for v in lists.values())
    cols, stride = {}, 1
    for name, values in reversed(list(lists.items())):
        digit = F.floor(F.col("id") / F.lit(stride)) if stride > 1 else F.col("id")
        cols[name] = F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(digit, F.lit(len(values))) + 1).cast("int"))
        stride *= len(values)
    return spark.range(total).select(F.col("id").alias(row_id), *[cols[name].alias(name) for name in lists])


def grid_of_values(spark: SparkSession, tables: Mapping[str, DataFrame], row_id: str = "row_id") -> DataFrame:
    """All combinations of the distinct non-NULL values of one-column tables, last table fastest.

    Values are numbered without passing through the driver; every row of a distributed range is then
    decoded by an equi-join per column on the number of its value.
    """
    numbered, sizes = {}, {}
    for name, df in tables.items():
        ranks = text_codes(df.select(F.col(df.columns[0]).alias(name)), name, f"_{name}")
        # written, so that its size is known: a short table is broadcast, a long one has many join keys
        numbered[name] = save_state(ranks, new_path(spark, "grid-values"))
        sizes[name] = numbered[name].count()
    out, stride = spark.range(math.prod(sizes.values())).select(F.col("id").alias(row_id)), 1
    for name in reversed(list(tables)):
        digit = F.pmod(F.floor(F.col(row_id) / F.lit(stride)), F.lit(sizes[name])).cast("long")
        out = out.withColumn(f"_{name}", digit).join(numbered[name], f"_{name}").drop(f"_{name}")
        stride *= sizes[name]
    return out.select(row_id, *tables)


def pick_partner(
    host: str | Column, partners: Mapping[str, Sequence[str]], key: Column, seed: int = 42, none_share: float = 0.0
) -> Column:
    """One of the host's partners by row hash; ``none`` for hosts without any (and for ``none_share`` of rows)."""
    host = F.col(host) if isinstance(host, str) else host
    draw = hash32(key, seed)
    out = F.lit("none")
    for name, options in partners.items():
        chosen = F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(draw, F.lit(len(options))) + 1).cast("int"))
        out = F.when(host == name, chosen).otherwise(out)
    if none_share > 0:
        out = F.when(uniform(key, f"{seed}n") < F.lit(float(none_share)), F.lit("none")).otherwise(out)
    return out


def conformal_rescore(df: DataFrame, pred: str | Column, q_hat: DataFrame | float) -> DataFrame:
    """Overwrites the interval columns with prediction plus/minus the conformal quantile."""
    p = F.col(pred) if isinstance(pred, str) else pred
    q = F.lit(float(q_hat)) if isinstance(q_hat, (int, float)) else q_hat.select("q_hat").scalar()
    out = df.withColumns({"pred_median_log": p})
    m = F.col("pred_median_log")
    out = out.withColumns({"pred_p05_log": m - q, "pred_p95_log": m + q, "ucb_log": m + q})
    return out.withColumns({"pred_orig": expm1_clipped("pred_median_log"), "ucb_orig": expm1_clipped("ucb_log")})


def screening_table(
    scored: DataFrame, host: str, partner: str, amount: str | Column, train: DataFrame | None = None,
    target: str | None = None, kappa: float = 1.0, cap_factor: float = 3.0, keep_ucb: bool = False,
) -> DataFrame:
    """UCB, back-transforms, label and confidence; drops predictions beyond ``cap_factor`` x the training maximum."""
    med, lo, hi = F.col("pred_median_log"), F.col("pred_p05_log"), F.col("pred_p95_log")
    out = scored if keep_ucb else scored.withColumn("ucb_log", upper_bound(med, lo, hi, kappa))
    out = out.withColumns({
        "pred_orig": expm1_clipped("pred_median_log"),
        "ucb_orig": expm1_clipped("ucb_log"),
        "composition": composition_label(host, partner, amount),
        "confidence": cut(relative_width(hi - lo, med), [0.3, 0.6], ["HIGH", "MEDIUM", "LOW"]),
    })
    return cap_by_reference_max(out, "pred_orig", train, target, cap_factor) if train is not None else out


def best_candidates(table: DataFrame, keys: Sequence[str], tiebreak: Sequence[str], n: int = 100, score: str = "ucb_log") -> DataFrame:
    """The best row of each key combination, then the n best of those."""
    return top_rows(keep_best(table, keys, score, tiebreak), [F.desc(score), *[F.asc(t) for t in tiebreak]], n)


def novelty_performance(table: DataFrame, label: Column, ties: Sequence[str], n: int = 10) -> DataFrame:
    """Novelty against upper bound for every candidate; the n highest bounds are labelled, ties by the given columns.

    ``on_front`` marks the candidates that no other one beats in both.
    """
    order = [F.desc("ucb_log"), *[F.asc(t) for t in ties]]
    # the last of the n chosen rows bounds them all
    chosen = table.orderBy(*order).limit(n).agg(F.max(F.struct((-F.col("ucb_log")).alias("u"), *ties)).alias("m")).scalar()
    here = F.struct((-F.col("ucb_log")).alias("u"), *ties) <= chosen
    front = pareto_front(table, "novelty_score", "ucb_log")
    return front.select(
        *ties, "novelty_score", F.expm1("ucb_log").alias("ucb_orig"), F.expm1("pred_median_log").alias("pred_orig"),
        F.when(here, label).alias("annotation"), "on_front",
    )


def pareto_front(df: DataFrame, x: str, y: str, out: str = "on_front") -> DataFrame:
    """All rows, with whether no other row is at least as large in both columns and larger in one.

    Only the largest y of each x can be on the front. These are cut into range buckets of x; the largest y of all
    buckets above (one row per bucket) and a running maximum inside the bucket decide. Equal points are on the front
    together; rows with a NULL in either column are not, and beat nothing.
    """
    spark = df.sparkSession
    df = save_state(df, new_path(spark, "front-rows"))
    best = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("_x")).agg(F.max(y).alias("_y"))
    best = save_state(best, new_path(spark, "front"))
    bucketed = add_range_bucket(best, "_x", range_edges(best, ["_x"], default_buckets(spark))["_x"])
    above = W.partitionBy(F.lit(0)).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    tops = bucketed.groupBy("_bucket").agg(F.max("_y").alias("_top")).select("_bucket", F.max("_top").over(above).alias("_above"))
    inside = W.partitionBy("_bucket").orderBy(F.desc("_x")).rowsBetween(W.unboundedPreceding, -1)
    # one row per bucket, so it may be broadcast
    ranked = bucketed.join(F.broadcast(tops), "_bucket").withColumn("_beat", F.greatest("_above", F.max("_y").over(inside)))
    front = ranked.filter(F.col("_beat").isNull() | (F.col("_y") > F.col("_beat"))).select("_x", F.col("_y").alias("_front"))
    joined = df.join(front, F.col(x) == F.col("_x"), "left")
    return joined.withColumn(out, F.coalesce(F.col(y) == F.col("_front"), F.lit(False))).drop("_x", "_front")
