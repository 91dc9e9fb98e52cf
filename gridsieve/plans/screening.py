"""Scoring of new rows and screening of generated candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsieve.functions.hashing import row_key
from gridsieve.functions.vectors import feature_vector
from gridsieve.operators import candidates as C
from gridsieve.operators import learn, neighbors
from gridsieve.operators.lookup import add_physical_features
from gridsieve.operators.forest import Member
from gridsieve.operators.roles import alias_columns
from gridsieve.plans.curation import FeatureState, prepare_features
from gridsieve.sources import dims


def score_rows(
    df: DataFrame, state: FeatureState, fitted, members: Sequence[Member] = (), keep: Sequence[str] = ("row_id",),
) -> DataFrame:
    """Batch scoring: enrich, shape to the feature space, predict; with members also p10/p50/p90 on both scales.

    rank_by_prediction orders the result: by the median where there are members, else by the prediction.
    """
    prepared = prepare_features(add_physical_features(df), state)
    scored = learn.score(fitted, prepared, "pred_log")
    if members:
        scored = learn.original_scale(learn.ensemble_interval(scored, members, (0.1, 0.5, 0.9), ("p10_log", "p50_log", "p90_log")))
    return scored.select(*keep, *[c for c in scored.columns if c.startswith(("pred_", "p10", "p50", "p90", "width_"))])


@dataclass
class Screening:
    table: DataFrame
    top: DataFrame


def screen_candidates(
    spark: SparkSession, state: FeatureState, members: Sequence[Member], train: DataFrame,
    grid: Mapping[str, Sequence] = dims.CANDIDATE_GRID, pairs: Mapping[str, Sequence[str]] = dims.HETEROJUNCTION_PAIRS,
    aliases: Mapping[str, str] = dims.CANDIDATE_ALIASES, q_hat: DataFrame | float | None = None, seed: int = 42,
    target: str | None = None, n_top: int = 100, k: int = 5,
) -> Screening:
    """Generates the grid, scores it with the ensemble and ranks it by upper confidence bound.

    Candidates go through the same feature preparation as the training rows, so every grid
    column reaches the features. ``train`` holds the prepared training features and the raw
    target; with ``q_hat`` the interval is the conformal one around the ensemble median.
    """
    raw = C.candidate_grid(spark, grid)
    host, partner, amount = list(grid)[:3]
    named = alias_columns(raw.withColumn("_amount", F.col(amount)), aliases)
    named = named.withColumn("semiconductor_2", C.pick_partner(host, pairs, row_key(["row_id"]), seed))
    labels = named.select("row_id", F.col(host).alias("_host"), F.col(partner).alias("_partner"))
    prepared = prepare_features(add_physical_features(named), state, default_text="unknown")
    scored = learn.ensemble_interval(prepared, members)
    scored = scored.withColumn("_vec", feature_vector(state.features))
    reference = train.select("row_id", feature_vector(state.features).alias("_vec"))
    scored = neighbors.novelty_score(scored, reference, "_vec", k)
    scored = scored.drop("_vec")
    scored = scored.join(labels, "row_id")
    if q_hat is not None:
        scored = C.conformal_rescore(scored, "pred_median_log", q_hat)
    table = C.screening_table(
        scored, "_host", "_partner", "_amount", train if target else None, target, keep_ucb=q_hat is not None
    )
    cols = [
        "row_id", F.col("_host").alias(host), F.col("_partner").alias(partner), F.col("_amount").alias(amount),
        "pred_median_log", "pred_p05_log", "pred_p95_log", "ucb_log", "novelty_score", "pred_orig", "ucb_orig",
        "composition", "confidence",
    ]
    table = table.select(*cols)
    return Screening(table, C.best_candidates(table, [host, partner], ["row_id"], n_top))
