"""Raw experiment table to clean features: filter, deduplicate, enrich, split, weigh, impute, encode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsieve.functions.text import normalise
from gridsieve.operators import curate, encode
from gridsieve.operators.lookup import add_physical_features, sample_weight
from gridsieve.operators.roles import ColumnRoles, complete_schema, drop_by_suffix
from gridsieve.operators.split import add_quantile_bin, kfold, stratified_split
from gridsieve.session import new_path
from gridsieve.sources.sinks import load_state, save_state


@dataclass
class FeatureState:
    """What scoring needs from training: the feature list, medians and target encodings."""

    numeric: list[str]
    categorical: list[str]
    medians: DataFrame
    encodings: DataFrame  # (column, value, encoding, global_mean)
    global_mean: float

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def save(self, folder: str) -> "FeatureState":
        """Writes medians and encodings as parquet and returns the state as read back."""
        medians = save_state(self.medians, f"{folder}/medians")
        encodings = save_state(self.encodings, f"{folder}/encodings")
        return FeatureState(self.numeric, self.categorical, medians, encodings, self.global_mean)

    @staticmethod
    def load(spark, folder: str, numeric: list[str], categorical: list[str]) -> "FeatureState":
        encodings = load_state(spark, f"{folder}/encodings")
        first = encodings.select("global_mean").first()
        return FeatureState(
            numeric, categorical, load_state(spark, f"{folder}/medians"), encodings, first[0] if first else 0.0
        )


def drop_steps(roles: ColumnRoles, min_year: int = 2000, bad_flag: str = "LIKELY_ERROR"):
    """The row filters as named keep-conditions, in order (for lineage counts)."""
    target = F.col(roles.target)
    return [
        ("year", F.col("year") >= F.lit(min_year)),
        ("quality_flag", ~F.col("data_quality_flag").eqNullSafe(F.lit(bad_flag))),
        ("target", target.isNotNull() & (target > 0)),
    ]


def curate_experiments(
    raw: DataFrame, roles: ColumnRoles = ColumnRoles(), min_year: int = 2000, bad_flag: str = "LIKELY_ERROR",
    score: str = "metadata_completeness_score", max_null_share: float = 0.95,
) -> DataFrame:
    """Property lookup on the raw names, row filters, deduplication, column pruning, text normalisation, log target."""
    df = add_physical_features(raw)
    df = curate.at_least(df, "year", min_year)
    df = curate.not_equal_keep_null(df, "data_quality_flag", bad_flag)
    df = curate.positive(df, roles.target)
    if roles.key in df.columns:
        df = curate.keep_best(df, [roles.key], score, [c for c in roles.identifiers if c in df.columns])
    protected = [roles.target, score, *roles.confidence, *roles.identifiers]
    df = curate.prune_columns(df, max_null_share, protected)
    text = [c for c, t in df.dtypes if t == "string"]
    df = df.withColumns({c: normalise(c) for c in text})
    return df.withColumn(roles.log_target, F.log1p(roles.target))


def split_and_weigh(
    clean: DataFrame, roles: ColumnRoles = ColumnRoles(), row_id: str = "row_id", test_share: float = 0.15,
    seed: int = 42, bins: int = 10, score: str = "metadata_completeness_score",
) -> DataFrame:
    """Adds ``split`` (stratified on the target's quantile bins) and the sample weight ``w``."""
    binned = add_quantile_bin(clean, roles.log_target, bins, "_bin")
    out = stratified_split(binned, F.col(row_id), "_bin", test_share, seed).drop("_bin")
    return out.withColumn("w", sample_weight(score, [c for c in roles.confidence if c in clean.columns]))


def fit_features(
    table: DataFrame, roles: ColumnRoles = ColumnRoles(), row_id: str = "row_id", n_folds: int = 5, seed: int = 42,
    folder: str | None = None,
) -> tuple[DataFrame, FeatureState]:
    """Imputed, encoded features of both splits and the fitted state (fitted on training rows only).

    The split table, the state and the features are written below ``folder`` (a fresh path in
    the shared folder by default): each is read several times later, and a written table
    survives the loss of executors.
    """
    folder = folder or new_path(table.sparkSession, "features")
    numeric, categorical = roles.split_kinds(table.drop("split", "w"))
    filled = table.withColumns({c: F.coalesce(c, F.lit("missing")) for c in categorical})
    filled = kfold(filled, F.col(row_id), n_folds, seed, out="_fold")
    filled = save_state(
        filled.select(row_id, "split", "w", roles.log_target, "_fold", *numeric, *categorical), f"{folder}/split"
    )
    train, test = filled.filter("split = 'train'"), filled.filter("split = 'test'")
    medians = save_state(encode.fit_medians(train, numeric), f"{folder}/medians")
    inside, full, centre = encode.fit_encodings(train, categorical, roles.log_target, "_fold", f"{folder}/encodings")
    both = encode.apply_encodings(train, inside, categorical, centre, "_fold").unionByName(
        encode.apply_encodings(test, full, categorical, centre)
    )
    both = encode.apply_medians(both, medians, numeric)
    state = FeatureState(numeric, categorical, medians, full, centre)
    out = both.select(row_id, "split", "w", F.col(roles.log_target).alias("y"), *state.features)
    return save_state(out, f"{folder}/features"), state


def prepare_features(df: DataFrame, state: FeatureState, default_text: str = "missing") -> DataFrame:
    """New rows in the trained feature space: complete, normalise, encode, impute. Map-only but for dimension joins."""
    df = drop_by_suffix(df, "_reported", keep=["HER_reported"])
    nothing = F.lit(None)
    df = complete_schema(df, {c: nothing.cast("double") for c in state.numeric})
    df = complete_schema(df, {c: F.lit(default_text) for c in state.categorical})
    df = df.withColumns({c: F.coalesce(normalise(c), F.lit("missing")) for c in state.categorical})
    df = encode.apply_encodings(df, state.encodings, state.categorical, state.global_mean)
    df = df.withColumns({c: F.col(c).cast("double") for c in state.numeric})
    return encode.apply_medians(df, state.medians, state.numeric)
