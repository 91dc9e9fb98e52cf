"""Column roles and schema shaping: which columns are features, and making tables fit a feature list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnRoles:
    """Roles by column name. Everything without a role is a feature."""

    # The default column roles.
    target: str = "HER_std_umol_g_h"
    log_target: str = "log_HER"
    key: str = "experiment_hash"
    leakage: tuple[str, ...] = ("AQY_pct", "AQE_pct", "STH_pct", "HER_reported")
    provenance: tuple[str, ...] = (
        "DOI", "source_url", "paper_title", "journal", "year", "authors", "reference_match_check",
        "data_quality_flag", "data_quality_note", "experiment_hash", "full_catalyst", "HER_reported", "log_HER",
        "metadata_completeness_score", "catalyst_loading_reported", "glycerol_concentration_reported",
        "light_power_reported", "irradiance_reported",
    )
    material: tuple[str, ...] = ("host_material", "co_catalyst")
    confidence: tuple[str, ...] = (
        "confidence_HER", "confidence_loading", "confidence_light", "confidence_wavelength",
    )
    confidence_prefix: str = "confidence_"
    categorical: tuple[str, ...] = (
        "host_material", "co_catalyst", "semiconductor_2", "semiconductor_3", "form", "structure",
        "preparation_semiconductor", "preparation_photocatalyst", "sacrificial_donor", "reactor_type",
        "water_source", "light_source_type", "light_type",
    )
    identifiers: tuple[str, ...] = ("row_id",)

    def is_feature(self, name: str) -> bool:
        taken = {
            self.target, self.log_target, self.key, *self.leakage, *self.provenance, *self.material,
            *self.confidence, *self.identifiers,
        }
        return name not in taken and not (self.confidence_prefix and name.startswith(self.confidence_prefix))

    def features(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if self.is_feature(c)]

    def split_kinds(self, df: DataFrame) -> tuple[list[str], list[str]]:
        """(numeric, categorical) features; listed categoricals and strings are categorical."""
        numeric, text = [], []
        for field in df.schema.fields:
            if self.is_feature(field.name):
                is_text = field.name in self.categorical or isinstance(field.dataType, T.StringType)
                (text if is_text else numeric).append(field.name)
        return numeric, text


def select_features(df: DataFrame, roles: ColumnRoles, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[c for c in roles.features(df) if c not in keep])


def drop_by_suffix(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Drops the columns ending in the suffix, except those listed."""
    return df.drop(*[c for c in df.columns if c.endswith(suffix) and c not in keep])


def alias_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renames columns of one schema to those of another; absent ones are ignored."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


def complete_schema(df: DataFrame, required: Mapping[str, Column | float | str | None]) -> DataFrame:
    """Adds every missing required column with its default; present columns stay as they are."""
    missing = {c: (v if isinstance(v, Column) else F.lit(v)) for c, v in required.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def reindex(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly the given columns in the given order; absent ones are NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])
