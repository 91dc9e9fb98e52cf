"""Dense vector expressions over array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def euclidean(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance of two array<double> columns."""
    squares = F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def feature_vector(cols: Sequence[str]) -> Column:
    """Numeric columns packed as array<double>."""
    return F.array(*[F.col(c).cast("double") for c in cols])
