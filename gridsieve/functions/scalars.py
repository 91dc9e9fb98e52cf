"""Numeric scalar expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    return F.nanvl(_col(c), F.lit(None).cast("double"))


def clip(c: str | Column, lo: float | None, hi: float | None) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    c = _col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def expm1_clipped(c: str | Column, floor: float = 0.0) -> Column:
    """Back-transform of log1p, not below ``floor``."""
    return clip(F.expm1(_col(c)), floor, None)


def to_number(c: str | Column) -> Column:
    """Numeric coercion; text that is no number becomes NULL, as does NaN."""
    return nan_to_null(_col(c).try_cast("double"))


def any_positive(columns: Sequence[str | Column]) -> Column:
    """1 if any column holds a positive number (text is coerced), else 0."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(to_number(_col(c).cast("string")) > 0, F.lit(False))
    return hit.cast("int")


def cut(c: str | Column, edges: Sequence[float], labels: Sequence[object]) -> Column:
    """Right-closed binning: label i for edges[i-1] < x <= edges[i]; NULL stays NULL."""
    c = _col(c)
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(c <= F.lit(float(edge)), F.lit(label)).otherwise(out)
    return F.when(c.isNotNull(), out)


def relative_width(width: Column, centre: Column) -> Column:
    """Interval width relative to its centre, or the plain width for centres at or below 0."""
    return F.when(centre > 0, width / centre).otherwise(width)


def upper_bound(median: Column, lo: Column, hi: Column, kappa: float = 1.0) -> Column:
    """Upper confidence bound: median plus kappa half-widths."""
    return median + F.lit(float(kappa)) * (hi - lo) / F.lit(2.0)


def composition_label(host: str | Column, partner: str | Column, amount: str | Column, unit: str = "wt%") -> Column:
    """``host/partner (amount unit)``."""
    return F.concat(
        _col(host).cast("string"), F.lit("/"), _col(partner).cast("string"),
        F.lit(" ("), _col(amount).cast("string"), F.lit(f" {unit})"),
    )


def bool_label(c: str | Column, when_true: str, when_false: str) -> Column:
    c = _col(c)
    return F.when(c, F.lit(when_true)).when(~c, F.lit(when_false))
