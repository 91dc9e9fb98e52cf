"""Ridge regression from grouped second moments: one pass serves every fit.

Folds, bootstrap members, learning-curve steps and feature subsets all differ only in which
rows or columns enter the normal equations. The moments are summed once per group on the
executors; what reaches the driver is groups x (features + 2)^2 numbers, never rows. Fit and
validation R2 both follow from the moments, so no second pass is needed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsieve.functions.hashing import DRAWS_PER_DIGEST, digest_draws, poisson1_counts
from gridsieve.functions.ranking import null_safe_join
from gridsieve.session import new_path
from gridsieve.sources.sinks import save_state

FLUSH_GROUPS = 256


@dataclass
class Moments:
    """Weighted second moments of [1, x..., y] around ``shift``, per group key."""

    features: list[str]
    shift: np.ndarray
    by_key: dict[tuple, np.ndarray]
    plain: dict[tuple, np.ndarray] | None = None  # the same without weights

    def unweighted(self) -> "Moments":
        return Moments(self.features, self.shift, self.plain) if self.plain is not None else self

    def total(self, keys: Iterable[tuple] | None = None) -> np.ndarray:
        picked = self.by_key.values() if keys is None else [self.by_key[k] for k in keys]
        return sum(picked, np.zeros((len(self.features) + 2,) * 2))


@dataclass
class RidgeFit:
    features: list[str]
    coefficients: np.ndarray
    intercept: float

    def column(self) -> Column:
        """The prediction as a plain column expression."""
        out = F.lit(float(self.intercept))
        for name, beta in zip(self.features, self.coefficients):
            out = out + F.col(name).cast("double") * F.lit(float(beta))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Appends ``prediction``, so a fit can stand wherever a fitted ML model is expected."""
        return df.withColumn("prediction", self.column())


def _translate(m: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Moment matrices of [1, z + by] from those of [1, z]."""
    t = np.eye(m.shape[-1])
    t[1:, 0] = by
    return t @ m @ t.T


@dataclass
class _Partial:
    """Moment matrices (several kinds stacked) around a centre of the rows seen first."""

    centre: np.ndarray
    m: np.ndarray

    def plus(self, other: _Partial) -> _Partial:
        return _Partial(self.centre, self.m + _translate(other.m, other.centre - self.centre))


#: Partial moments that one merge holds.
MERGED = 64


def _merged(partials: DataFrame, keys: Sequence[str], shape: tuple[int, ...]) -> DataFrame:
    """Partial moments merged per group on the executors, as a tree: (keys, c, m).

    Every task may hold a part of every group. Each round merges the parts of a group in buckets of at most about MERGED
    until one is left, so no task receives all of a hot group, or of the only one.
    """
    spark = partials.sparkSession
    schema = "".join(f"`{k}` {t}, " for k, t in partials.select(*keys).dtypes) + "c array<double>, m array<double>"

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(map(tuple, pdf["c"]), map(tuple, pdf["m"])))
        whole = reduce(_Partial.plus, [_Partial(np.array(c), np.array(m).reshape(shape)) for c, m in rows])
        found = pd.DataFrame({"c": [whole.centre], "m": [whole.m.ravel()]})
        return pd.concat([pdf[list(keys)].head(1).reset_index(drop=True), found], axis=1) if keys else found

    left = save_state(partials, new_path(spark, "partials"))
    while True:
        most = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= MERGED:
            return left.groupBy(*keys).applyInPandas(merge, schema)
        sizes = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / MERGED).cast("int").alias("_n")) if keys else None
        if keys:
            dealt = null_safe_join(left, sizes, keys).withColumn("_bucket", F.pmod(F.xxhash64("c", "m"), F.col("_n")))
        else:
            dealt = left.withColumn("_bucket", F.pmod(F.xxhash64("c", "m"), F.lit(-(-most // MERGED))))
        left = save_state(dealt.groupBy(*keys, "_bucket").applyInPandas(merge, schema), new_path(spark, "partials"))


def _merge(partials: DataFrame, keys: Sequence[str], shape: tuple[int, ...]) -> dict[tuple, _Partial]:
    """The merged moments of every group, one row per group, on the driver."""
    rows = _merged(partials, keys, shape).collect()
    return {tuple(r[k] for k in keys): _Partial(np.array(r["c"]), np.array(r["m"]).reshape(shape)) for r in rows}


def cv_table(
    df: DataFrame, label: str, fold: str, subsets: Mapping[str, Sequence[str]], weight: str | None = None, alpha: float = 1.0
) -> DataFrame:
    """(model, fold, r2) of every feature subset with each fold held out, from one scan.

    Folds may be as many as there are groups: their moments stay on the executors, which also fit. The driver
    reads one matrix per partition of the folds, their total.
    """
    features = sorted({c for cols in subsets.values() for c in cols})
    partials, shape = _partials(df, features, label, weight, [fold])
    parts = save_state(_merged(partials, [fold], shape), new_path(df.sparkSession, "moments"))

    def fold_parts(pdf: pd.DataFrame) -> list[_Partial]:
        return [_Partial(np.array(c), np.array(m).reshape(shape)) for c, m in zip(pdf["c"], pdf["m"])]

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [p for pdf in batches for p in fold_parts(pdf)]
        if found:
            whole = reduce(_Partial.plus, found)
            yield pd.DataFrame({"c": [whole.centre], "m": [whole.m.ravel()]})

    rows = parts.select("c", "m").mapInPandas(total, "c array<double>, m array<double>").collect()
    schema = f"model string, `{fold}` {dict(parts.dtypes)[fold]}, r2 double"
    if not rows:
        return df.sparkSession.createDataFrame([], schema)
    whole = reduce(_Partial.plus, fold_parts(pd.DataFrame([r.asDict() for r in rows])))
    shift, _ = _common({(): whole}, 0, len(features) + 1)
    everything = _translate(whole.m, whole.centre - shift)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, part in zip(pdf[fold], fold_parts(pdf)):
                own = _translate(part.m, part.centre - shift)
                mom = Moments(features, shift, {})
                for name, cols in subsets.items():
                    fit = solve(mom, everything[-1] - own[-1], alpha, cols)
                    out.append((name, key, r2(mom, own[0], fit)))
            yield pd.DataFrame(out, columns=["model", fold, "r2"])

    return parts.mapInPandas(score, schema)


def _common(parts: Mapping[tuple, _Partial], kind: int, width: int) -> tuple[np.ndarray, dict[tuple, np.ndarray]]:
    """All groups' matrices around one shift, the mean of the first kind's rows."""
    if not parts:
        return np.zeros(width), {}
    weight = sum(p.m[0][0, 0] for p in parts.values())
    mean = sum(p.m[0][1:, 0] + p.m[0][0, 0] * p.centre for p in parts.values())
    shift = mean / weight if weight > 0 else next(iter(parts.values())).centre
    return shift, {k: _translate(p.m[kind], p.centre - shift) for k, p in parts.items()}


def _partials(
    df: DataFrame, features: Sequence[str], label: str, weight: str | None, keys: Sequence[str]
) -> tuple[DataFrame, tuple[int, ...]]:
    """Moments per group and task, unweighted and (with weights) weighted, and the shape of a row's matrices."""
    cols, keys = [*features, label], list(keys)
    clean = df.dropna(subset=cols + ([weight] if weight else []))
    size = len(features) + 2
    names = [f"_z{i}" for i in range(len(cols))]  # plain columns reach the tasks as vectors, an array column as an object per row
    extra = [F.col(weight).cast("double").alias("_w")] if weight else []
    data = clean.select(*keys, *[F.col(c).cast("double").alias(n) for c, n in zip(cols, names)], *extra)
    key_types = "".join(f"`{k}` {t}, " for k, t in data.select(*keys).dtypes) if keys else ""

    def emit(acc: dict) -> pd.DataFrame:
        out = pd.DataFrame({"c": [p.centre for p in acc.values()], "m": [p.m.ravel() for p in acc.values()]})
        for i, k in enumerate(keys):
            out.insert(i, k, [key[i] for key in acc])
        return out

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, _Partial] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            groups = pdf.groupby(keys, dropna=False, sort=False).indices.items() if keys else [((), np.arange(len(pdf)))]
            zs = np.column_stack([pdf[n].to_numpy() for n in names])
            for key, idx in groups:
                key = key if isinstance(key, tuple) else (key,)
                centre = acc[key].centre if key in acc else zs[idx].mean(axis=0)
                block = np.column_stack([np.ones(len(idx)), zs[idx] - centre])
                part = [block.T @ block]
                if weight:
                    part.append(block.T @ (block * pdf["_w"].to_numpy()[idx, None]))
                part = _Partial(centre, np.stack(part))
                acc[key] = acc[key].plus(part) if key in acc else part
            if len(acc) > FLUSH_GROUPS:
                yield emit(acc)
                acc = {}
        if acc:
            yield emit(acc)

    shape = (2 if weight else 1, size, size)
    return data.mapInPandas(partial, key_types + "c array<double>, m array<double>"), shape


def moments(
    df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, keys: Sequence[str] = (),
) -> Moments:
    """Second moments per group, with weights also the unweighted ones, in one scan.

    Rows with a NULL among features, label or weight are left out. Every task centres its sums on the
    first rows it sees, and merging translates them, so the sums stay well conditioned. A group takes
    (features + 2)^2 numbers on the driver, for a few groups; cv_table() serves many.
    """
    partials, shape = _partials(df, features, label, weight, keys)
    parts, width = _merge(partials, list(keys), shape), len(features) + 1
    shift, plain = _common(parts, 0, width)
    if not weight:
        return Moments(list(features), shift, plain)
    return Moments(list(features), shift, _common(parts, 1, width)[1], plain)


def bootstrap_moments(
    df: DataFrame, features: Sequence[str], label: str, key: Column, n_members: int, seed: int = 42,
    weight: str | None = None,
) -> Moments:
    """Moments of all Poisson bootstrap members in one scan, without copying rows per member."""
    cols = [*features, label]
    clean = df.dropna(subset=cols + ([weight] if weight else []))
    size = len(features) + 2
    z = F.array(*[F.col(c).cast("double") for c in cols])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    blocks = -(-n_members // DRAWS_PER_DIGEST)
    data = clean.select(z.alias("_z"), w.alias("_w"), key.cast("string").alias("_k"))
    digests = F.concat(*[digest_draws(F.col("_k"), b, seed) for b in range(blocks)])
    data = data.select("_z", "_w", digests.alias("_d"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc, centre = np.zeros((n_members, size * size)), None
        for pdf in batches:
            if len(pdf):
                zs, ws = np.stack(pdf["_z"].to_numpy()), pdf["_w"].to_numpy()
                centre = zs.mean(axis=0) if centre is None else centre
                counts = poisson1_counts(pdf["_d"], n_members) * ws[:, None]
                for start in range(0, len(zs), 2048):
                    block = zs[start:start + 2048] - centre
                    block = np.column_stack([np.ones(len(block)), block])
                    outer = (block[:, :, None] * block[:, None, :]).reshape(len(block), -1)
                    acc += counts[start:start + 2048].T @ outer
        if centre is not None:
            yield pd.DataFrame({"c": [centre], "m": [acc.ravel()]})

    parts = _merge(data.mapInPandas(partial, "c array<double>, m array<double>"), [], (n_members, size, size))
    if not parts:
        return Moments(list(features), np.zeros(size - 1), {})
    whole = parts[()]
    return Moments(list(features), whole.centre, {(i,): m for i, m in enumerate(whole.m)})


def solve(mom: Moments, matrix: np.ndarray, alpha: float = 1.0, subset: Sequence[str] | None = None) -> RidgeFit:
    """Penalised least squares with a free intercept; ``subset`` restricts the features."""
    names = mom.features if subset is None else list(subset)
    idx = [1 + mom.features.index(n) for n in names]
    sw = matrix[0, 0]
    if sw <= 0:
        raise ValueError("no weighted rows to fit")
    sx, sy = matrix[0, idx], matrix[0, -1]
    a = matrix[np.ix_(idx, idx)] - np.outer(sx, sx) / sw + alpha * np.eye(len(idx))
    b = matrix[idx, -1] - sx * sy / sw
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    x_mean = sx / sw + mom.shift[[i - 1 for i in idx]]
    y_mean = sy / sw + mom.shift[-1]
    return RidgeFit(names, beta, float(y_mean - x_mean @ beta))


def r2(mom: Moments, matrix: np.ndarray, fit: RidgeFit) -> float | None:
    """R2 of a fit on the rows behind a moment matrix; None if the label does not vary."""
    idx = [1 + mom.features.index(n) for n in fit.features]
    offset = fit.intercept + fit.coefficients @ mom.shift[[i - 1 for i in idx]] - mom.shift[-1]
    v = np.zeros(len(matrix))
    v[0], v[idx], v[-1] = offset, fit.coefficients, -1.0
    sst = matrix[-1, -1] - matrix[0, -1] ** 2 / matrix[0, 0]
    return float(1 - v @ matrix @ v / sst) if sst > 0 else None
