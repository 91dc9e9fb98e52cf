"""Fitted trees as arrays: scoring many members in one scan, and boosting that stops with patience.

MLlib, or boosting.py over binned rows, fits the trees. MLlib's nodes are read back as small arrays (trees x nodes numbers), so that any number of
fitted ensembles is scored by one map-only pass over the rows, into one array column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsieve.functions.hashing import member_poisson
from gridsieve.operators.ridge import RidgeFit
from gridsieve.operators.split import hash_split
from gridsieve.session import new_path
from gridsieve.sources.sinks import save_state

#: Rows scored at once in a task.
ROWS = 4096


@dataclass
class Forest:
    """Trees over ``features``. A node is a position in arrays of trees x nodes; a leaf is its own child."""

    features: list[str]
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weights: np.ndarray
    depth: int

    def __len__(self) -> int:
        return len(self.weights)

    def each(self, x: np.ndarray) -> np.ndarray:
        """Rows x trees: the weighted output of every tree."""
        out = np.empty((len(x), len(self)))
        # nodes of all trees in one row of numbers, a node's children side by side
        root = np.arange(len(self)) * self.feature.shape[1]
        feature, threshold = self.feature.ravel(), self.threshold.ravel()
        child = np.stack([self.right + root[:, None], self.left + root[:, None]], axis=-1).ravel()
        value = (self.value * self.weights[:, None]).ravel()
        for at in range(0, len(x), ROWS):
            part = np.ascontiguousarray(x[at : at + ROWS])
            node = np.tile(root, (len(part), 1))
            row = np.arange(len(part))[:, None] * part.shape[1]
            for _ in range(self.depth):
                here = part.take(row + feature.take(node)) <= threshold.take(node)
                node = child.take(2 * node + here)
            out[at : at + ROWS] = value.take(node)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.each(x).sum(1)

    def some(self, trees: Sequence[int] | slice) -> Forest:
        """The ensemble of these trees."""
        return Forest(self.features, *[a[trees] for a in (self.feature, self.threshold, self.left, self.right, self.value, self.weights)], self.depth)

    def first(self, n: int) -> Forest:
        """The ensemble of the first n trees."""
        return self.some(slice(n))

    def plus(self, other: Forest) -> Forest:
        """Both ensembles' trees, in order."""
        width = max(self.feature.shape[1], other.feature.shape[1])

        def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b)])

        arrays = [joined(getattr(self, k), getattr(other, k)) for k in ("feature", "threshold", "left", "right", "value")]
        return Forest(self.features, *arrays, np.concatenate([self.weights, other.weights]), max(self.depth, other.depth))

    def transform(self, df: DataFrame) -> DataFrame:
        """Appends ``prediction``, so a forest can stand wherever a fitted ML model is expected."""
        return with_predictions(df, [self], "_p").withColumn("prediction", F.col("_p")[0]).drop("_p")


def read_forest(spark: SparkSession, fitted, features: Sequence[str]) -> Forest:
    """The nodes of a fitted MLlib tree ensemble: one row per node reaches the driver, never rows of the data."""
    model = fitted.stages[-1] if isinstance(fitted, PipelineModel) else fitted
    path = new_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    rows = nodes.select("treeID", "id", "prediction", "leftChild", "rightChild", "split.featureIndex", F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("cut")).collect()
    weights = np.array(model.treeWeights, float)
    width = 1 + max(r.id for r in rows)
    feature, left, right = (np.zeros((len(weights), width), np.int64) for _ in range(3))
    threshold, value = np.zeros((len(weights), width)), np.zeros((len(weights), width))
    for r in rows:
        leaf = r.leftChild < 0
        left[r.treeID, r.id], right[r.treeID, r.id] = (r.id, r.id) if leaf else (r.leftChild, r.rightChild)
        feature[r.treeID, r.id], threshold[r.treeID, r.id] = (0, 0.0) if leaf else (r.featureIndex, r.cut)
        value[r.treeID, r.id] = r.prediction
    if model.__class__.__name__.startswith("RandomForest"):
        weights = np.full(len(weights), 1 / len(weights))
    return Forest(list(features), feature, threshold, left, right, value, weights, model.getOrDefault("maxDepth"))


Member = RidgeFit | Forest


def as_member(spark: SparkSession, fitted) -> Member:
    """A fitted MLlib pipeline (assembler, then trees or a linear model) as a member; members stay as they are."""
    if isinstance(fitted, (RidgeFit, Forest)):
        return fitted
    features, model = fitted.stages[0].getInputCols(), fitted.stages[-1]
    if hasattr(model, "treeWeights"):
        return read_forest(spark, model, features)
    return RidgeFit(list(features), model.coefficients.toArray(), float(model.intercept))


def predictions(x: np.ndarray, features: Sequence[str], members: Sequence[Member]) -> np.ndarray:
    """Rows x members, for rows with ``features`` as columns."""
    at = {c: i for i, c in enumerate(features)}
    out = np.empty((len(x), len(members)))
    for k, m in enumerate(members):
        own = x[:, [at[c] for c in m.features]]
        out[:, k] = m.predict(own) if isinstance(m, Forest) else own @ m.coefficients + m.intercept
    return out


def with_predictions(
    df: DataFrame, members: Sequence[Member], out: str = "preds", reduce: Callable[[np.ndarray], np.ndarray] | None = None
) -> DataFrame:
    """Appends the predictions of all members as one array: one map-only scan whatever their number.

    ``reduce`` takes rows x members and gives the rows of the array that is appended instead.
    """
    members = [as_member(df.sparkSession, m) for m in members]
    features = sorted({c for m in members for c in m.features})

    @F.pandas_udf("array<double>")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        found = predictions(x, features, members)
        return pd.Series(list(reduce(found) if reduce else found))

    return df.withColumn(out, score(*[F.col(c).cast("double") for c in features]))


@dataclass
class Boosted:
    """A boosted ensemble cut at its best round, with the held-out curve that led there."""

    forest: Forest
    curve: list[float]
    best_round: int
    rounds_used: int
    every: Forest

    def transform(self, df: DataFrame) -> DataFrame:
        return self.forest.transform(df)


def stop_round(curve: Sequence[float], patience: int) -> tuple[int, int, bool]:
    """(best round, rounds looked at, whether patience ran out) of a curve of held-out errors, rounds from 1."""
    best = 0
    for t, error in enumerate(curve):
        if error < curve[best]:
            best = t
        if t - best >= patience:
            return best + 1, t + 1, True
    return best + 1, len(curve), False


def boost(
    df: DataFrame, features: Sequence[str], label: str, key: Column, weight: str | None = None, max_rounds: int = 1000,
    patience: int = 50, block: int = 25, eval_share: float = 0.10, seed: int = 42, **params,
) -> Boosted:
    """Boosted trees for squared error that stop when ``patience`` rounds bring no better held-out error.

    Rows are binned and summed to cells once (boosting.bin_rows); a round takes one job per level over the cells, which also
    gives the held-out error after it. ``block`` rounds at most are made anew when a part of them is lost; the result does not
    depend on it.
    """
    from gridsieve.operators import boosting

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    split = hash_split(df.withColumn("_w", w), key, eval_share, seed, out="_part")
    rows = split.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).alias("_y"), "_w", (F.col("_part") == "test").alias("_held"))
    rows = save_state(rows, new_path(df.sparkSession, "boost"))
    cells = boosting.bin_rows(rows, features, "_y", [(~F.col("_held")).cast("int"), F.col("_held").cast("int")], "_w")
    plan, curve = boosting.Plan([0], 1, maxIter=max_rounds, seed=seed, **params), []
    growing = boosting.grow(cells, [plan], block)
    for done, held, grown in growing:
        total, error, _ = held[0]
        curve.append(float(error / total) if total else 0.0)
        best, used, stopped = stop_round(curve, patience)
        if stopped or done:
            every = grown(0)
            growing.close()
            return Boosted(every.first(best), curve, best, used, every)
    raise ValueError("max_rounds must be at least 1")


def bootstrap_forests(
    df: DataFrame, features: Sequence[str], label: str, key: Column, n_members: int, seed: int = 42, **params
) -> list[Forest]:
    """Bootstrap members of boosted trees, ready to be scored in one scan.

    Rows are summed to cells once, with a weight per member, and all members grow side by side.
    """
    from gridsieve.operators import boosting

    slim = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).alias("_y"), key.alias("_key"))
    slim = save_state(slim, new_path(df.sparkSession, "bootstrap"))
    draws = [member_poisson(F.col("_key"), b, seed) for b in range(n_members)]
    cells = boosting.bin_rows(slim, features, "_y", draws, held=False)
    return boosting.grow_all(cells, [boosting.Plan([b], seed=42, **params) for b in range(n_members)])[0]
