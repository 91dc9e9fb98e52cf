"""Feature attribution: exact linear contributions, permutation importance and their summaries."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridsieve.functions.ranking import hash_rank
from gridsieve.operators import forest, metrics
from gridsieve.operators.ridge import RidgeFit
from gridsieve.sources.sinks import save_state


def linear_contributions(df: DataFrame, row: Sequence[str], betas: Mapping[str, float], background: DataFrame | None = None) -> DataFrame:
    """Long (row, feature, value, phi) with phi = beta * (x - mean): exact Shapley values of a linear model."""
    base = background if background is not None else df
    means = base.agg(F.struct(*[F.avg(F.col(c).cast("double")).alias(c) for c in betas]).alias("m")).scalar()
    packed = F.array(*[
        F.struct(
            F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
            (F.lit(float(b)) * (F.col(c).cast("double") - means[c])).alias("phi"),
        )
        for c, b in betas.items()
    ])
    return df.select(*row, F.explode(packed).alias("s")).select(*row, "s.*")


def _ranks(keys: np.ndarray, draw: int, n: int) -> np.ndarray:
    """Features x rows: hashes of (row key, draw, feature). A row's features follow each other by these, equal ones by place."""
    steps = np.uint64(0x9E3779B97F4A7C15) * (np.uint64(draw * n + 1) + np.arange(n, dtype=np.uint64))
    x = keys.astype(np.uint64)[None, :] + steps[:, None]
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


#: Numbers of one table of predictions.
TABLE = 1 << 20


class _LineSteps:
    """A linear member: each replaced feature moves the prediction by a number of its own."""

    def __init__(self, fitted: RidgeFit, background: np.ndarray):
        self.slopes, self.background = np.asarray(fitted.coefficients, float), background
        self.begin = background @ self.slopes + fitted.intercept

    def moves(self, x: np.ndarray) -> np.ndarray:
        return self.slopes[:, None] * (x - self.background[:, :, None])

    def predictions(self, draw: int, at: np.ndarray) -> np.ndarray:
        return self.begin[draw] + at


class _TreeSteps:
    """Trees: the predictions of all mixtures of a row with a background row, as a table per background row.

    Trees see a feature only through its place between their thresholds. A mixture is a number with one digit per feature: 0 for the
    background row's value, else one more than the place of the row's, so that replacing a feature adds to the number.
    """

    def __init__(self, trees: forest.Forest, cuts: list[np.ndarray], background: np.ndarray):
        self.cuts, sizes = cuts, [len(c) + 2 for c in cuts]
        self.strides = np.cumprod([1, *sizes[:-1]])
        digits = np.arange(np.prod(sizes))[:, None] // self.strides % sizes
        own = np.column_stack([np.r_[np.nan, c, np.inf].take(d) for c, d in zip(cuts, digits.T, strict=True)])
        self.tables = [trees.predict(np.where(digits == 0, base, own)) for base in background]

    def moves(self, x: np.ndarray) -> np.ndarray:
        return np.stack([(np.searchsorted(c, v) + 1) * s for c, v, s in zip(self.cuts, x, self.strides, strict=True)])[None]

    def predictions(self, draw: int, at: np.ndarray) -> np.ndarray:
        return self.tables[draw].take(at)


def _cuts(trees: forest.Forest) -> list[np.ndarray]:
    """The thresholds of each feature."""
    inner = trees.left != np.arange(trees.left.shape[1])
    return [np.unique(trees.threshold[inner & (trees.feature == i)]) for i in range(len(trees.features))]


def _steps(fitted: forest.Member, background: np.ndarray) -> list[_LineSteps | _TreeSteps] | None:
    """Parts whose predictions add up to the member's: as many trees in one as its tables allow; None if one tree is too much."""
    if not isinstance(fitted, forest.Forest):
        return [_LineSteps(fitted, background)]
    parts: list[tuple[forest.Forest, list[np.ndarray], list[int]]] = []
    for i in range(len(fitted)):
        for wanted in ([*parts[-1][2], i], [i]) if parts else ([i],):
            trees = fitted.some(wanted)
            cuts = _cuts(trees)
            if np.prod([len(c) + 2.0 for c in cuts]) * len(background) <= TABLE:
                parts[len(parts) - (len(wanted) > 1) :] = [(trees, cuts, wanted)]
                break
        else:
            return None
    return [_TreeSteps(trees, cuts, background) for trees, cuts, _ in parts]


def _from_steps(steps: list[_LineSteps | _TreeSteps], x: np.ndarray, keys: np.ndarray, n_draws: int) -> np.ndarray:
    """Rows x features: the values of some rows. The features before one in an order are behind it in the reverse."""
    n = x.shape[1]
    phi, columns = np.zeros((n, len(x))), np.ascontiguousarray(x.T)
    moved = [part.moves(columns) for part in steps]  # of every background row, or the same for all
    for draw in range(n_draws):
        ranks = _ranks(keys, draw, n)
        earlier = {(i, j): ranks[i] <= ranks[j] for j in range(n) for i in range(j)}
        for part, own in zip(steps, moved, strict=True):
            moves = own[draw % len(own)]
            before = np.zeros_like(moves)
            for (i, j), first in earlier.items():
                before[j] += moves[i] * first
                before[i] += moves[j] * ~first
            whole = moves.sum(0)
            for j, move in enumerate(moves):
                behind = whole - before[j]
                phi[j] += part.predictions(draw, before[j] + move) - part.predictions(draw, before[j])
                phi[j] += part.predictions(draw, behind) - part.predictions(draw, behind - move)
    return phi.T / (2 * n_draws)


def _from_paths(fitted: forest.Member, background: np.ndarray, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rows x features: the same by scoring every mixture, for trees whose tables would be too large."""
    features, n = fitted.features, x.shape[1]
    phi, starts = np.zeros(x.size), np.arange(len(x)) * n
    # where every path ends and where those of a background row begin
    whole, begin = forest.predictions(x, features, [fitted])[:, 0], forest.predictions(background, features, [fitted])[:, 0]
    for draw, base in enumerate(background):
        order = np.argsort(_ranks(keys, draw, n).T, axis=1, kind="stable")
        for path in (order, order[:, ::-1]):
            z = np.tile(base, (len(x), 1))
            flat = z.reshape(-1)
            before = begin[draw]
            for step in range(n):
                at = starts + path[:, step]
                flat[at] = x.take(at)
                after = forest.predictions(z, features, [fitted])[:, 0] if step < n - 1 else whole
                phi[at] += after - before
                before = after
    return phi.reshape(x.shape) / (2 * len(background))


def sampled_contributions(
    df: DataFrame, row: Sequence[str], fitted: forest.Member, background: np.ndarray, key: Column, family: Sequence[str] = (),
    path: str | None = None,
) -> DataFrame:
    """Long (row, feature, value, phi): Shapley values of any fitted member from sampled feature orders, map-only.

    Each background row (in the order of ``fitted.features``, a bounded sample) is paired with one order per row and its
    reverse, both decided by the hash of the row's key: the features of the row replace those of the background row one
    after the other, and a feature is credited with the change it makes. The values of a row sum to its prediction
    minus the mean prediction of the background, and are exact for additive models.

    With a ``path``, one row per row of ``df`` is written there, with arrays ``value`` and ``phi`` in the order of the features,
    and the long table is made from these.
    """
    features, kept = list(fitted.features), [*row, *family]
    n = len(features)
    steps = _steps(fitted, background)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.columns[len(kept) :]
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in numbers[:n]], 1)
            keys = numbers[n].to_numpy()
            phi = _from_paths(fitted, background, x, keys) if steps is None else _from_steps(steps, x, keys, len(background))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * n)
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(a).ravel(), from_pandas=True)) for a in (x, phi)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], [*kept, "value", "phi"])

    slim = df.select(*kept, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)], F.xxhash64(key).alias("_h"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*kept).schema.fields)
    found = slim.mapInArrow(explain, f"{kinds}, value array<double>, phi array<double>")
    if path is not None:
        found = save_state(found, path)
    names = F.array(*[F.lit(c) for c in features])
    return found.select(*kept, F.inline(F.arrays_zip(names.alias("feature"), "value", "phi")))


def background_rows(df: DataFrame, features: Sequence[str], key: Column, n: int = 16) -> np.ndarray:
    """At most n rows of the features, those of smallest key hash."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.xxhash64(key).alias("_h"), key.cast("string").alias("_k"))
    got = rows.orderBy("_h", "_k").limit(n).collect()
    return np.array([[r[c] for c in features] for r in got], float).reshape(-1, len(features))


def mean_abs(phi: DataFrame, by: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """Mean |phi| per feature (and family), optionally the k largest per family; signed mean and direction beside it."""
    out = phi.groupBy(*by, "feature").agg(
        F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean_phi")
    ).withColumn("direction", F.when(F.col("mean_phi") > 0, "positive").otherwise("negative"))
    if top is None:
        return out
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(F.desc("mean_abs"), "feature")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def local_top(phi: DataFrame, row: Sequence[str], k: int = 8) -> DataFrame:
    """The k largest |phi| of each row (a row holds one value per feature)."""
    w = W.partitionBy(*row).orderBy(F.desc(F.abs("phi")), "feature")
    return phi.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dependence(phi: DataFrame, top: int = 5, bins: int = 20, digits: int | None = None) -> DataFrame:
    """Mean phi by equal-width bin of the value, for the ``top`` features by mean |phi|.

    (feature, bin, n_rows, mean_value, mean_phi). ``digits`` sums values of at most so many decimals exactly,
    so that their mean does not depend on the order of summation. The table of features has one row per
    feature, a few numbers each, so it may be broadcast; the long table is only shuffled by (feature, bin),
    after partial sums.
    """
    stats = phi.groupBy("feature").agg(
        F.avg(F.abs("phi")).alias("_abs"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    chosen = stats.orderBy(F.desc("_abs"), "feature").limit(top).drop("_abs")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    bin_ = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    value = F.col("value") if digits is None else F.col("value").cast(f"decimal(24,{digits})")
    return phi.join(F.broadcast(chosen), "feature").groupBy("feature", bin_.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(value).cast("double").alias("mean_value"), F.avg("phi").alias("mean_phi")
    )


def permutation_importance(
    df: DataFrame, features: Sequence[str], label: str, fitted: Model, key: Column, seed: int = 42
) -> DataFrame:
    """(feature, r2, drop): loss of R2 when one feature is taken from another row.

    Two independent hash orders pair every row with a random partner. Each row is then scored
    once per feature with that feature swapped: one join and one map-side scoring pass.
    """
    here = hash_rank(df.select(*features, label, key.alias("_key")), F.col("_key"), seed, rank="_pos")
    there = hash_rank(df.select(*features, key.alias("_key")), F.col("_key"), f"{seed}p", rank="_pos")
    partner = there.select("_pos", F.struct(*features).alias("_other"))
    paired = here.select("_pos", label, *features).join(partner, "_pos")
    variants = F.array(F.lit("(none)"), *[F.lit(c) for c in features])
    long = paired.withColumn("feature", F.explode(variants))
    swapped = long.withColumns({
        c: F.when(F.col("feature") == c, F.col(f"_other.{c}")).otherwise(F.col(c)).cast("double") for c in features
    })
    scores = fitted.transform(swapped).groupBy("feature").agg(metrics.r2_expr(label, "prediction").alias("r2"))
    base = scores.filter(F.col("feature") == "(none)").agg(F.max("r2").alias("r")).scalar()
    return scores.filter(F.col("feature") != "(none)").select("feature", "r2", (base - F.col("r2")).alias("drop"))
