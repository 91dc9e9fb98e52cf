"""Boosted trees over binned rows: many ensembles grow side by side, one Spark job for one to three levels of a tree.

Trees with at most 32 bins a feature see a row only through its bins, and squared error needs sums of labels only. Rows
with the same bins are therefore summed once to a cell, for every fold or bootstrap member; folds, trials and
members grow from the same cells. The cells are dealt to the executors in blocks. A job adds up sums per node over the
bins of each set of one, two or three features, from which the driver picks the splits of as many levels: those of a node's
children are parts of the sums over a pair. Gain, shrinkage and stopping of a node are those of
MLlib's GBTRegressor: the first tree counts whole, later ones fit twice the residual and count ``stepSize``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from gridsieve.functions import ranking
from gridsieve.operators.forest import Forest
from gridsieve.session import new_path
from gridsieve.sources.sinks import save_state

BINS = 32
#: Blocks of cells that a task reads, on average at most.
BLOCKS = 64
#: Numbers that all tasks of a job send to the driver together, about; if even one level takes more, tasks add them up before.
SENT = 1 << 21
#: Sums of a cell per slot; rows and weighted labels serve the fits, the others the held-out errors.
SUMS = ("n", "w", "wy", "wyy", "y", "yy")
N, W, WY, WYY, Y, YY = range(6)


@dataclass
class Plan:
    """An ensemble to grow, with MLlib's parameters: from which slots it learns and which one it is scored on."""

    slots: Sequence[int]
    held: int | None = None
    maxIter: int = 20
    maxDepth: int = 5
    stepSize: float = 0.1
    subsamplingRate: float = 1.0
    featureSubsetStrategy: str = "all"
    minInstancesPerNode: int = 1
    seed: int = 42

    def n_features(self, d: int) -> int:
        if self.featureSubsetStrategy in ("all", "auto"):
            return d
        return min(d, max(1, int(np.ceil(float(self.featureSubsetStrategy) * d))))


@dataclass
class Cells:
    """Binned rows summed per combination of bins and slot, written; labels are taken from ``centre``."""

    table: DataFrame
    features: list[str]
    edges: list[np.ndarray]
    n_slots: int
    centre: float

    def sst(self) -> list[float]:
        """Sum of squares of the labels of each slot around their mean."""
        row = self.table.agg(*[F.sum(f"s{s}_{k}").alias(f"s{s}_{k}") for s in range(self.n_slots) for k in ("n", "y", "yy")]).first()
        parts = [[row[f"s{s}_{k}"] or 0.0 for k in ("n", "y", "yy")] for s in range(self.n_slots)]
        return [yy - y * y / n if n else 0.0 for n, y, yy in parts]


def r2(held: tuple[float, float, float], sst: float) -> float | None:
    """R2 of an ensemble from its held-out sums; None if the labels do not vary."""
    return float(1 - held[2] / sst) if sst > 0 else None


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of the bins but the last: between all values of a feature if they are few, else near-equal-count cuts."""
    columns = list(features)

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [np.zeros(0)] * len(columns)
        for pdf in batches:
            for i, c in enumerate(columns):
                if len(seen[i]) <= bins:
                    seen[i] = np.unique(np.r_[seen[i], pdf[c].to_numpy(float)])[: bins + 1]
        yield pd.DataFrame({"at": range(len(columns)), "v": [v.tolist() for v in seen]})

    slim = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    tasks = slim.mapInPandas(values, "at int, v array<double>")
    # at most bins + 1 values per feature and task are merged
    found = tasks.select("at", F.explode("v").alias("v")).distinct().groupBy("at").agg(F.slice(F.array_sort(F.collect_set("v")), 1, bins + 1).alias("v"))
    few = {r["at"]: np.array(r["v"]) for r in found.collect()}
    many = [c for i, c in enumerate(columns) if len(few.get(i, ())) > bins]
    cuts = ranking.range_edges(slim, many, bins, 10_000) if many else {}
    return [np.array(cuts[c]) if c in cuts else (few[i][1:] + few[i][:-1]) / 2 if i in few else np.zeros(0) for i, c in enumerate(columns)]


def bin_rows(
    df: DataFrame, features: Sequence[str], label: str, slots: Sequence[Column], weight: str | None = None, held: bool = True
) -> Cells:
    """Cells of a written table. ``slots`` say how often a row counts in a fold, part or bootstrap member.

    A null or NaN among the features, labels or weights is an error, as in MLlib.
    """
    features = list(features)
    edges = bin_edges(df, features)
    y, w = F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    centre = df.agg(F.avg(y)).first()[0] or 0.0
    numbers = [y, w, *[F.col(c).cast("double") for c in features]]
    bad = reduce(or_, [c.isNull() | F.isnan(c) for c in numbers])
    number = F.when(bad, F.raise_error(F.lit("features, labels and weights must be numbers"))).otherwise(y - F.lit(centre))
    columns = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    coded = df.select(*columns, number.alias("y"), w.alias("w"), *[c.cast("double").alias(f"c{s}") for s, c in enumerate(slots)])
    # a bucket holds its lower end; the next number above an edge makes it hold the upper one
    splits = [[-np.inf, *np.nextafter(e, np.inf).tolist(), np.inf] for e in edges]
    cut = [i for i, e in enumerate(edges) if len(e)]
    if cut:
        coded = Bucketizer(
            splitsArray=[splits[i] for i in cut], inputCols=[f"x{i}" for i in cut], outputCols=[f"_b{i}" for i in cut], handleInvalid="error"
        ).transform(coded)
    codes = [(F.col(f"_b{i}") if i in cut else F.lit(0)).cast("int").alias(f"b{i}") for i in range(len(features))]
    coded = coded.select(*codes, "y", "w", *[f"c{s}" for s in range(len(slots))])
    parts = {"n": F.lit(1.0), "w": F.col("w"), "wy": F.col("w") * F.col("y"), "wyy": F.col("w") * F.col("y") * F.col("y"), "y": F.col("y"), "yy": F.col("y") * F.col("y")}
    sums = [
        F.sum(((F.col(f"c{s}") > 0).cast("double") if k == "n" else F.col(f"c{s}")) * parts[k]).alias(f"s{s}_{k}")
        for s in range(len(slots)) for k in SUMS[: 6 if held else 3]
    ]
    table = coded.groupBy(*[f"b{i}" for i in range(len(features))]).agg(*sums)
    return Cells(save_state(table, new_path(df.sparkSession, "cells")), features, edges, len(slots), centre)


def _blocks(cells: Cells, n_plans: int) -> RDD:
    """(codes, sums, margins) of the cells, dealt in blocks; margins are cells x ensembles, zero at first."""
    d, spark = len(cells.features), cells.table.sparkSession
    names = cells.table.columns
    width = (len(names) - d) // cells.n_slots

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                codes = pdf[names[:d]].to_numpy(np.uint8)
                yield pd.DataFrame({"codes": [codes.tobytes()], "sums": [pdf[names[d:]].to_numpy(float).tobytes()]})

    written = save_state(cells.table.mapInPandas(pack, "codes binary, sums binary"), new_path(spark, "blocks"))
    tasks = max(spark.sparkContext.defaultParallelism, written.count() // BLOCKS)

    def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, d)
        return codes, np.frombuffer(row["sums"]).reshape(len(codes), -1, width), np.zeros((len(codes), n_plans))

    # dealt by number: every task gets as many blocks
    numbered = written.rdd.map(unpack).zipWithIndex().map(lambda found: (found[1] % tasks, found[0]))
    return numbered.partitionBy(tasks, lambda at: at).values()


def _draws(codes: np.ndarray, seed: int, round_: int) -> np.ndarray:
    """A number in [0, 1) per cell from its bins, the seed and the round, wherever the cell lies."""
    h = np.full(len(codes), (seed * 0x9E3779B97F4A7C15 + round_ * 0xD1B54A32D192ED03) % 2**64, np.uint64)
    for column in codes.T:
        h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(32))).astype(float) / 2.0**64


def _learned(plan: Plan, codes: np.ndarray, sums: np.ndarray, margin: np.ndarray, round_: int) -> tuple[np.ndarray, ...]:
    """Weights, weighted residuals and rows of an ensemble's cells.

    A subsample takes its share of the rows of each cell, rounded up or down by a draw, so that every row is taken
    with the same probability.
    """
    n, w, wy = (sums[:, plan.slots, k].sum(1) for k in (N, W, WY))
    rest = wy - w * margin
    if plan.subsamplingRate < 1:
        some = n * plan.subsamplingRate
        taken = np.floor(some) + (_draws(codes, plan.seed, round_) < some % 1)
        share = np.divide(taken, n, out=np.zeros(len(n)), where=n > 0)
        n, w, rest = taken, w * share, rest * share
    return w, rest if round_ == 0 else 2 * rest, n


class _Tree:
    """A growing tree over bins: the children of node i are 2 i + 1 and 2 i + 2, a leaf is its own child."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.feature, self.left, self.right = np.zeros(size, np.int64), np.arange(size), np.arange(size)
        self.code, self.value, self.depth = np.zeros(size), np.zeros(size), depth

    def nodes(self, codes: np.ndarray, level: int) -> np.ndarray:
        at, row = np.zeros(len(codes), np.int64), np.arange(len(codes)) * codes.shape[1]
        for _ in range(level):
            here = codes.ravel().take(row + self.feature.take(at)) <= self.code.take(at)
            at = np.where(here, self.left.take(at), self.right.take(at))
        return at

    def is_open(self, i: int) -> bool:
        """Whether a split of the level before made this node."""
        return i == 0 or self.left[(i - 1) // 2] != (i - 1) // 2

    def open_at(self, level: int) -> bool:
        return any(self.is_open(i) for i in range(2**level - 1, 2 ** (level + 1) - 1))

    def split(self, level: int, base: int, tables: dict[tuple[int, ...], np.ndarray], bins: Sequence[int], plan: Plan, round_: int) -> None:
        """Best splits of the nodes of a level, from sums over sets of features per node of the level ``base``.

        Sums are weights, residuals and, where a least number of rows is set, rows.
        """
        d = len(bins)
        for i in range(2**level - 1, 2 ** (level + 1) - 1):
            if not self.is_open(i):
                continue
            up, box = i, {}
            for _ in range(level - base):
                side, up = up % 2, (up - 1) // 2
                f, cut = self.feature[up], int(self.code[up]) + 1
                low, high = box.get(f, (0, bins[f]))
                box[f] = (low, min(high, cut)) if side else (max(low, cut), high)

            def along(g: int) -> np.ndarray:
                names = next(t for t in tables if {g, *box} <= set(t))
                part = tables[names][:, up - (2**base - 1)]
                part = part[(slice(None), *[slice(*box.get(f, (0, bins[f]))) for f in names])]
                out, low = np.zeros((len(part), bins[g])), box.get(g, (0,))[0]
                own = part.sum(axis=tuple(a + 1 for a, f in enumerate(names) if f != g))
                out[:, low : low + own.shape[1]] = own
                return out

            w, r = along(0)[:2].sum(1)
            if w <= 0:
                continue
            self.value[i] = r / w
            chosen = range(d)
            if plan.n_features(d) < d:
                chosen = sorted(np.random.default_rng([plan.seed, round_, i]).choice(d, plan.n_features(d), replace=False))
            best = (0.0,)
            for f in chosen:
                left = np.cumsum(along(f), axis=1)
                right, left = left[:, -1:] - left[:, :-1], left[:, :-1]
                ok = (left[0] > 1e-12 * w) & (right[0] > 1e-12 * w)
                if plan.minInstancesPerNode > 1:
                    ok &= np.minimum(left[2], right[2]) >= plan.minInstancesPerNode - 0.5
                if ok.any():
                    parts = left[1] ** 2 / np.where(ok, left[0], 1) + right[1] ** 2 / np.where(ok, right[0], 1)
                    gain = np.where(ok, parts - r * r / w, 0.0)
                    # rounding does not decide between equal gains: the first feature and bin have it
                    slack = 1e-11 * parts[ok].max()
                    at = int((gain >= gain.max() - slack).argmax())
                    if gain[at] > best[0] + slack:
                        best = (gain[at], f, at, left[:, at], right[:, at])
            if len(best) > 1:
                _, self.feature[i], self.code[i], a, b = best
                self.left[i], self.right[i] = 2 * i + 1, 2 * i + 2
                self.value[2 * i + 1], self.value[2 * i + 2] = a[1] / a[0], b[1] / b[0]


def _as_forest(cells: Cells, plan: Plan, trees: Sequence[_Tree], coded: bool = False) -> Forest:
    """The grown trees over the features themselves, or over their bins."""
    arrays = [np.stack([getattr(t, k) for t in trees]) for k in ("feature", "code", "left", "right", "value")]
    if not coded:
        inner = arrays[2] != np.arange(arrays[2].shape[1])
        arrays[1] = np.array([[cells.edges[f][int(c)] if s else 0.0 for f, c, s in zip(*row)] for row in zip(arrays[0], arrays[1], inner)])
        arrays[4] = arrays[4].copy()
        arrays[4][0] += cells.centre
    return Forest(cells.features, *arrays, np.r_[1.0, np.full(len(trees) - 1, plan.stepSize)], plan.maxDepth)


def grow(
    cells: Cells, plans: Sequence[Plan], block: int = 25
) -> Iterator[tuple[list[int], dict[int, tuple[float, float, float]], Callable[[int], Forest]]]:
    """After every round: (ensembles it completed, ensemble -> held-out sums after it, ensemble -> its forest so far).

    Held-out sums are (weight, weighted squared error, squared error). All ensembles that need another tree get it in the same
    jobs; the job of the first level also adds the trees of the round before. Margins are kept in memory and made anew from the
    written cells every ``block`` rounds, so that a lost block is made from at most so many steps.
    """
    bins, d = [len(e) + 1 for e in cells.edges], len(cells.features)
    base = _blocks(cells, len(plans)).persist(StorageLevel.MEMORY_AND_DISK)
    grown: list[list[_Tree]] = [[] for _ in plans]
    n_tasks = base.getNumPartitions()

    def sets(level: int, n: int) -> tuple[list[tuple[int, ...]], bool]:
        """Sets of features that a job for n ensembles sums over from this level on, and whether tasks add them up."""
        for size in (3, 2, 1):
            names = list(combinations(range(d), min(size, d)))
            sent = 3 * n * n_tasks * 2**level * sum(int(np.prod([bins[f] for f in t])) for t in names)
            if sent <= SENT * 3 or size == 1:
                return names, sent > SENT * 3
        raise AssertionError

    def scan(blocks: RDD, trees: dict[int, _Tree], level: int, round_: int, score: Sequence[int]):
        """Sums of the nodes of a level per set of features, and held-out sums, added up over all blocks."""
        names, add = sets(level, max(1, len(trees)))

        def part(found):
            hist = {(k, t): 0.0 for k in trees for t in names}
            held = {k: np.zeros(3) for k in score}
            for codes, sums, margins in found:
                for k in score:
                    own, m = sums[:, plans[k].held], margins[:, k]
                    error = [(own[:, c] - 2 * m * own[:, b] + m * m * own[:, a]).sum() for a, b, c in ((W, WY, WYY), (N, Y, YY))]
                    held[k] += [own[:, W].sum(), *error]
                for k, tree in trees.items():
                    values = _learned(plans[k], codes, sums, margins[:, k], round_)[: 3 if plans[k].minInstancesPerNode > 1 else 2]
                    node = tree.nodes(codes, level) - (2**level - 1)
                    own = codes
                    if level:
                        inside = node >= 0
                        node, own, values = node[inside], codes[inside], [v[inside] for v in values]
                    for t in names:
                        at, shape = node, [2**level]
                        for f in t:
                            at = at * bins[f] + own[:, f]
                            shape.append(bins[f])
                        hist[k, t] = hist[k, t] + np.stack([np.bincount(at, v, np.prod(shape)).reshape(shape) for v in values])
            yield from [((k, t), v) for (k, t), v in hist.items()]
            yield from [((k, None), v) for k, v in held.items()]

        tasks = blocks.mapPartitions(part)
        if add:
            tasks = tasks.reduceByKey(lambda a, b: a + b, n_tasks)
        tables: dict[int, dict] = {k: {} for k in trees}
        errors: dict = {}
        for (k, t), v in tasks.collect():
            into, key = (errors, k) if t is None else (tables[k], t)
            into[key] = into[key] + v if key in into else v
        for own in tables.values():
            for t, v in own.items():
                if not np.ndim(v):  # no cells at all
                    own[t] = np.zeros((3, 2**level, *[bins[f] for f in t]))
        return tables, {k: tuple(v) for k, v in errors.items()}, level + len(names[0])

    def added(blocks: RDD, last: dict[int, Forest], first: bool) -> RDD:
        """The blocks with the margins of these trees added, or of whole forests in their place."""

        def step(found):
            for codes, sums, margins in found:
                margins = np.zeros_like(margins) if first else margins.copy()
                for k, trees in last.items():
                    margins[:, k] += trees.predict(codes)
                yield codes, sums, margins

        return blocks.mapPartitions(step, preservesPartitioning=True)

    blocks, round_ = base, 0
    try:
        todo = [k for k, p in enumerate(plans) if p.maxIter > 0]
        trees = {k: _Tree(plans[k].maxDepth) for k in todo}
        tables, _, until = scan(blocks, trees, 0, 0, [])
        while todo:
            start = 0
            for level in range(max(plans[k].maxDepth for k in todo)):
                here = {k: t for k, t in trees.items() if level < plans[k].maxDepth and t.open_at(level)}
                if level == until and here:
                    start = level
                    tables, _, until = scan(blocks, here, level, round_, [])
                for k in here:
                    here[k].split(level, start, tables[k], bins, plans[k], round_)
            for k in todo:
                grown[k].append(trees[k])
            round_ += 1
            if round_ % block:
                last = {k: _as_forest(cells, plans[k], [trees[k]], coded=True) for k in todo}
                for k in todo:
                    last[k].weights = np.array([1.0 if round_ == 1 else plans[k].stepSize])
                new = added(blocks, last, False)
            else:
                new = added(base, {k: _as_forest(cells, plans[k], grown[k], coded=True) for k in todo}, True)
            new = new.persist(StorageLevel.MEMORY_AND_DISK)
            before, scored = todo, [k for k in todo if plans[k].held is not None]
            todo = [k for k in todo if round_ < plans[k].maxIter]
            trees = {k: _Tree(plans[k].maxDepth) for k in todo}
            tables, held, until = scan(new, trees, 0, round_, scored)
            if blocks is not base:
                blocks.unpersist()
            blocks = new
            yield [k for k in before if k not in todo], held, lambda k: _as_forest(cells, plans[k], grown[k])
    finally:
        blocks.unpersist()
        base.unpersist()


def grow_all(cells: Cells, plans: Sequence[Plan]) -> tuple[list[Forest], list[tuple[float, float, float] | None]]:
    """All ensembles in full, and the held-out sums of each after its last round."""
    forests, held = {}, {}
    for done, sums, forest in grow(cells, plans):
        forests |= {k: forest(k) for k in done}
        held |= {k: sums[k] for k in done if k in sums}
    return [forests[k] for k in range(len(plans))], [held.get(k) for k in range(len(plans))]
