"""Exact k-nearest-neighbour distances without comparing all pairs, and the applicability domain.

The reference vectors form a metric tree of two levels, kept as tables. Coarse pivots cut them into cells; each cell has
fine pivots of its own, which cut it into blocks. A query is first searched in its own block, which bounds its k-th
distance; through the triangle inequality that bound excludes cells, then blocks inside the remaining ones, and it meets
only what is left. Inside a block a matrix product finds the vectors that may be within the bound, and only their distances
are taken, by direct differences. Pruning never changes the result.

The driver and every task hold the coarse pivots, the square root of the number of blocks; the fine pivots of a cell
are one row of a table. Copies of a vector collapse to one counted row, fuller blocks are salted, and queries meet a
block in parts of a bounded size. References that fit into one block (its size is checked) are sent to the queries instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridsieve.operators.curate import hash_sample
from gridsieve.operators.split import minmax
from gridsieve.session import new_path
from gridsieve.sources.sinks import save_state

SLACK = 1e-9
#: Bytes of vectors of a block, the most and fewest of them, queries that meet a block in one group, numbers a distance keeps.
BLOCK_BYTES, BLOCK_ROWS, BLOCK_LEAST, MEET, HELD = 16 << 20, 1 << 18, 64, 1 << 15, 1 << 22
#: Queries and vectors of a matrix product.
TILE = (1024, 4096)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values]) if len(values) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by direct differences (identical vectors give exactly 0)."""
    out = np.empty((len(a), len(b)))
    chunk = max(1, HELD // max(1, b.size))
    for start in range(0, len(a), chunk):
        diff = a[start:start + chunk, None, :] - b[None, :, :]
        out[start:start + chunk] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


class Block:
    """Vectors of one block, searched tile by tile."""

    def __init__(self, vectors: np.ndarray, copies: np.ndarray):
        self.vectors, self.copies = vectors, copies
        self.norms = np.einsum("ij,ij->i", vectors, vectors)
        self.sides = np.column_stack([-2 * vectors, self.norms, np.ones(len(vectors))])

    def nearest(self, queries: np.ndarray, need: int, bound: np.ndarray | None = None) -> np.ndarray:
        """Each query's ``need`` smallest distances, copies repeated, ascending; infinite where there are fewer, or beyond
        ``bound``, where some may be missing."""
        top = np.full((len(queries), need), np.inf)
        bound = np.full(len(queries), np.inf) if bound is None else bound
        with np.errstate(over="ignore", invalid="ignore"):
            for at in range(0, len(queries), TILE[0]):
                rows = slice(at, at + TILE[0])
                for start in range(0, len(self.vectors), TILE[1]):
                    self._search(queries[rows], top[rows], bound[rows], need, start)
        return top

    def _search(self, queries: np.ndarray, top: np.ndarray, bound: np.ndarray, need: int, start: int) -> None:
        inside = slice(start, start + TILE[1])
        norms = np.einsum("ij,ij->i", queries, queries)
        squares = np.column_stack([queries, np.ones(len(queries)), norms]) @ self.sides[inside].T
        # what rounding can change in a square
        error = 8 * (queries.shape[1] + 8) * np.finfo(float).eps * (norms + self.norms[inside].max())
        limit = np.minimum(top[:, -1], bound) ** 2 * (1 + SLACK) + error
        open_ = ~np.isfinite(limit)
        if open_.any() and squares.shape[1] >= need:
            limit[open_] = np.partition(squares[open_], need - 1, axis=1)[:, need - 1] + 2 * error[open_]
        # squares that are no numbers pass
        row, col = np.nonzero(~(squares > limit[:, None]))
        step = max(1, HELD // max(1, queries.shape[1]))
        for at in range(0, len(row), step):
            some, c = row[at:at + step], col[at:at + step] + start
            diff = queries[some] - self.vectors[c]
            _keep_smallest(top, some, np.sqrt(np.einsum("ij,ij->i", diff, diff)), np.minimum(self.copies[c], need))


def _keep_smallest(top: np.ndarray, row: np.ndarray, d: np.ndarray, times: np.ndarray) -> None:
    """Puts the distances of rows, repeated, among the ascending smallest ones of each row."""
    if (times > 1).any():
        row, d = np.repeat(row, times), np.repeat(d, times)
    touched, own = np.unique(row, return_inverse=True)
    need = top.shape[1]
    rows, values = np.r_[np.repeat(np.arange(len(touched)), need), own], np.r_[top[touched].ravel(), d]
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(touched)))[rows]
    kept = rank < need
    top[touched[rows[kept]], rank[kept]] = values[kept]


def _plain(vec: str) -> Column:
    """The vector in double precision, with -0.0 as 0.0, so that equal vectors have equal keys."""
    return F.transform(F.col(vec).cast("array<double>"), lambda x: x + 0.0)


def _counted(df: DataFrame, vec: str) -> DataFrame:
    """Distinct vectors with their number of copies."""
    v = _plain(vec).alias("vec")
    return df.filter(F.col(vec).isNotNull()).select(v).groupBy("vec").agg(F.count(F.lit(1)).alias("copies"))


def _vectors(table: pa.Table) -> np.ndarray:
    """The column ``vec`` of an Arrow table as a matrix."""
    flat = pc.list_flatten(table.column("vec")).to_numpy()
    return flat.reshape(len(table), -1) if len(table) else np.zeros((0, 0))


def _block_rows(dims: int) -> int:
    return max(BLOCK_LEAST, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dims))))


def _one_block(wanted: DataFrame, refs: pa.Table, need: int) -> DataFrame:
    """(vec, dists) of queries against references that fit into one block."""
    vectors, copies = _vectors(refs), refs.column("copies").to_numpy()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = Block(vectors, copies)
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(dists=list(block.nearest(_matrix(pdf["vec"]), need)))

    return wanted.select("vec").mapInPandas(search, "vec array<double>, dists array<double>")


def _tree(refs: DataFrame, n_refs: int, size: int) -> tuple[np.ndarray, np.ndarray, DataFrame, DataFrame]:
    """Coarse pivots and the radii of their cells, the fine pivots of each cell, and the references with their block.

    fine: cell, pivots array<struct<fine, vec, far>>; blocked: vec, copies, cell, fine, salt.
    """
    spark = refs.sparkSession
    wanted = max(1, math.isqrt(-(-n_refs // size)))
    pivots = np.array([r["vec"] for r in refs.orderBy(F.xxhash64("vec"), "vec").limit(wanted).collect()], dtype=np.float64)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _distances(_matrix(pdf["vec"]), pivots)
                yield pdf.assign(cell=d.argmin(axis=1).astype("int32"), radius=d.min(axis=1))

    celled = save_state(refs.mapInPandas(assign, "vec array<double>, copies long, cell int, radius double"), new_path(spark, "knn-cells"))
    # one row per coarse pivot
    cells = celled.groupBy("cell").agg(F.max("radius").alias("far"), F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    cells = save_state(cells, new_path(spark, "knn-coarse"))
    far = np.full(len(pivots), -np.inf)
    for r in cells.collect():
        far[r["cell"]] = r["far"]
    # a task keeps no more of a cell than its fine pivots, then they meet
    drawn = celled.join(F.broadcast(cells.select("cell", "parts")), "cell")
    order = W.partitionBy("cell").orderBy(F.xxhash64("vec", F.lit(5)), "vec")
    drawn = drawn.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= F.col("parts"))
    fine = drawn.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct((F.col("_rn") - 1).cast("int").alias("fine"), "vec"))).alias("pivots"))
    fine = save_state(fine, new_path(spark, "knn-fine"))

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby("cell"):
                own = _matrix(pd.Series([p["vec"] for p in part["pivots"].iloc[0]]))
                d = _distances(_matrix(part["vec"]), own)
                yield part[["vec", "copies", "cell"]].assign(fine=d.argmin(axis=1).astype("int32"), radius=d.min(axis=1))

    fined = celled.select("vec", "copies", "cell").join(fine, "cell").select("vec", "copies", "cell", "pivots")
    fined = save_state(fined.mapInPandas(refine, "vec array<double>, copies long, cell int, fine int, radius double"), new_path(spark, "knn-blocks"))
    sizes = fined.groupBy("cell", "fine").agg(F.max("radius").alias("far"), F.ceil(F.count(F.lit(1)) / size).cast("int").alias("salts"))
    sizes = save_state(sizes, new_path(spark, "knn-sizes"))
    reach = fine.select("cell", F.explode("pivots").alias("p")).select("cell", "p.*").join(sizes, ["cell", "fine"])
    reach = reach.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("fine", "vec", "far"))).alias("pivots"))
    blocked = fined.join(sizes.select("cell", "fine", "salts"), ["cell", "fine"])
    blocked = blocked.withColumn("salt", F.pmod(F.xxhash64("vec"), F.col("salts")).cast("int")).select("vec", "copies", "cell", "fine", "salt")
    return pivots, far, save_state(reach, new_path(spark, "knn-fine")), blocked


def _meet(cand: DataFrame, blocked: DataFrame, need: int) -> DataFrame:
    """(vec, dists) for queries (vec, theta, cell, fine) in each part of their block."""
    spark = cand.sparkSession
    cand = save_state(cand, new_path(spark, "knn-queries"))
    block = ["cell", "fine"]
    load = cand.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("parts"))
    load = load.join(blocked.groupBy(block).agg((F.max("salt") + 1).alias("salts")), block)
    load = save_state(load, new_path(spark, "knn-load"))  # one row per block
    queries = cand.join(F.broadcast(load), block).withColumn("part", F.pmod(F.xxhash64("vec", F.lit(7)), F.col("parts")).cast("int"))
    queries = queries.select("vec", "theta", *block, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "part")
    refs = blocked.join(F.broadcast(load.select(*block, "parts")), block)
    refs = refs.select("vec", "copies", *block, "salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def search(queries: pa.Table, refs: pa.Table) -> pa.Table:
        if not len(queries) or not len(refs):
            return pa.table({"vec": pa.array([], kind), "dists": pa.array([], kind)})
        own = Block(_vectors(refs), refs.column("copies").to_numpy())
        found = own.nearest(_vectors(queries), need, queries.column("theta").to_numpy())
        return pa.table({"vec": queries.column("vec"), "dists": pa.array(list(found), kind)})

    kind = pa.list_(pa.float64())
    keys = [*block, "salt", "part"]
    # a group holds about MEET queries and a block
    return queries.groupBy(keys).cogroup(refs.groupBy(keys)).applyInArrow(search, "vec array<double>, dists array<double>")


def _tree_search(wanted: DataFrame, refs: DataFrame, n_refs: int, size: int, need: int) -> DataFrame:
    """(vec, dists) of queries against references under a metric tree."""
    spark = refs.sparkSession
    pivots, far, fine, blocked = _tree(refs, n_refs, size)
    blocked = save_state(blocked, new_path(spark, "knn-blocked"))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _distances(_matrix(pdf["vec"]), pivots)
                d[:, ~np.isfinite(far)] = np.inf
                yield pdf.assign(cell=d.argmin(axis=1).astype("int32"))

    def own_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby("cell"):
                own = part["pivots"].iloc[0]
                at = _distances(_matrix(part["vec"]), _matrix(pd.Series([p["vec"] for p in own]))).argmin(axis=1)
                ids = np.array([p["fine"] for p in own], dtype="int32")
                yield part[["vec", "cell"]].assign(theta=np.inf, fine=ids[at])

    placed = wanted.mapInPandas(home, "vec array<double>, cell int").join(fine, "cell")
    first = placed.mapInPandas(own_block, "vec array<double>, cell int, theta double, fine int")
    first = save_state(first, new_path(spark, "knn-first"))
    begun = _meet(first.select("vec", "theta", "cell", "fine"), blocked, need)
    begun = save_state(begun, new_path(spark, "knn-begun"))
    bound = begun.groupBy("vec").agg(F.min(F.get("dists", F.lit(need - 1))).alias("theta"))
    bounded = first.select("vec", F.col("cell").alias("home"), F.col("fine").alias("block")).join(bound, "vec")

    def cells_near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                limit = pdf["theta"].to_numpy() * (1 + SLACK) + SLACK
                q, c = np.nonzero(_distances(_matrix(pdf["vec"]), pivots) - far[None, :] <= limit[:, None])
                yield pdf.iloc[q].assign(cell=c.astype("int32"))

    def blocks_near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell, part in pdf.groupby("cell"):
                own = part["pivots"].iloc[0]
                ids, reach = np.array([p["fine"] for p in own], dtype="int32"), np.array([p["far"] for p in own])
                d = _distances(_matrix(part["vec"]), _matrix(pd.Series([p["vec"] for p in own])))
                limit = part["theta"].to_numpy() * (1 + SLACK) + SLACK
                known = (part["home"].to_numpy() == cell)[:, None] & (part["block"].to_numpy()[:, None] == ids[None, :])
                q, b = np.nonzero((d - reach[None, :] <= limit[:, None]) & ~known)
                yield part[["vec", "theta", "cell"]].iloc[q].assign(fine=ids[b])

    near = bounded.mapInPandas(cells_near, "vec array<double>, home int, block int, theta double, cell int").join(fine, "cell")
    more = near.mapInPandas(blocks_near, "vec array<double>, theta double, cell int, fine int")
    return begun.unionAll(_meet(more, blocked, need))


def knn_mean_distance(
    queries: DataFrame,
    reference: DataFrame | None,
    vec: str,
    k: int = 5,
    out: str = "knn_distance",
    block_rows: int | None = None,
) -> DataFrame:
    """Adds each query's mean distance to its k nearest reference vectors.

    ``reference=None`` searches the queries themselves and leaves each row itself out (copies of
    it still count). With fewer than k reference rows the mean is over those there are. Vectors have one length.
    """
    exclude_self = reference is None
    spark = queries.sparkSession
    refs = save_state(_counted(queries if exclude_self else reference, vec), new_path(spark, "knn-vectors"))
    seen = refs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).first()
    if not seen.n:
        return queries.withColumn(out, F.lit(None).cast("double"))
    size = block_rows or _block_rows(seen.dims)
    need = k + 1 if exclude_self else k
    wanted = refs.select("vec") if exclude_self else queries.filter(F.col(vec).isNotNull()).select(_plain(vec).alias("vec")).distinct()
    if seen.n <= size:
        found = _one_block(wanted, refs.toArrow(), need)
    else:
        parts = _tree_search(wanted, refs, seen.n, size, need)
        joined = F.slice(F.array_sort(F.flatten(F.collect_list("dists"))), 1, need)
        found = parts.groupBy("vec").agg(joined.alias("dists"))
    # the nearest vector of a row of the references is itself
    kept = F.filter(F.slice("dists", 2, k) if exclude_self else F.slice("dists", 1, k), lambda x: x < float("inf"))
    mean = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept))
    means = found.select(F.col("vec").alias("_vec"), mean.alias(out))
    return queries.withColumn("_vec", _plain(vec)).join(means, "_vec", "left").drop("_vec")


def novelty_score(
    candidates: DataFrame, train: DataFrame, vec: str, k: int = 5, out: str = "novelty_score", sample: int | None = None,
    train_key: Column | None = None, seed: int = 0,
) -> DataFrame:
    """Mean distance to the k nearest training rows, scaled to [0, 1] over the candidates.

    All training rows count. ``sample`` with ``train_key`` takes that many of them by hash instead,
    if a rough score is enough.
    """
    reference = train if sample is None else hash_sample(train, train_key, sample, seed)
    raw = knn_mean_distance(candidates, reference, vec, k, "_raw")
    # scaling needs the distances twice, range and values
    return minmax(save_state(raw, new_path(candidates.sparkSession, "novelty")), "_raw", out).drop("_raw")


def domain_threshold(train_distances: DataFrame, distance: str, m: float = 1.0) -> DataFrame:
    """(ad_mean, ad_std, ad_threshold): mean plus m population standard deviations."""
    return train_distances.agg(F.avg(distance).alias("ad_mean"), F.stddev_pop(distance).alias("ad_std")).withColumn(
        "ad_threshold", F.col("ad_mean") + F.lit(float(m)) * F.col("ad_std")
    )


def standardize(df: DataFrame, vec: str, reference: DataFrame) -> DataFrame:
    """Vector entries scaled by the reference's mean and population standard deviation per position."""
    vectors = reference.filter(F.col(vec).isNotNull()).select(array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    stats = vectors.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select("s.*").first()
    n = stats["count"]
    means = F.array(*[F.lit(float(x)) for x in stats["mean"]])
    # the summary divides by n - 1
    deviations = [math.sqrt(float(x) * (n - 1) / n) for x in stats["variance"]]
    scales = F.array(*[F.lit(x if x > 0 else 1.0) for x in deviations])
    centred = F.zip_with(F.col(vec), means, lambda x, m: x - m)
    return df.withColumn(vec, F.zip_with(centred, scales, lambda x, s: x / s))


def applicability_domain(
    train: DataFrame, queries: DataFrame, vec: str, k: int = 5, m: float = 1.0, scale: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(labelled queries, threshold row): distance to the training set against its own self-distances."""
    if scale:
        train, queries = standardize(train, vec, train), standardize(queries, vec, train)
    threshold = domain_threshold(knn_mean_distance(train, None, vec, k, "_d"), "_d", m)
    limit = threshold.select("ad_threshold").scalar()
    scored = knn_mean_distance(queries, train, vec, k, "ad_score").withColumn("within_ad", F.col("ad_score") <= limit)
    label = F.when(F.col("within_ad"), "within_AD").otherwise("outside_AD")
    return scored.withColumn("ad_label", label), threshold
