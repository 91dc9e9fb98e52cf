"""Exact near-duplicate vectors: a metric range join over pivot cells.

Cosine of at least ``least`` is a distance of at most r = sqrt(2 - 2 least) between unit vectors. Every vector
belongs to the cell of its nearest pivot. It is copied into another cell only if the triangle inequality lets
a member of that cell lie within r: its distance to that pivot may exceed its own by at most 2r, and its
distance to the plane between the two pivots, which bounds the distance to any member beyond, is at most r.
Of two cells only one gets the copy, chosen by the parity of their numbers, so a pair meets once. Cells are
split into blocks of bounded size, and pairs of blocks are joined independently by matrix products; products
near the threshold are decided again in double precision, vector by vector.

Equal vectors are one entry with a count. A pair of blocks reports the number of links of each entry and a
spanning set of them, never all pairs. How many pivots there are, at most a quarter of the square root of the
entries, is chosen by the copies that a sample would need. In
high dimensions without structure the copies approach all cells, and the work approaches all pairs of
blocks; nothing is left out for it.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing; vectors
of different lengths link with nothing either; every row is a vector of its own, also if it shares its id with
others or has none; a null id stays null and is left out when the smallest id is taken (component_id is null, and
kept holds, where no row with an id is reachable); an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.common import NULL_ID, column, staged
from gridsieve.llm.components import components
from gridsieve.llm.simhash import spanning
from gridsieve.llm.vectors import classes, matrix, valid_vectors

#: Bytes of vectors of a block, and bounds of their number.
BLOCK_BYTES, BLOCK, BLOCK_LEAST = 4 << 20, 8192, 256
#: Vectors on which numbers of pivots are tried.
TRIED = 2048
#: Single-precision products this close to the threshold are computed again in double precision.
DOUBT = 1e-4
EPS = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components stay finite
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no cosine, so that sums of their squares stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def cells_of(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (vector, cell, whether it is at home) for unit vectors: the home cell and the needed copies."""
    cos = x @ pivots.T
    home = cos.argmax(1)
    rows = np.arange(len(x))
    own = cos[rows, home][:, None]
    d = np.sqrt(np.maximum(0, 2 - 2 * cos))
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[home]
    to_plane = np.divide(own - cos, between, out=np.zeros_like(cos), where=between > EPS)
    number = np.arange(len(pivots))[None, :]
    taken = (home[:, None] < number) ^ ((home[:, None] + number) % 2 == 1)
    near = (d - d[rows, home][:, None] <= 2 * r + EPS) & (to_plane <= r + EPS) & taken & (number != home[:, None])
    who, cell = np.nonzero(near)
    return np.concatenate([rows, who]), np.concatenate([home, cell]), np.arange(len(rows) + len(who)) < len(rows)


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether each pair of rows of a and b has a cosine of at least ``least``, in double precision."""
    ua, ub = unit(a), unit(b)
    s = ua.astype(np.float32) @ ub.astype(np.float32).T
    out = s >= least
    i, j = np.nonzero(np.abs(s - least) < DOUBT)
    for k in range(0, len(i), 65_536):
        p, q = scaled(a[i[k : k + 65_536]]), scaled(b[j[k : k + 65_536]])
        cos = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1)))
        out[i[k : k + 65_536], j[k : k + 65_536]] = cos >= least
    return out


def _pivots(drawn: np.ndarray, n: int, r: float, block: int) -> np.ndarray:
    """So many of the drawn vectors as bring a vector to the fewest blocks: more pivots make smaller cells, and more
    copies where the bounds exclude little. At most a quarter of the square root of ``n``."""
    base, best = math.ceil(math.sqrt(n) / 16), (math.inf, 1)
    for wanted in sorted({1, max(1, base // 4), base, 4 * base}):
        sample = drawn[-TRIED:]
        copies = len(cells_of(sample, drawn[:wanted], r)[0]) / len(sample) - 1
        blocks = max(1.0, n / (wanted * block))
        best = min(best, (copies * blocks + (blocks + 1) / 2, wanted))
    return drawn[: best[1]]


def range_links(entries: DataFrame, least: float) -> DataFrame:
    """Rows (node, null, links) with the links of an entry, counting rows, and (a, b, null) that span the links.

    ``entries``: node (long, unique), n, vec (doubles of one length).
    """
    spark, r = entries.sparkSession, math.sqrt(max(0.0, 2 - 2 * least))
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "a long, b long, links long")
    drawn = entries.orderBy(F.xxhash64("node", F.lit(8)), "node").limit(max(TRIED, math.ceil(math.sqrt(n) / 4))).select("vec").collect()
    drawn = unit(matrix([bytes(x.vec) for x in drawn]))
    block = max(BLOCK_LEAST, min(BLOCK, BLOCK_BYTES // (8 * drawn.shape[1])))
    p = _pivots(drawn, n, r, block)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, cell, home = cells_of(unit(matrix(column(batch, "vec"))), p, r)
            for i in range(0, len(who), 8192):
                part = batch.take(pa.array(who[i : i + 8192]))
                more = [pa.array(cell[i : i + 8192].astype(np.int32)), pa.array(home[i : i + 8192])]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], ["node", "n", "vec", "cell", "home"])

    rows = staged(entries.select("node", "n", "vec").mapInArrow(assign, "node long, n long, vec binary, cell int, home boolean"), "cells")
    # one row per pivot
    sizes = rows.groupBy("cell").agg(
        F.ceil(F.count_if("home") / block).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("home")) / block).cast("int").alias("copies")
    )
    spread = F.xxhash64("node", F.lit(9))
    own = F.when(F.col("home"), F.pmod(spread, F.col("homes"))).otherwise(F.pmod(spread, F.col("copies"))).cast("int")
    sized = rows.join(F.broadcast(sizes), "cell").withColumn("own", own)
    inner = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda b: F.struct(F.lit(0).alias("kind"), F.least("own", b).alias("x"), F.greatest("own", b).alias("y")))
    outer = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))), lambda b: F.struct(F.lit(1).alias("kind"), F.col("own").alias("x"), b.alias("y")))).otherwise(F.array())
    copied = F.when(F.col("homes") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("homes") - 1, F.lit(0))), lambda b: F.struct(F.lit(1).alias("kind"), b.alias("x"), F.col("own").alias("y")))).otherwise(F.array())
    tasks = F.when(F.col("home"), F.concat(inner, outer)).otherwise(copied)
    work = sized.select("cell", F.explode(tasks).alias("t"), "own", "home", "node", "n", "vec").select("cell", "t.kind", "t.x", "t.y", "own", "home", "node", "n", "vec")

    def joined(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        kind, x, y = (k.as_py() for k in key[1:])
        nodes, count = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        vectors = matrix(rows.column("vec").combine_chunks())
        own, home = rows.column("own").to_numpy(), rows.column("home").to_numpy()
        left = home & (own == x) if kind == 1 else own == x
        right = ~home if kind == 1 else own == y
        i, j = np.flatnonzero(left), np.flatnonzero(right)
        counts, pairs = np.zeros(len(nodes), np.int64), []
        order = np.argsort(nodes, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        for k in range(0, len(i), 512):
            some = i[k : k + 512]
            hit = linked(vectors[some], vectors[j], least)
            if kind == 0:
                hit &= nodes[some][:, None] < nodes[j][None, :] if x == y else True
            counts[some] += hit @ count[j]
            counts[j] += hit.T @ count[some]
            p, q = np.nonzero(hit)
            pairs.append((place[some[p]], place[j[q]]))
        ranked, label = nodes[order], spanning(len(nodes), iter(pairs))
        far, some = ranked[label] != ranked, counts > 0
        a = np.concatenate([nodes[some], ranked[label][far]])
        b = pa.array([None] * int(some.sum()) + ranked[far].tolist(), pa.int64())
        links = pa.array(counts[some].tolist() + [None] * int(far.sum()), pa.int64())
        return pa.table([pa.array(a, pa.int64()), b, links], names=["a", "b", "links"])

    return work.groupBy("cell", "kind", "x", "y").applyInArrow(joined, "a long, b long, links long")


def near_vectors(df: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest id reachable), kept (it is that id)."""
    valid = staged(valid_vectors(df, id_col, vec_col), "vectors")
    entries = classes(valid)
    found = staged(_by_length(entries, least), "links")
    links = found.where("links IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(found.where("b IS NOT NULL").select("a", "b"))
    known = entries.join(links, "node", "left").join(labels, "node", "left")
    known = known.select("vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component"))
    rows = staged(valid.select(F.when(F.col("vec_id") != NULL_ID, F.col("vec_id")).alias("vec_id"), "vec").join(known, "vec").drop("vec"), "linked-rows")
    smallest = rows.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    of_row = rows.join(smallest, "component").select("vec_id", "links", "component_id")
    odd = F.col(vec_col).isNull() | ~F.coalesce(_sound(F.col(vec_col)), F.lit(False))
    ids = F.col(id_col).cast("long")
    lone = df.where(odd).select(ids.alias("vec_id"), F.lit(0).cast("long").alias("links"), ids.alias("component_id"))
    return of_row.unionAll(lone).select(
        "vec_id", F.col("links").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _sound(vec):
    """Whether a vector has components, all finite, and is not zero."""
    v = vec.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _by_length(entries: DataFrame, least: float) -> DataFrame:
    """Vectors of each length among themselves; a table of embeddings has one length, rarely a few."""
    lengths = [r.bytes for r in entries.select(F.length("vec").alias("bytes")).distinct().orderBy("bytes").collect()]
    out = None
    for bytes_ in lengths or [0]:
        part = range_links(entries.where(F.length("vec") == bytes_), least)
        out = part if out is None else out.unionAll(part)
    return out
