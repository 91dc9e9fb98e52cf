"""Approximate nearest neighbours: NN-descent builds the graph, greedy search answers queries.

Build. Every distinct vector starts with the best neighbours that it has inside STARTS random blocks; blocks of
different draws overlap, so that lists lead from one to another. In each round
every node brings its neighbours (its own list and the nearest nodes that list it) together in one Spark
join, and each pair of them learns its distance: a neighbour of a neighbour is likely a neighbour. A node
keeps the DEGREE nearest it has heard of. Rounds end when few lists change.

Search. A query holds a beam of the nearest nodes found so far. In each step the nearest nodes not yet
expanded are joined with the graph, and their neighbours are scored where their vectors lie: a message
carries the query's vector once per partition of the nodes, with the candidates there. The search ends when
every node of every beam is expanded. The beam's best are scored again on the original vectors in double
precision, and equal vectors are replaced by their smallest ids.

DEGREE, BEAM, EXPAND and ENTRIES (a bounded sample of nodes from which every search starts; a query that is
itself indexed starts from its own node too) trade work for recall; they bound what one query or node
holds, not the data. Every vector is indexed. Measured recall is in the README.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, neither do
vectors whose length differs from that of most; ties go to the smaller id; a query with fewer candidates
than asked for gets all of them; a row is an id with a vector: rows equal in both count as one, rows that share
only the id, or have none, are rows of their own, as queries and as candidates; a null id stays null and
comes before all others in ties; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsieve.llm.common import NULL_ID, column, staged
from gridsieve.llm.vectors import classes, matrix, valid_vectors

DEGREE = 20
PER_LIST = 3  # best news for each neighbour that one list reports
BLOCK = 128
STARTS = 3
ROUNDS = 12
SETTLED = 0.05  # share of list places that change in a round, below which rounds end
BEAM = 400
EXPAND = 200
ENTRIES = 256
NODES_PER_PART = 4000


def nearest(edges: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows of smallest distance for each key; Spark keeps k per task before it shuffles."""
    order = Window.partitionBy(key).orderBy("d", "u", "v")
    return edges.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def _runs(batches: Iterator[pa.RecordBatch], key: str, size: int = 8192) -> Iterator[pa.Table]:
    """Tables of whole groups of a sorted stream."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < size:
            continue
        rows = pa.Table.from_batches(held)
        keys = rows.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _distances(x: np.ndarray) -> np.ndarray:
    """Squared distances inside each of a stack of lists."""
    sq = (x * x).sum(-1)
    return np.maximum(0, sq[..., :, None] + sq[..., None, :] - 2 * x @ np.swapaxes(x, -1, -2))


def _best(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the k smallest finite entries of each row."""
    if d.shape[1] > k:
        j = np.argpartition(d, k - 1, axis=1)[:, :k]
    else:
        j = np.broadcast_to(np.arange(d.shape[1]), d.shape)
    v = np.take_along_axis(d, j, 1)
    i, c = np.nonzero(np.isfinite(v))
    return i, j[i, c], v[i, c]


EDGES = "u long, v long, d float"


def _edges(u, v, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float32())], ["u", "v", "d"])


def first_lists(nodes: DataFrame, blocks: int, draw: int) -> DataFrame:
    """Each node's neighbours in one random block, from hashes of the ids."""

    def inside(rows: pa.Table) -> pa.Table:
        ids = rows.column("node").to_numpy()
        out = []
        for at in range(0, len(ids), 2 * BLOCK):
            own = ids[at : at + 2 * BLOCK]
            d = _distances(matrix(rows.column("code").slice(at, 2 * BLOCK).combine_chunks(), np.float32))
            np.fill_diagonal(d, np.inf)
            i, j, v = _best(d, DEGREE)
            out.append(_edges(own[i], own[j], v))
        return pa.Table.from_batches(out)

    return nodes.groupBy(F.pmod(F.xxhash64("node", F.lit(100 + draw)), F.lit(blocks)).alias("block")).applyInArrow(inside, EDGES)


def build_graph(nodes: DataFrame) -> DataFrame:
    """Edges (u, v, d) to the nearest found; ``nodes``: node (long, unique), code (single-precision components)."""
    n = nodes.count()
    drawn = [first_lists(nodes, max(1, -(-n // BLOCK)), i) for i in range(STARTS)]
    drawn = reduce(DataFrame.unionAll, drawn).groupBy("u", "v").agg(F.min("d").alias("d"))
    lists = staged(nearest(drawn, "u", DEGREE), "graph").withColumn("new", F.lit(True))
    parts = max(1, -(-n // NODES_PER_PART))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "u"):
            u = rows.column("u").to_numpy()
            starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            sizes = np.diff(np.r_[starts, len(u)])
            width = int(sizes.max())
            v, new, worst = (rows.column(c).to_numpy() for c in ("v", "new", "worst"))
            x = _unpacked(rows.column("code").combine_chunks())
            for at in range(0, len(starts), 64):
                s, z = starts[at : at + 64], sizes[at : at + 64]
                index = s[:, None] + np.minimum(np.arange(width), z[:, None] - 1)
                there = np.arange(width) < z[:, None]
                d = _distances(x[index])
                ids, fresh = v[index], new[index]
                useless = ~(there[:, :, None] & there[:, None, :]) | (ids[:, :, None] == ids[:, None, :])
                useless |= ~(fresh[:, :, None] | fresh[:, None, :]) | (d >= worst[index][:, :, None])
                d[useless] = np.inf
                flat = d.reshape(-1, width)
                i, j, best = _best(flat, PER_LIST)
                yield _edges(ids.ravel()[i], ids[i // width, j], best)

    for _ in range(ROUNDS):
        worst = lists.groupBy(F.col("u").alias("node")).agg(
            F.when(F.count(F.lit(1)) >= DEGREE, F.max("d")).otherwise(F.lit(float("inf"))).cast("float").alias("worst")
        )
        carried = nodes.select("node", F.col("small").alias("code")).join(worst, "node", "left")
        carried = carried.select(F.col("node").alias("v"), "code", F.coalesce("worst", F.lit(float("inf")).cast("float")).alias("worst"))
        back = nearest(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "d", "new"), "u", DEGREE)
        around = lists.select("u", "v", "new").unionAll(back.select("u", "v", "new")).groupBy("u", "v").agg(F.max("new").alias("new"))
        met = around.join(carried, "v").repartition(parts, "u").sortWithinPartitions("u")
        news = met.select("u", "v", "new", "code", "worst").mapInArrow(meet, EDGES)
        both = lists.select("u", "v", "d", F.lit(False).alias("new")).unionAll(news.select("u", "v", "d", F.lit(True).alias("new")))
        # a pair that was known stays old; its first distance is kept
        merged = both.groupBy("u", "v").agg(F.min("new").alias("new"), F.min_by("d", "new").alias("d"))
        lists = staged(nearest(merged.select("u", "v", "d", "new"), "u", DEGREE), "graph")
        changed, total = lists.agg(F.count_if("new"), F.count(F.lit(1))).first()
        if changed <= SETTLED * total:
            break
    return lists.select("u", "v", "d")


def greedy_search(nodes: DataFrame, graph: DataFrame, queries: DataFrame) -> DataFrame:
    """query, node of the BEAM nearest nodes found; ``queries``: query (unique), code, start (a node or null)."""
    n = nodes.count()
    parts = max(1, -(-n // NODES_PER_PART))
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(12)), F.lit(parts)).cast("int")
    # both directions, a node's incoming edges bounded to the nearest
    back = nearest(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"), "u", DEGREE)
    around = staged(
        graph.select("u", "v").unionAll(back.select("u", "v")).distinct().groupBy(F.col("u").alias("node")).agg(F.collect_list("v").alias("around")),
        "around",
    )
    placed = staged(nodes.select("node", "code", part("node").alias("part")), "nodes")
    entries = [r.node for r in nodes.orderBy(F.xxhash64("node", F.lit(11)), "node").limit(ENTRIES).select("node").collect()]
    first = F.array_distinct(F.concat(F.array(*[F.lit(e) for e in entries]).cast("array<bigint>"), F.when(F.col("start").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("start"))))
    state = staged(
        queries.select("query", "code", F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<float>").alias("ds"), F.array().cast("array<boolean>").alias("open")),
        "beams",
    )
    wanted = queries.select("query", F.explode(first).alias("node"))

    def score(key: tuple[pa.Scalar, ...], messages: pa.Table, there: pa.Table) -> pa.Table:
        ids = there.column("node").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], matrix(there.column("code").combine_chunks(), np.float32)[order] if len(ids) else None
        out = []
        for m in messages.to_pylist():
            c = np.array(m["cands"], np.int64)
            found = x[np.searchsorted(ids, c)]
            d = ((found - np.frombuffer(m["code"], np.float32)) ** 2).sum(1)
            near = d < m["worst"]
            if near.any():
                out.append((m["query"], c[near].tolist(), d[near].tolist()))
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32())]
        cols = zip(*out, strict=True) if out else [[], [], []]
        return pa.table([pa.array(list(v), t) for v, t in zip(cols, types, strict=True)], names=["query", "cands", "ds"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids, ds, opened = r["ids"], r["ds"], [False if e is None else e for e in r["open"]]
                expanded = [i for i, e in enumerate(opened) if e][:EXPAND]
                for i in expanded:
                    opened[i] = False
                beam = dict(zip(ids, zip(ds, opened, strict=True), strict=True))
                for cands, dist in zip(r["more_ids"] or [], r["more_ds"] or [], strict=True):
                    for i, d in zip(cands, dist, strict=True):
                        beam.setdefault(i, (d, True))
                best = sorted(beam.items(), key=lambda x: (x[1][0], x[0]))[:BEAM]
                out.append((r["query"], r["code"], [i for i, _ in best], [x[0] for _, x in best], [x[1] for _, x in best]))
            types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_())]
            cols = zip(*out, strict=True) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(cols, types, strict=True)], ["query", "code", "ids", "ds", "open"])

    worst = F.when(F.size("ids") >= BEAM, F.array_max("ds")).otherwise(F.lit(float("inf")).cast("float"))
    while True:
        per_part = wanted.select("query", "node", part("node").alias("part")).groupBy("query", "part").agg(F.collect_list("node").alias("cands"))
        messages = per_part.join(state.select("query", "code", worst.alias("worst")), "query")
        scored = messages.groupBy("part").cogroup(placed.groupBy("part")).applyInArrow(score, "query long, cands array<long>, ds array<float>")
        more = scored.groupBy("query").agg(F.collect_list(F.struct("cands", "ds")).alias("m"))
        more = more.select("query", F.col("m.cands").alias("more_ids"), F.col("m.ds").alias("more_ds"))
        state = staged(
            state.join(more, "query", "left").mapInArrow(merge, "query long, code binary, ids array<long>, ds array<float>, open array<boolean>"),
            "beams",
        )
        ahead = F.slice(F.filter(F.arrays_zip("ids", "open"), lambda x: x["open"]), 1, EXPAND)
        frontier = state.select("query", F.explode(ahead).alias("f")).select("query", F.col("f.ids").alias("node"))
        if frontier.isEmpty():
            return state.select("query", F.explode("ids").alias("node"))
        beam = state.select("query", F.explode("ids").alias("node"))
        seen = frontier.join(around, "node").select("query", F.explode("around").alias("node")).distinct()
        wanted = seen.join(beam, ["query", "node"], "left_anti")


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def search_nearest(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row, itself excluded.

    ``is_query`` is a condition on ``vec_id``, the id column. All valid rows are indexed.
    """
    valid = staged(valid_vectors(df, id_col, vec_col).distinct(), "vectors")
    sizes = valid.groupBy(F.length("vec").alias("bytes")).count().orderBy(F.desc("count"), "bytes").first()
    if sizes is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = valid.where(F.length("vec") == sizes.bytes)
    entries = classes(valid).select("node", "vec")
    members = staged(valid.join(entries, "vec").select("vec_id", "node"), "members")
    nodes = staged(_coded(entries, _scale(valid)), "coded")
    graph = build_graph(nodes)
    asked = members.where(is_query)
    queries = asked.select("node").distinct().join(nodes, "node").select(F.col("node").alias("query"), "code", F.col("node").alias("start"))
    found = greedy_search(nodes, graph, queries)
    # from here on original vectors: exact distances of the beam, then members of each class, smallest ids first
    vectors = _doubles(entries)
    near = found.join(vectors, "node").join(
        vectors.select(F.col("node").alias("query"), F.col("v").alias("w")), "query"
    )
    near = near.select("query", "node", _distance(F.col("w"), F.col("v")).alias("score"))
    by_score = Window.partitionBy("query").orderBy("score", "node")
    near = near.withColumn("at", F.row_number().over(by_score)).where(F.col("at") <= k + 1).drop("at")
    ordered = Window.partitionBy("node").orderBy("vec_id")
    few = members.withColumn("at", F.row_number().over(ordered)).where(F.col("at") <= k + 1).drop("at")
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(near, "query").join(few, "node")
    pairs = pairs.where("vec_id <> query_id OR node <> query")
    # a row is an id with a vector, so queries of one id, or of none, keep their own results
    rank = Window.partitionBy("query_id", "query").orderBy("score", "vec_id", "node")
    ranked = pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return ranked.select(back("query_id"), "rank", back("vec_id"), "score")


def _scale(valid: DataFrame) -> float:
    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(matrix(column(batch, "vec"))).max())])], ["x"])

    return valid.select("vec").mapInArrow(largest, "x double").agg(F.max("x")).first()[0]


def _coded(entries: DataFrame, scale: float) -> DataFrame:
    """node, code (single precision, scaled into -1..1) and small (a scale and one byte per component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (matrix(column(batch, "vec")) / scale).astype(np.float32)
            step = np.abs(x).max(1, keepdims=True, initial=1e-30) / 127
            small = [t.tobytes() + r.tobytes() for t, r in zip(step.astype("<f4"), np.rint(x / step).astype(np.int8), strict=True)]
            codes = [pa.array([r.tobytes() for r in x], pa.binary()), pa.array(small, pa.binary())]
            yield pa.RecordBatch.from_arrays([column(batch, "node"), *codes], ["node", "code", "small"])

    return entries.select("node", "vec").mapInArrow(run, "node long, code binary, small binary")


def _unpacked(values: pa.Array) -> np.ndarray:
    raw = matrix(values, np.uint8)
    return np.ascontiguousarray(raw[:, 4:]).view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view("<f4")


def _doubles(entries: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = pa.array(list(matrix(column(batch, "vec"))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([column(batch, "node"), v], ["node", "v"])

    return entries.select("node", "vec").mapInArrow(run, "node long, v array<double>")
