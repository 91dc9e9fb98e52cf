"""One document of each group of similar ones: candidates from SimHash fingerprints, decided by the sets of shingles.

Candidates. Each distinct set of shingles has SEEDS independent 64-bit fingerprints. At a Jaccard similarity of 0.8 two
of them differ in 9.7 bits on average, so in each of their four 16-bit blocks they differ in at most one bit with a
chance of about 0.28; over 4 SEEDS blocks a pair at 0.8 is missed about twice in ten thousand times, a closer one less
often. A table per fingerprint and block is cut into buckets by the block's first bits, as many as the number of entries
asks for; an entry goes to its own bucket, and as a visitor to those one set bit away. Within a bucket the entries are
sorted by Gray rank under a tree of shared masked bits (simhash.GrayTree's nodes): differences add up on the way down,
and a group is left when they exceed the bounds, or when all of it is already connected with the entry. A pair found must
also differ in at most LIMIT bits of three fingerprints together. A bucket reports a spanning set of its links only; a
bucket of more than CHUNK entries is dealt by hash into pieces that meet pairwise.

Sets of fewer than SMALL shingles that reach the similarity differ in at most one shingle; they are found exactly, by
their hashes with one shingle left out.

Decision. The sets of each candidate component are compared by exact similarity, only with sets whose size allows it and
which are not yet connected. A large component is first reduced by blocks to one member of each group found; then blocks
of neighbouring size levels meet.

Defined cases: documents without shingles (null, empty or blank texts) are one set, which is linked with itself; an id
with a text is a document: rows equal in both are repeated rows, of which one stays; rows that share only the id, or
have none, are documents of their own; a null id counts as the smallest; columns of the input may have any name;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.common import column, discard, row_id, slices, staged
from gridsieve.llm.components import components
from gridsieve.llm.simhash import BRANCH, GrayTree, fingerprint, gray_rank, hashes, rotate, signed

SEEDS = 6
TURNS = 4
#: Bits of the leading block that may differ, and bits of three fingerprints together: 4.5 deviations at 0.8.
LEAD, LIMIT = 1, 54
#: Bits of the fingerprint itself that may differ.
RADIUS = 24
CHUNK = 1 << 18
QUERIES = 256
SMALL = 10
#: Sets compared with each other in one task: at most about so many, and so many bytes of them.
BLOCK = 2048
BLOCK_BYTES = 8 << 20
U64 = np.uint64


def reseeded(h: np.ndarray, seed: int) -> np.ndarray:
    """Other hashes of the same shingles; seed 0 leaves them."""
    if not seed:
        return h
    x = h + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ x >> U64(30)) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U64(27)) * U64(0x94D049BB133111EB)
    return x ^ x >> U64(31)


def node_of(h: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(h.tobytes()))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (NULL_ID for null), version (a hash that tells texts of one id apart) and text."""
    text = F.col("text").cast("string")
    return docs.select(row_id().alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, version, node (hash of the set of shingles), size, fps (SEEDS fingerprints of the set), less (of a small
    set, its hashes with one shingle left out)."""
    names = ["doc_id", "version", "node", "size", "fps", "less"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.unique(hashes(t, words)) for t in column(batch, "text").to_pylist()]
            fps = [np.array([fingerprint(reseeded(h, i)) for i in range(SEEDS)], U64).tobytes() for h in found]
            less = [[node_of(np.delete(h, k)) for k in range(len(h))] if 1 < len(h) < SMALL else [] for h in found]
            columns = [column(batch, "doc_id"), column(batch, "version"), pa.array([node_of(h) for h in found], pa.int64())]
            columns += [pa.array([len(h) for h in found], pa.int64()), pa.array(fps, pa.binary()), pa.array(less, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return keyed(docs).mapInArrow(run, "doc_id long, version long, node long, size long, fps binary, less array<long>")


class Bucket:
    """Entries of one bucket and visitors, connected over the links found among them."""

    def __init__(self, nodes: np.ndarray, own: np.ndarray, more: np.ndarray, home: np.ndarray):
        order = np.argsort(gray_rank(own[home]), kind="stable")
        self.n = int(home.sum())
        self.nodes = np.concatenate([nodes[home][order], nodes[~home]])
        self.own = np.concatenate([own[home][order], own[~home]])
        self.more = np.concatenate([more[home][order], more[~home]])
        self.levels = GrayTree(self.own[: self.n]).levels if self.n else []
        self.label = np.arange(len(self.nodes))
        self._spread()

    def _spread(self) -> None:
        """Smallest and greatest label below each node of the tree."""
        low = high = self.label[: self.n]
        self.bounds = [(low, high)]
        while self.n and len(low) > BRANCH:
            starts = np.arange(0, len(low), BRANCH)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.bounds.append((low, high))
        self.bounds.reverse()

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            if (x == y).all():
                return
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    def connect(self, visitors_only: bool = False) -> None:
        if not self.n:
            return
        front = ~U64(0) << U64(48)
        for at in range(self.n if visitors_only else 0, len(self.nodes), QUERIES):
            who = np.arange(at, min(at + QUERIES, len(self.nodes)))
            first = len(self.levels[0][0])
            node, who = np.tile(np.arange(first), len(who)), np.repeat(who, first)
            total, ahead = np.zeros(len(who), np.uint8), np.zeros(len(who), np.uint8)
            span = BRANCH ** (len(self.levels) - 1)
            for depth, ((mask, ones), (low, high)) in enumerate(zip(self.levels, self.bounds, strict=True)):
                if depth:
                    node = (node[:, None] * BRANCH + np.arange(BRANCH)).ravel()
                    who, total, ahead = (np.repeat(x, BRANCH) for x in (who, total, ahead))
                    span //= BRANCH
                    there = node < len(mask)
                    who, node, total, ahead = who[there], node[there], total[there], ahead[there]
                # pairs of entries are met once, by the first; visitors (behind all entries) meet every entry
                later = ((node + 1) * span > who + 1) | (who >= self.n)
                apart = later & ((low[node] != high[node]) | (low[node] != self.label[who]))
                who, node, total, ahead = who[apart], node[apart], total[apart], ahead[apart]
                differ = (self.own[who] ^ ones[node]) & mask[node]
                total = total + np.bitwise_count(differ)
                ahead = ahead + np.bitwise_count(differ & front)
                near = (total <= RADIUS) & (ahead <= LEAD)
                who, node, total, ahead = who[near], node[near], total[near], ahead[near]
            bits = total + np.bitwise_count(self.more[who] ^ self.more[node]).sum(1)
            near = bits <= LIMIT
            if near.any():
                before = self.label[who[near]] != self.label[node[near]]
                self._unite(who[near][before], node[near][before])
                if before.any():
                    self._spread()

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each connected node with the smallest of its group, so that tables which find the same group report the same links."""
        smallest = np.full(len(self.label), np.iinfo(np.int64).max)
        np.minimum.at(smallest, self.label, self.nodes)
        root = smallest[self.label]
        far = root != self.nodes
        return root[far], self.nodes[far]


def _tables(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bucket, node, own, two more fingerprints, whether at home) of a batch of entries, per table and flipped bit."""
    nodes = column(batch, "node").to_numpy()
    fps = np.frombuffer(b"".join(column(batch, "fps").to_pylist()), U64).reshape(-1, SEEDS)
    for seed in range(SEEDS):
        more = fps[:, [(seed + 1) % SEEDS, (seed + 2) % SEEDS]]
        for turn in range(TURNS):
            own = rotate(fps[:, seed], 16 * turn)
            key = (own >> U64(48)).astype(np.int64) >> 16 - bits
            table = (seed * TURNS + turn) << 16
            yield table | key, nodes, own, more, np.ones(len(nodes), bool)
            for bit in range(bits):
                unset = (key >> bit & 1) == 0
                yield table | key[unset] | 1 << bit, nodes[unset], own[unset], more[unset], np.zeros(int(unset.sum()), bool)


def candidate_links(entries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Spanning links (a, b) of entries (node long, unique; fps binary; written) whose fingerprints are close."""
    bits = min(16, max(0, (entries.count() // chunk).bit_length()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, n = np.unique(np.concatenate([t[0] for t in _tables(batch, bits)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(n)], ["bucket", "n"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                for bucket, node, own, more, home in _tables(batch.slice(at, 4096), bits):
                    signed_ = [pa.array(x.view(np.int64)) for x in (own, np.ascontiguousarray(more[:, 0]), np.ascontiguousarray(more[:, 1]))]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node), *signed_, pa.array(home)], names)

    names = ["bucket", "node", "own", "more", "most", "home"]
    rows = entries.select("node", "fps").mapInArrow(spread, "bucket long, node long, own long, more long, most long, home boolean")
    sizes = entries.select("node", "fps").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    hot = staged(sizes.where(F.col("n") > 2 * chunk).select("bucket", F.ceil(F.col("n") / chunk).cast("int").alias("pieces")), "hot-buckets")
    none = F.lit(0)
    if hot.isEmpty():
        rows = rows.select("*", none.alias("piece"), none.alias("x"), none.alias("y"))
    else:
        rows = rows.join(hot, "bucket", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        rows = rows.withColumn("piece", F.pmod(F.xxhash64("node", F.lit(3)), "pieces").cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
        rows = rows.withColumn("z", other).select(*names, "piece", F.least("piece", "z").alias("x"), F.greatest("piece", "z").alias("y"))

    def connect(key: tuple, table: pa.Table) -> pa.Table:
        x, y = key[1].as_py(), key[2].as_py()
        node, home, piece = (table.column(c).to_numpy() for c in ("node", "home", "piece"))
        own, more, most = (table.column(c).to_numpy().view(U64) for c in ("own", "more", "most"))
        both = np.column_stack([more, most])
        bucket = Bucket(node, own, both, home if x == y else home & (piece == y))
        if x == y:
            bucket.connect()
            a, b = bucket.links()
        else:
            # entries of one piece meet entries and visitors of the other, which stay visitors here
            bucket.connect(visitors_only=True)
            turned = home & (piece == x)
            some = turned | (~home & (piece == y))
            back = Bucket(node[some], own[some], both[some], turned[some])
            back.connect(visitors_only=True)
            (a, b), (c, d) = bucket.links(), back.links()
            a, b = np.concatenate([a, c]), np.concatenate([b, d])
        return pa.table([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.groupBy("bucket", "x", "y").applyInArrow(connect, "a long, b long")


def small_links(entries: DataFrame) -> DataFrame:
    """Links of small sets of which one is the other without a shingle; whether they are similar is decided later."""
    less = entries.select(F.col("node").alias("b"), F.explode("less").alias("a"))
    return less.join(entries.where(F.col("size") < SMALL).select(F.col("node").alias("a")), "a").select("a", "b")


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same nodes: each b with its smallest a, and that a with b's other ones.

    A node has at most a few a per table, of which many nodes share the same ones, so few links are left.
    """
    ends = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tops = ends.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("tops"))
    others = F.transform(F.slice("tops", 2, F.size("tops")), lambda t: F.struct(F.get("tops", F.lit(0)).alias("a"), t.alias("b")))
    own = F.array(F.struct(F.get("tops", F.lit(0)).alias("a"), F.col("b").alias("b")))
    return tops.select(F.explode(F.concat(own, others)).alias("l")).select("l.*").distinct()


def linked(sets: list[bytes], least: float) -> np.ndarray:
    """For each sorted set of hashes, none empty, the smallest index reachable over similarities of ``least`` or more."""
    sizes = np.array([len(s) // 8 for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    values, codes = np.unique(np.frombuffer(b"".join([sets[k] for k in order]), U64), return_inverse=True)
    behind = np.searchsorted(sizes, np.floor(sizes / least + 1e-9), "right")  # sets too large for a set
    label = np.arange(len(sets))
    inside = np.zeros(len(values), np.int32)
    for i in range(len(sets)):
        j = i + 1 + np.flatnonzero(label[i + 1 : behind[i]] != label[i])
        if not len(j):
            continue
        own = codes[starts[i] : starts[i + 1]]
        inside[own] = 1
        if len(j) == behind[i] - i - 1:
            shared = np.add.reduceat(inside[codes[starts[i + 1] : starts[behind[i]]]], starts[j] - starts[i + 1])
        else:
            n = sizes[j]
            upto = np.cumsum(n)
            at = np.arange(upto[-1]) + np.repeat(starts[j] - upto + n, n)
            shared = np.add.reduceat(inside[codes[at]], upto - n)
        inside[own] = 0
        near = j[shared / (sizes[i] + sizes[j] - shared) >= least]
        if len(near):
            some = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, some)] = some[0]
    place = np.empty_like(order)
    place[order] = label
    first = np.full(len(sets), len(sets))
    np.minimum.at(first, place, np.arange(len(sets)))
    return first[place]


def exact_components(members: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """node, label (a node of its group) where sets link at a Jaccard similarity of ``least`` or more.

    ``members``: node (long, unique), component (sets of different components are not similar) and set (sorted
    hashes), written. A component is compared whole if it is small. A large one is cut into blocks by
    hash; one member of each group found there is compared again, as long as that halves them; what is still in
    different groups after that is compared block by block. Sets that may link lie in the same or neighbouring size
    levels, so other blocks do not meet, nor do blocks of one and the same group.
    """
    n, size = F.count("*") / F.lit(block), F.sum(F.octet_length("set")) / F.lit(BLOCK_BYTES)
    parts = F.ceil(F.greatest(n, size)).cast("long")
    level = F.floor(F.log(F.octet_length("set") / F.lit(8.0)) / F.log(F.lit(1 / least)) + F.lit(1e-9)).cast("long")

    def within(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("component", "ascending"), ("node", "ascending")])
        nodes, of = rows.column("node").to_numpy(), rows.column("component").to_numpy()
        sets, label = rows.column("set").to_pylist(), nodes.copy()
        cuts = [0, *(1 + np.flatnonzero(of[1:] != of[:-1])).tolist(), len(of)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            label[x:y] = nodes[x:y][linked(sets[x:y], least)]
        return pa.table([rows.column("component"), rows.column("node"), pa.array(label), rows.column("blocks")], ["component", "node", "label", "blocks"])

    whole = members.agg(n.alias("n"), size.alias("size")).first()
    bins = 1 + int(max(whole.n, whole["size"] or 0))
    labels, left, large, turn, written = None, members, None, 0, []
    while True:
        cut = left.join(left.groupBy("component").agg(parts.alias("blocks")), "component")
        cut = cut.withColumn("block", F.pmod(F.xxhash64("node", F.lit(turn)), "blocks"))
        # small components share a task
        cut = cut.withColumn("bin", F.when(F.col("blocks") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bins))))
        found = staged(cut.groupBy(F.col("blocks") > 1, "bin", "block").applyInArrow(within, "component long, node long, label long, blocks long"), "verified")
        written.append(found)
        if labels is None:
            labels = found.select("component", "node", "label")
            large = found.where("blocks > 1").select("component").distinct()
        else:
            step = found.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = labels.join(step, "label", "left").select("component", "node", F.coalesce("next", "label").alias("label"))
            labels = staged(labels, "verified")
        some = found.where("blocks > 1").agg(F.count("*").alias("n"), F.count_if(F.col("node") == F.col("label")).alias("groups")).first()
        if not some.n or 2 * some.groups > some.n:
            break
        left, turn = left.join(found.where("blocks > 1 AND node = label").select("node"), "node", "left_semi"), turn + 1
    several = labels.join(large, "component", "left_semi").groupBy("component").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    several = staged(several.where("x <> y").select("component"), "several")
    if several.isEmpty():
        return labels.select("node", "label")

    # groups of more than a block have blocks of their own, the others of a component and size level share some
    rows = members.join(several, "component").join(labels.select("node", "label"), "node").withColumn("level", level)
    groups = staged(rows.groupBy("component", "label", "level").agg(parts.alias("parts"), n.alias("n"), size.alias("size")), "groups")
    shared = F.ceil(F.greatest(F.sum("n"), F.sum("size"))).cast("long").alias("shared")
    rest = groups.where("parts = 1").groupBy("component", "level").agg(shared)
    rows = rows.join(groups.select("component", "label", "level", "parts"), ["component", "label", "level"]).join(rest, ["component", "level"], "left")
    big = F.col("parts") > 1
    place = F.struct(
        "level", big.alias("big"), F.when(big, F.col("label")).otherwise(0).alias("own"),
        F.when(big, F.pmod(F.xxhash64("node"), "parts")).otherwise(F.pmod(F.xxhash64("label"), "shared")).alias("block"),
    )
    rows = staged(rows.select("component", "label", "node", "set", place.alias("place")), "placed")
    places = rows.select("component", F.col("place").alias("p")).distinct()
    apart = (F.col("p") <= F.col("q")) & (F.col("q.level") - F.col("p.level") <= 1)
    apart = apart & ~(F.col("p.big") & F.col("q.big") & (F.col("p.own") == F.col("q.own")))
    met = places.join(places.withColumnRenamed("p", "q"), "component").where(apart)
    met = met.withColumn("place", F.explode(F.array_distinct(F.array("p", "q")))).withColumn("pair", F.xxhash64("p", "q"))

    def across(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        label = rows.column("label").to_numpy()
        near = label[linked(rows.column("set").to_pylist(), least)]
        edges = np.unique(np.column_stack([near, label])[near != label], axis=0)
        return pa.table([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    work = met.select("component", "place", "pair").join(rows, ["component", "place"]).select("component", "pair", "label", "node", "set")
    joined = components(work.groupBy("component", "pair").applyInArrow(across, "a long, b long"))
    joined = joined.select(F.col("node").alias("label"), F.col("component").alias("next"))
    labels = staged(labels.join(joined, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "verified")
    discard(rows, groups, several, *written)
    return labels


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """One document of each group whose sets of shingles link at a Jaccard similarity of ``least`` or more.

    Of a group the smallest id stays, then the smallest hash of the text. Rows and columns are unchanged. The
    candidate search is laid out for similarities of 0.8 or more.
    """
    if not 0.8 <= least < 1:
        raise ValueError("candidates are found for similarities from 0.8, below 1")
    own = staged(shingle_sets(docs, words), "shingle-sets")
    entries = own.where("size > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "fps", "less")])
    entries = staged(entries, "entries")
    near = staged(contracted(candidate_links(entries, chunk).unionAll(small_links(entries))), "candidate-links")
    discard(entries)
    candidates = components(near)
    one = own.join(candidates, "node").groupBy("node", "component").agg(F.min(F.struct("doc_id", "version")).alias("key"))
    one = staged(one.select("node", "component", "key.doc_id", "key.version"), "compared")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.unique(hashes(t, words)).tobytes() for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "node"), column(batch, "component"), pa.array(found, pa.binary())], ["node", "component", "set"])

    texts = keyed(docs).join(one, ["doc_id", "version"])
    members = texts.select("node", "component", "text").mapInArrow(sets, "node long, component long, set binary")
    members = staged(members.dropDuplicates(["node"]), "members")
    labels = exact_components(members, least)
    first = own.join(labels, "node", "left").groupBy(F.coalesce("label", "node")).agg(F.min(F.struct("doc_id", "version")).alias("key"))
    first = staged(first.select(F.col("key.doc_id").alias("doc_id"), F.col("key.version").alias("version")), "kept-keys")
    discard(members, near, one)
    # the row itself is packed, so that its columns may have any names
    packed = docs.select(F.struct("*").alias("row"), row_id().alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("version"))
    kept = packed.join(first, ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"])
    return kept.select("row.*")
