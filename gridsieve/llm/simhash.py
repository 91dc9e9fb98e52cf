"""SimHash near-duplicates through a hierarchical index in Gray order.

Two 64-bit fingerprints within ``radius`` bits have, among their four 16-bit blocks, one that differs in at
most ``radius // 4`` bits. For each block the distinct fingerprints are rotated so that it leads, sorted by
Gray rank (the position in the reflected Gray code, where neighbours differ in few bits) and cut into chunks.
Inside a chunk runs of neighbours form the nodes of a tree: a node holds, as mask and pattern, the bits that
all its members share and its parent does not, so the differences of a fingerprint to a group add up on the
way down, and a group is left as soon as they exceed the radius, or exceed ``radius // 4`` in the leading
block. Chunks are nodes as well: only pairs of chunks whose shared bits allow a match are brought together.

Equal fingerprints are one entry, so copies cost nothing. Each pair of chunks reports a spanning set of the
links it finds (components are all that is asked for), never all pairs of a group.

Defined cases: a null or empty text has fingerprint zero, linked like any other; every row is a document of its own, also
if it shares its id with others or has none; a null id stays null and is left out when the smallest id is taken (a group
of null ids alone has a null component_id); an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.common import column, documents, slices, staged
from gridsieve.llm.components import components

CHUNK = 32_768
BRANCH = 8
SIGN = 1 << 63
U64 = np.uint64


def shingles(text: str | None, words: int) -> list[bytes]:
    """Space-joined runs of words; one of all words if there are fewer; none for no word."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    joined = b" ".join(found)
    if len(found) <= words:
        return [joined] if found else []
    ends, at = [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    return [joined[s:e] for s, e in zip(starts, ends[words - 1 :])]  # noqa: B905  ends is shorter


def hashes(text: str | None, words: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingles(text, words)], U64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >= SIGN else value


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [signed(fingerprint(hashes(t, words))) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


def rotate(fps: np.ndarray, bits: int) -> np.ndarray:
    return fps if not bits else fps << U64(bits) | fps >> U64(64 - bits)


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Position of each bit pattern in the reflected Gray code."""
    out = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> U64(shift)
    return out


class GrayTree:
    """Nodes over fingerprints sorted by Gray rank, the widest level first."""

    def __init__(self, fps: np.ndarray):
        every, any_ = [fps], [fps]
        while len(every[-1]) > BRANCH:
            starts = np.arange(0, len(every[-1]), BRANCH)
            every.append(np.bitwise_and.reduceat(every[-1], starts))
            any_.append(np.bitwise_or.reduceat(any_[-1], starts))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        above = None
        for ones, some in zip(every[::-1], any_[::-1], strict=True):
            shared = ~(ones ^ some)  # bits on which all members agree
            mask = shared if above is None else shared & ~np.repeat(above, BRANCH)[: len(shared)]
            self.levels.append((mask, ones))
            above = shared

    def search(self, queries: np.ndarray, radius: int, lead: int, leading: int = 16):
        """Pairs (query index, fingerprint index) within the radius, in bounded slices of queries."""
        front = ~U64(0) << U64(64 - leading)
        for at in range(0, len(queries), 128):
            q = queries[at : at + 128]
            mask, ones = self.levels[0]
            who = np.repeat(np.arange(len(q)), len(mask))
            node = np.tile(np.arange(len(mask)), len(q))
            total = np.zeros(len(who), np.uint8)
            ahead = np.zeros(len(who), np.uint8)
            for depth, (mask, ones) in enumerate(self.levels):
                if depth:
                    node = (node[:, None] * BRANCH + np.arange(BRANCH)).ravel()
                    who, total, ahead = (np.repeat(x, BRANCH) for x in (who, total, ahead))
                    there = node < len(mask)
                    who, node, total, ahead = who[there], node[there], total[there], ahead[there]
                differ = (q[who] ^ ones[node]) & mask[node]
                total = total + np.bitwise_count(differ)
                ahead = ahead + np.bitwise_count(differ & front)
                near = (total <= radius) & (ahead <= lead)
                who, node, total, ahead = who[near], node[near], total[near], ahead[near]
            yield at + who, node


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For 0..n-1, the smallest index reachable over the pairs."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(label[a], label[b])
            if (label[a] == low).all() and (label[b] == low).all():
                break
            for x in (label[a], label[b], a, b):
                np.minimum.at(label, x, low)
            while (label[label] != label).any():
                label = label[label]
    while (label[label] != label).any():
        label = label[label]
    return label


def links(entries: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints within ``radius`` bits.

    ``entries``: node (long, unique) and fp.
    """
    lead = radius // 4

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = column(batch, "fp").to_numpy().view(U64)
            for turn in range(4):
                own = rotate(fps, 16 * turn)
                rank = (gray_rank(own) ^ U64(SIGN)).view(np.int64)  # ordered as signed longs
                columns = [pa.array(np.full(len(fps), turn, np.int32)), pa.array(rank), column(batch, "node"), pa.array(own.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["turn", "rank", "node", "own"]
    schema = "turn int, rank long, node long, own long"
    n = entries.count()
    parts = max(1, -(-4 * n // chunk))
    ordered = entries.mapInArrow(turned, schema).repartitionByRange(parts, "turn", "rank").sortWithinPartitions("turn", "rank")

    # chunks meet by their first bits, as many as tell about so many chunks apart; these may differ in ``lead``
    bits = min(16, max(0, (n // chunk).bit_length()))
    flips = np.array([sum(1 << i for i in some) for k in range(min(lead, bits) + 1) for some in combinations(range(bits), k)], np.int64)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal number
            turn = rows.column("turn").to_numpy()
            for t in np.unique(turn):
                some = rows.filter(pa.array(turn == t))
                own = some.column("own").to_numpy().view(U64)
                ones, any_ = np.bitwise_and.reduce(own), np.bitwise_or.reduce(own)
                keys = np.unique((own >> U64(48)).astype(np.int64) >> 16 - bits)
                probes = np.unique(keys[:, None] ^ flips)
                row = [int(t), task << 32 | number, keys.tolist(), probes.tolist(), signed(int(~(ones ^ any_))), signed(int(ones))]
                row += [own.tobytes(), some.column("node").to_numpy().tobytes()]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], chunk_names)

        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                held.append(batch.slice(i, 4096))
                size += held[-1].num_rows
                if size >= chunk:
                    yield from emit(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield from emit(pa.Table.from_batches(held))

    longs = pa.list_(pa.int64())
    kinds = [pa.int32(), pa.int64(), longs, longs, pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    chunk_names = ["turn", "id", "keys", "probes", "mask", "ones", "fps", "nodes"]
    chunk_schema = "turn int, id long, keys array<long>, probes array<long>, mask long, ones long, fps binary, nodes binary"
    chunks = staged(ordered.mapInArrow(chunked, chunk_schema), "chunks")
    # nodes above the chunks: pairs of chunks that may hold a match, from their shared bits alone
    keys = chunks.select("turn", "id", "mask", "ones", F.explode("probes").alias("key"))
    right = chunks.select("turn", F.explode("keys").alias("key"), *[F.col(c).alias(f"{c}_b") for c in ("id", "mask", "ones")])
    front = F.lit(signed(0xFFFF << 48))
    differ = F.col("ones").bitwiseXOR(F.col("ones_b")).bitwiseAND(F.col("mask").bitwiseAND(F.col("mask_b")))
    met = keys.join(right, ["turn", "key"]).where(
        (F.col("id") <= F.col("id_b")) & (F.bit_count(differ) <= radius) & (F.bit_count(differ.bitwiseAND(front)) <= lead)
    )
    met = met.select("id", "id_b").distinct()
    body = ["fps", "nodes"]
    left = chunks.select("id", *body)
    other = chunks.select(F.col("id").alias("id_b"), *[F.col(c).alias(f"{c}_b") for c in body])
    work = met.join(left, "id").join(other, "id_b").repartition(parts, "id", "id_b")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = (np.frombuffer(row[c], U64) for c in ("fps", "fps_b"))
                nodes = np.concatenate([np.frombuffer(row[c], np.int64) for c in ("nodes", "nodes_b")])

                def pairs(a=a, b=b):
                    for i, j in GrayTree(b).search(a, radius, lead):
                        yield i, len(a) + j

                order = np.argsort(nodes, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                label = spanning(len(nodes), ((place[i], place[j]) for i, j in pairs()))
                ranked = nodes[order]
                far = ranked[label] != ranked
                yield pa.RecordBatch.from_arrays([pa.array(ranked[label][far]), pa.array(ranked[far])], ["a", "b"])

    return work.mapInArrow(matched, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links).

    Fingerprints link at ``radius`` or fewer differing bits.
    """
    own = staged(fingerprints(docs, words), "fingerprints")
    # a distinct fingerprint is the name of its rows; ids are only asked for their smallest
    entries = staged(own.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")), "entries")
    found = components(links(entries, radius))
    known = entries.join(found, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("component"))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = known.join(smallest, "component").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
