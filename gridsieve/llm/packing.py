"""Bounded-space online packing of token ids into windows of fixed length.

Each partition keeps at most ``open_windows`` windows open. A document's ids (with the end id) are cut
into full windows and a remainder; the remainder goes whole into the open window it fills best. When
none holds it, the fullest window is topped up with the head of the remainder and emitted, so no
emitted window carries padding. At the end a partition merges its open windows into full ones and one
leftover; the leftovers of all partitions are laid end to end (their offsets come from one row per
partition) and cut again. The last, incomplete window is cut at powers of two.

Defined cases: a null or empty text is the end id alone; a null id stays null; repeated rows are
packed once each; an empty table gives no sequence. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsieve.llm.common import column, documents, slices, staged
from gridsieve.llm.tokens import unit_encoder

PIECE = "struct<doc_id: bigint, start: bigint, length: bigint, offset: bigint, doc_tokens: bigint>"
SEQUENCES = f"sequence_id long, ids binary, pieces array<{PIECE}>"
_FIELDS = ("doc_id", "start", "length", "offset", "doc_tokens")
_PIECES = pa.list_(pa.struct([(name, pa.int64()) for name in _FIELDS]))


class Open:
    """A window being filled: ids as bytes and the pieces they come from."""

    __slots__ = ("chunks", "pieces", "length")

    def __init__(self):
        self.chunks, self.pieces, self.length = [], [], 0

    def add(self, key, ids: bytes, start: int, stop: int, total: int) -> None:
        """Ids start..stop of a document of ``total`` ids."""
        self.chunks.append(ids[4 * start : 4 * stop])
        self.pieces.append((key, start, stop - start, self.length, total))
        self.length += stop - start


def packed(rows: Iterator[tuple[int | None, bytes]], size: int, open_windows: int) -> Iterator[tuple[Open, bool]]:
    """Windows as they are emitted, and whether each is full; at most one, the last, is not."""
    held: list[Open] = []
    for key, ids in rows:
        total = len(ids) // 4
        at = 0
        while total - at >= size:
            full = Open()
            full.add(key, ids, at, at + size, total)
            yield full, True
            at += size
        while at < total:
            rest = total - at
            best = min((w for w in held if size - w.length >= rest), key=lambda w: size - w.length, default=None)
            if best is None and len(held) < open_windows:
                best = Open()
                held.append(best)
            if best is None:
                best = max(held, key=lambda w: w.length)
                rest = size - best.length
            best.add(key, ids, at, at + rest, total)
            at += rest
            if best.length == size:
                held.remove(best)
                yield best, True
    merged = Open()
    for window in sorted(held, key=lambda w: -w.length):
        for chunk, (key, start, length, _, total) in zip(window.chunks, window.pieces, strict=True):
            done = 0
            while done < length:
                n = min(length - done, size - merged.length)
                merged.chunks.append(chunk[4 * done : 4 * (done + n)])
                merged.pieces.append((key, start + done, n, merged.length, total))
                merged.length += n
                done += n
                if merged.length == size:
                    yield merged, True
                    merged = Open()
    if merged.length:
        yield merged, False


def _ends(length: int, size: int) -> list[int]:
    """Where an incomplete window of this length is cut: after each power of two, largest first."""
    ends, at = [], 0
    for bit in reversed(range(size.bit_length())):
        if length >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, open_windows: int = 32) -> DataFrame:
    """sequence_id (0, 1, ... without gaps), ids (little-endian unsigned 32-bit) and the pieces in order."""
    end = int(end_id).to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = unit_encoder(tokenizer), TaskContext.get().partitionId(), 0

        def rows():
            for batch in slices(batches):
                encoded = encoder.encode(column(batch, "text").to_pylist())
                for key, ids in zip(column(batch, "doc_id").to_pylist(), encoded, strict=True):
                    yield key, ids + end

        out: list[tuple] = []
        for window, full in packed(rows(), size, open_windows):
            out.append((part, number, full, window.length, b"".join(window.chunks), window.pieces))
            number += full
            if len(out) == 128:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    windows = staged(
        documents(docs).mapInArrow(pack, f"part int, number long, full boolean, length long, ids binary, pieces array<{PIECE}>"),
        "packed",
    )
    # one row per partition of the input
    parts = windows.groupBy("part").agg(
        F.sum(F.col("full").cast("long")).alias("n_full"),
        F.sum(F.when(~F.col("full"), F.col("length")).otherwise(0)).alias("left"),
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(
        "part",
        F.coalesce(F.sum("n_full").over(earlier), F.lit(0)).alias("base"),
        F.coalesce(F.sum("left").over(earlier), F.lit(0)).alias("at"),
    )
    n_full, n_left = parts.agg(F.coalesce(F.sum("n_full"), F.lit(0)), F.coalesce(F.sum("left"), F.lit(0))).first()
    placed = windows.join(F.broadcast(bases), "part")  # one row of three numbers per partition of the input
    whole = placed.where("full").select((F.col("base") + F.col("number")).alias("sequence_id"), "ids", "pieces")
    return whole.unionAll(_leftovers(placed.where("NOT full"), n_full, n_left, size))


def _batch(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), _PIECES]
    cols = [list(c) for c in zip(*out, strict=True)]
    cols[5] = [[dict(zip(_FIELDS, p, strict=True)) for p in pieces] for pieces in cols[5]]
    names = ["part", "number", "full", "length", "ids", "pieces"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _leftovers(rows: DataFrame, n_full: int, n_left: int, size: int) -> DataFrame:
    """The partitions' leftovers end to end, cut into windows; at most one row per partition comes in."""
    whole = n_left // size
    ends = [whole * size + x for x in _ends(n_left - whole * size, size)]

    def bounds(at: int) -> tuple[int, int, int]:
        """Sequence that holds a position of the joined leftovers, and where it starts and ends."""
        if at < whole * size:
            return n_full + at // size, at // size * size, at // size * size + size
        starts = [whole * size, *ends]
        i = next(i for i, e in enumerate(ends) if at < e)
        return n_full + whole + i, starts[i], ends[i]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for p in row["pieces"]:
                    done = 0
                    while done < p["length"]:
                        at = row["at"] + p["offset"] + done
                        sequence, first, stop = bounds(at)
                        n = min(p["length"] - done, stop - at)
                        ids = row["ids"][4 * (p["offset"] + done) : 4 * (p["offset"] + done + n)]
                        out.append((sequence, at - first, ids, p["doc_id"], p["start"] + done, n, p["doc_tokens"]))
                        done += n
            types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            cols = zip(*out, strict=True) if out else [[] for _ in types]
            names = ["sequence_id", "offset", "ids", "doc_id", "start", "length", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)

    pieces = rows.select("at", "ids", "pieces").mapInArrow(
        cut, "sequence_id long, offset long, ids binary, doc_id long, start long, length long, doc_tokens long"
    )
    # a sequence holds at most ``size`` ids, so its group is bounded
    groups = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "start", "length", "doc_tokens"))).alias("p")
    )
    return groups.select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(*[x[name].alias(name) for name in _FIELDS])).alias("pieces"),
    )


def pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and its ids, cut out of its sequence."""
    rows = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    ids = F.expr("substring(ids, CAST(p.offset * 4 + 1 AS INT), CAST(p.length * 4 AS INT))")
    return rows.select("p.doc_id", "p.start", "p.length", "p.doc_tokens", "sequence_id", "p.offset", ids.alias("ids"))


def piece_digests(sequences: DataFrame) -> DataFrame:
    """The pieces with the unsigned crc32 of their ids."""
    return pieces(sequences).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
