"""Token shards: every document's ids as its own zstandard frame under one shared dictionary.

Layout below a path:
  dictionary/  one row: dict_hash (sha256), dictionary, id_bytes (2 or 4), end_id
  blocks/      one row per block of documents in ascending id: dict_hash, shard, block, before (ids
               of the shard in front of the block), doc_ids, offsets (of each frame in the payload,
               and its end), n_tokens, payload

The dictionary is trained on a bounded sample of serialised id arrays. A frame opens without its
neighbours, so a short document is read by its offset alone.

Defined cases: a null or empty text holds only the end id; a null id sorts first and stays null; rows
with the same id follow each other in the order of their texts; an empty table gives an empty set of
shards. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsieve.llm.common import column, default_partitions, documents, save, slices, under
from gridsieve.llm.tokens import unit_encoder

BLOCKS = (
    "dict_hash string, shard int, block int, before long, first_id long, last_id long, doc_ids array<long>, "
    "offsets array<long>, n_tokens array<long>, payload binary"
)
_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
_LONGS = pa.list_(pa.int64())
_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), _LONGS, _LONGS, _LONGS, pa.binary()]
#: Documents and bytes of each that the dictionary is trained on, and its size.
SAMPLE_DOCUMENTS = 400
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
BLOCK_BYTES = 1_000_000


def train_dictionary(samples: Sequence[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, list(samples), level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def _narrow(ids: bytes, id_bytes: int) -> bytes:
    return ids if id_bytes == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _wide(ids: bytes, id_bytes: int) -> bytes:
    return ids if id_bytes == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_bytes: int = 2, partitions: int | None = None
) -> None:
    """Encodes every whole text and writes the shards in ascending order of id.

    ``tokenizer`` names a file that every executor can open; ``id_bytes`` 2 holds vocabularies below 65,536.
    """
    spark = docs.sparkSession
    docs = documents(docs)
    end = int(end_id).to_bytes(4, "little")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(tokenizer)
        for batch in slices(batches):
            ids = [_narrow(x[: 2 * SAMPLE_BYTES] + end, id_bytes) for x in encoder.encode(column(batch, "text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    sample = docs.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(SAMPLE_DOCUMENTS)
    content = train_dictionary([r.ids for r in sample.mapInArrow(sampled, "ids binary").collect()])
    digest = hashlib.sha256(content).hexdigest()
    save(
        spark.createDataFrame(
            [(digest, bytearray(content), id_bytes, end_id)], "dict_hash string, dictionary binary, id_bytes int, end_id int"
        ),
        under(path, "dictionary"),
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze = unit_encoder(tokenizer), zstandard.ZstdCompressor(level=3, dict_data=_dictionary(content))
        shard, number, before, held = TaskContext.get().partitionId(), 0, 0, 0
        keys, frames, counts = [], [], []

        def block() -> pa.RecordBatch:
            offsets = [0, *np.cumsum([len(f) for f in frames]).tolist()]
            row = [digest, shard, number, before, keys[0], keys[-1], keys, offsets, counts, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], _NAMES)

        for batch in slices(batches):
            encoded = encoder.encode(column(batch, "text").to_pylist())
            for key, ids in zip(column(batch, "doc_id").to_pylist(), encoded, strict=True):
                keys.append(key)
                counts.append(len(ids) // 4 + 1)
                frames.append(squeeze.compress(_narrow(ids + end, id_bytes)))
                held += len(frames[-1])
                if held >= BLOCK_BYTES:
                    yield block()
                    number, before, held = number + 1, before + sum(counts), 0
                    keys, frames, counts = [], [], []
        if keys:
            yield block()

    ordered = docs.repartitionByRange(partitions or default_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    save(ordered.mapInArrow(blocks, BLOCKS), under(path, "blocks"))


def _opened(spark: SparkSession, path: str) -> tuple[str, bytes, int]:
    row = spark.read.parquet(under(path, "dictionary")).first()
    content = bytes(row.dictionary)
    if hashlib.sha256(content).hexdigest() != row.dict_hash:
        raise ValueError(f"the dictionary of {path} does not have its hash")
    return row.dict_hash, content, row.id_bytes


def _frames(digest: str, content: bytes, id_bytes: int, wanted: set[int] | None = None):
    """A mapInArrow function from blocks to one row per document (of ``wanted`` alone, by its offset)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_hash"] != digest:
                    raise ValueError("a block was written under another dictionary")
                start = row["base"] + row["before"]
                out = ([], [], [], [])
                for i, key in enumerate(row["doc_ids"]):
                    n = row["n_tokens"][i]
                    if wanted is None or key in wanted:
                        frame = row["payload"][row["offsets"][i] : row["offsets"][i + 1]]
                        for x, v in zip(out, (key, start, n, _wide(opener.decompress(frame), id_bytes)), strict=True):
                            x.append(v)
                    start += n
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], _READ)

    return read


_READ = ["doc_id", "start", "n_tokens", "ids"]


def read_shards(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit).

    ``only`` reads just these documents: blocks by their range of ids, frames by their offset.
    """
    digest, content, id_bytes = _opened(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(under(path, "blocks"))
    # one row per shard, however many documents there are
    totals = blocks.groupBy("shard").agg(F.max(F.col("before") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("held"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("held").over(earlier), F.lit(0)).cast("long").alias("base"))
    if only is not None:
        ids = sorted(set(only))
        within = [F.col("first_id").isNull() | ((F.col("first_id") <= x) & (F.col("last_id") >= x)) for x in ids]
        blocks = blocks.where(F.lit(False) if not within else _any(within))
    rows = blocks.join(bases, "shard")
    return rows.mapInArrow(
        _frames(digest, content, id_bytes, None if only is None else set(only)),
        "doc_id long, start long, n_tokens long, ids binary",
    )


def _any(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids read back."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
