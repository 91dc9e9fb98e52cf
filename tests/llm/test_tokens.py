"""Token shards, packing and BPE against the libraries."""

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridsieve.llm import binary, bpe, packing
from gridsieve.llm.queries import QUERIES
from gridsieve.llm.tokens import unit_encoder
from gridsieve.session import new_path

import public_tokenizers

PIECES = st.lists(st.sampled_from(["the", " ", "  ", "\n", "a", "'s", "'ll", "é", "1", "$", "ing", "　", "\x1c", "'", "一", ".", "_"]), max_size=60)


@given(PIECES.map("".join))
@settings(max_examples=150, deadline=None)
def test_units_and_merges_equal_the_libraries(text):
    assert np.frombuffer(unit_encoder(brute.JSON).encode([text])[0], "<u4").tolist() == brute_encode(text)
    coder = bpe.bpe(brute.RANKS, public_tokenizers.PATTERN)
    ids = coder.encode(text)
    assert ids == TIK.encode_ordinary(text) and coder.decode(ids) == text.encode()


TIK = brute.tik()


def brute_encode(text):
    return brute.encode([text])[0]


def test_long_pieces_are_linear_and_exact():
    coder = bpe.bpe(brute.RANKS, public_tokenizers.PATTERN)
    for text in ("a" * 3000, "ab" * 2000, " " * 2000, "\n" * 999 + "x", "aaab" * 800 + "zz"):
        assert coder.encode(text) == TIK.encode_ordinary(text)


def check_shards(rows, docs):
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for (key, _), ids in zip(docs, brute.encode([t for _, t in docs]), strict=True):
        ids = [*ids, 0]
        want.append((key, at, len(ids), brute.crc(ids)))
        at += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1])
    assert got == want


def test_shards_query(spark, sf_dir):
    docs = [tuple(r) for r in brute.read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    check_shards(QUERIES["op1_token_shards"](spark, sf_dir).collect(), docs)


def test_shards_of_odd_rows_and_single_documents(spark):
    path = new_path(spark, "t-shards")
    binary.write_shards(brute.odd_docs(spark), path, brute.JSON, partitions=3)
    check_shards(binary.digests(binary.read_shards(spark, path)).collect(), brute.ODD_DOCS)
    some = {r.doc_id: bytes(r.ids) for r in binary.read_shards(spark, path, only=[6, 12, 99]).collect()}
    assert set(some) == {6, 12}
    ids = brute.encode([dict(brute.ODD_DOCS)[6]])[0]
    assert np.frombuffer(some[6], "<u4").tolist() == [*ids, 0]
    row = spark.read.parquet(f"{path}/dictionary").first()
    assert {r.dict_hash for r in spark.read.parquet(f"{path}/blocks").collect()} == {row.dict_hash}


def test_empty_tables(spark):
    path = new_path(spark, "t-empty")
    binary.write_shards(brute.empty_docs(spark), path, brute.JSON)
    assert binary.read_shards(spark, path).count() == 0
    assert packing.pack_documents(brute.empty_docs(spark), brute.JSON).count() == 0
    assert bpe.round_trip_digests(brute.empty_docs(spark), brute.RANKS, public_tokenizers.PATTERN).count() == 0


def check_packing(pieces, docs, size):
    full = {}
    for (key, _), ids in zip(docs, brute.encode([t for _, t in docs]), strict=True):
        full.setdefault(key, [*ids, 1])
    n_rows = {k: sum(1 for d, _ in docs if d == k) for k in full}
    for p in pieces:
        assert brute.crc(full[p.doc_id][p.start : p.start + p.length]) == p.ids_crc32 and p.doc_tokens == len(full[p.doc_id])
    for key, ids in full.items():
        times = np.zeros(len(ids), int)
        for p in pieces:
            if p.doc_id == key:
                times[p.start : p.start + p.length] += 1
        assert (times == n_rows[key]).all()
    lengths = []
    for sequence in {p.sequence_id for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p.sequence_id == sequence), key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        lengths.append(at)
    assert max(lengths) <= size and all(n & (n - 1) == 0 for n in lengths)
    assert sorted({p.sequence_id for p in pieces}) == list(range(len(lengths)))


def test_packing_query(spark, sf_dir):
    docs = [tuple(r) for r in brute.read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    check_packing(QUERIES["op8_packing"](spark, sf_dir).collect(), docs, 2048)


@pytest.mark.parametrize("size,windows", [(64, 2), (2048, 32)])
def test_packing_of_odd_rows(spark, size, windows):
    docs = brute.odd_docs(spark).where("doc_id IS NULL OR doc_id <> 14").repartition(3, "doc_id")
    packed = packing.pack_documents(docs, brute.JSON, 1, size, windows)
    check_packing(packing.piece_digests(packed).collect(), [d for d in brute.ODD_DOCS if d[0] != 14], size)


def test_bpe_query_and_odd_rows(spark, sf_dir):
    for got, docs in (
        (QUERIES["op10_byte_bpe"](spark, sf_dir), brute.read(spark, sf_dir, "documents").select("doc_id", "text")),
        (bpe.round_trip_digests(brute.odd_docs(spark), brute.RANKS, public_tokenizers.PATTERN), brute.odd_docs(spark).select("doc_id", "text")),
    ):
        want = []
        for r in docs.collect():
            ids = TIK.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), brute.sha(" ".join(map(str, ids)).encode()), brute.sha((r.text or "").encode())))
        key = lambda r: (r[0] is None, r[0] or 0)
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_bpe_frames(spark):
    ids = bpe.encode_documents(brute.odd_docs(spark), brute.RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_documents(ids, brute.RANKS, public_tokenizers.PATTERN).where(F.col("doc_id") == 6).first()
    assert bytes(back.data).decode() == dict(brute.ODD_DOCS)[6]
