"""One registered query per operator, over its whole table, and its SQL where SQL can state it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsieve.llm import alignment, binary, bpe, chat, cotrain, descent, langid, packing, pii, rangejoin, runs, simhash, suffix
from gridsieve.llm.common import staged
from gridsieve.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"
BYTE_BPE_RANKS = "byte_bpe_50k.tiktoken"
PIECE_BPE = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_shards")
def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-shards")
    binary.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE), end_id=0)
    return binary.digests(binary.read_shards(spark, path))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.piece_digests(packing.pack_documents(docs, public_tokenizers.path(BYTE_BPE), end_id=1, size=2048))


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip_digests(docs, public_tokenizers.path(BYTE_BPE_RANKS), public_tokenizers.PATTERN)


@query("op2_chat_format", chat.SQL)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict_languages(docs.select("doc_id", "text"), langid.fit_languages(docs))
    return found.select("doc_id", F.coalesce(langid.fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)


@query("op5_range_join")
def op5_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangejoin.near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


@query("op7_nn_descent")
def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descent.search_nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(suffix.remove_repeats(table(spark, sf_dir, "documents")))


def _periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by a hash of its id, repeats a cycle of words from some word to its end."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.collapse_runs(table(spark, sf_dir, "documents"), rewrite=_periodic))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    aligned = alignment.align_documents(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    rest = [c for c in aligned.columns if c != "groups"]
    return alignment.score_links(staged(aligned.select(*rest, digest), "aligned"))


@query("op13_personal_data")
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(table(spark, sf_dir, "documents")))
