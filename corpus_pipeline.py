"""A corpus pipeline of five of the operators: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. run() writes each stage's rows below ``spark.checkpoint.dir`` and reads them back as the next one's.

Defined cases are those of the operators: null, empty and very long texts, null ids, repeated rows and empty
tables pass every stage; columns other than doc_id, text, lang, source and n_chars are handed through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsieve.llm import cotrain, langid, packing, similar, suffix
from gridsieve.llm.common import staged

#: A language is recognised from this mean probability on, if no learned language is not likelier still; a text of several
#: languages in equal parts stays.
LANGUAGE_SCORE = 0.25
#: The classifier's own bound, as in op6_quality.
QUALITY_SCORE = cotrain.ACCEPTED


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are in none of the learned languages, or have no letter."""
    return langid.accept_languages(docs, langid.fit_languages(docs, reject=True), LANGUAGE_SCORE)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier does not accept."""
    return cotrain.accept_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), QUALITY_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones (five-word shingles, similarity of 0.8 or more)."""
    return similar.keep_one(docs, words=5, least=0.8)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte of a 100-byte string that also starts earlier; n_chars follows the text."""
    cleaned = suffix.clean_texts(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids into sequences of 2048; one row per piece, with its ids."""
    sequences = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, size=2048)
    return packing.pieces(sequences)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", filter_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_passages),
    ("packing", pack),
]

#: SQL cannot state the trained stages; tests hold them against brute force and held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
