"""Small helpers shared by the operators: staging, row keys, batches of bounded size."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsieve.session import new_path

#: Stands for a null document id inside the operators: it sorts before every other id.
NULL_ID = -(2**63)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows below ``spark.checkpoint.dir`` and reads them back: lineage ends there."""
    path = new_path(df.sparkSession, name)
    written = save(df, path)
    written._staged_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again, also not a lost executor's tasks that run anew."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def under(path: str, name: str) -> str:
    return os.path.join(path, name)


def row_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, as ``doc_id`` and ``text``; other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", budget: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that one slice holds about ``budget`` bytes of ``text``, or a single longer row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start, held = 0, 0
        for i, size in enumerate(pa.compute.binary_length(column).to_pylist()):
            if held and held + (size or 0) > budget:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if batch.num_rows > start:
            yield batch.slice(start)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
