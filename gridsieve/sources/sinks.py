"""Sinks: tables, one-record summaries and fitted state. Outputs are new paths, never the input."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()
) -> str:
    """Writes a table, parquet by default; many files in parallel, optionally partitioned."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        # texts keep their outer white space and line breaks; CSV cannot tell an empty text from a missing one
        writer = writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.format(fmt).save(path)
    return path


def write_record(summary: DataFrame, path: str) -> str:
    """Writes a one-row summary as JSON, computed once. More than one row is an error (two rows are looked at)."""
    rows = summary.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"a record needs exactly one row, got {'several' if rows else 'none'}")
    summary.sparkSession.createDataFrame(rows, summary.schema).coalesce(1).write.mode("overwrite").json(path)
    return path


def write_augmented(df: DataFrame, source_path: str, path: str, **kw) -> str:
    """Writes a widened version of a table beside it; refuses to overwrite the table it is read from."""
    if path.rstrip("/") == source_path.rstrip("/"):
        raise ValueError("write the widened table to a new path, or a new version with write_version")
    return write_table(df, path, **kw)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a job has written this folder to its end."""
    files, where = _files(spark, f"{path}/_SUCCESS")
    return files.exists(where)


POINTER = "_CURRENT-"


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Published versions: (number, folder), ascending. A pointer is an empty file whose name says both."""
    files, where = _files(spark, path)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    found = [n.removeprefix(POINTER).split("-", 1) for n in names if n.startswith(POINTER)]
    return sorted((int(number), folder) for number, folder in found)


def write_version(df: DataFrame, path: str, keep: int = 2, **kw) -> str:
    """Writes the next version of the table called ``path``, also one made from the version before.

    The rows go to a folder of their own; only when they are all written a pointer is created beside the folders, in one
    step of the file system. Readers follow the newest pointer, so they see the old or the new version, whole; an
    interrupted write leaves a folder that nothing points to. The ``keep`` newest versions stay, for readers under way.
    A table has one writer at a time; one that finds its number published by another raises.
    """
    spark = df.sparkSession
    known = _versions(spark, path)
    number = known[-1][0] + 1 if known else 1
    folder = f"v{number}-{uuid.uuid4().hex}"
    write_table(df, f"{path}/{folder}", mode="errorifexists", **kw)
    files, pointer = _files(spark, f"{path}/{POINTER}{number:012d}-{folder}")
    if any(n >= number for n, _ in _versions(spark, path)) or not files.createNewFile(pointer):
        raise RuntimeError(f"version {number} of {path} was published by another writer")
    for old, name in known[: max(0, len(known) + 1 - keep)]:
        for gone in (f"{path}/{POINTER}{old:012d}-{name}", f"{path}/{name}"):
            files, where = _files(spark, gone)
            files.delete(where, True)
    return f"{path}/{folder}"


def current_version(spark: SparkSession, path: str) -> str:
    """The folder of the newest published version."""
    known = _versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no version of {path} is published")
    return f"{path}/{known[-1][1]}"


def read_version(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The newest published version of the table called ``path``."""
    return spark.read.format(fmt).load(current_version(spark, path))


def save_model(fitted: PipelineModel, path: str) -> str:
    fitted.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_state(df: DataFrame, path: str) -> DataFrame:
    """Persists a fitted dimension (medians, encodings, q_hat) and returns it as read back.

    Also the way to cut lineage between stages: a written table survives executor loss.
    """
    write_table(df, path)
    return load_state(df.sparkSession, path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
