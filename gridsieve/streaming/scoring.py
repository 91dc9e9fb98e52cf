"""Scores new rows as they arrive. Scoring keeps no state, so batch code runs on a stream unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridsieve.session import new_path


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", glob: str | None = None, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def score_available(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], out: str | None = None, checkpoint: str | None = None) -> str:
    """Runs the scorer over everything available and returns the output path.

    Offsets and output live in the shared folder; a restart with the same checkpoint continues
    where the last run ended.
    """
    spark = stream.sparkSession
    out = out or new_path(spark, "scored")
    checkpoint = checkpoint or new_path(spark, "offsets")
    run = (
        scorer(stream).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).start(out)
    )
    run.awaitTermination()
    return out
