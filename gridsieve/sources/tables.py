"""Scans: whole directories or files with declared schemas, NaN read as NULL."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsieve.functions.scalars import nan_to_null

READERS = {"json": "json", "jsonl": "json", "csv": "csv", "parquet": "parquet"}


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN in floating point columns becomes NULL, so aggregates skip it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in floats}) if floats else df


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, header: bool = True,
    multi_line: bool = False, mode: str = "FAILFAST",
) -> DataFrame:
    """CSV scan. Without a schema one inference pass is paid; give one for large inputs.

    A row that does not fit the schema is an error unless ``mode`` says otherwise. Quoted texts with
    line breaks need ``multi_line``; such files are not split, so write them as many files.
    """
    reader = spark.read.options(
        header=header, nanValue="NaN", escape='"', multiLine=multi_line, mode=mode,
        ignoreLeadingWhiteSpace=not multi_line, ignoreTrailingWhiteSpace=not multi_line,
    )
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return nulls_for_nan(df)


def read_json(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, array: bool = False
) -> DataFrame:
    """JSON scan: one object per line (splittable), or files holding one array of objects.

    A leading byte-order mark is accepted. An array file is parsed by a single task each, so
    large tables should come as lines or as many files.
    """
    reader = spark.read.option("multiLine", array).option("allowNonNumericNumbers", True)
    return nulls_for_nan((reader.schema(schema) if schema is not None else reader).json(path))


def read_column(spark: SparkSession, path: str, name: str = "w") -> DataFrame:
    """Headerless single-column numeric CSV."""
    return read_csv(spark, path, f"{name} double", header=False)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def data_files(spark: SparkSession, path: str) -> Iterator[str]:
    """Files below a path on any Hadoop file system, one after the other, without hidden ones and markers."""
    fs, top = _file_system(spark, path)
    if not fs.exists(top):
        return
    root = fs.getFileStatus(top).getPath().toString().rstrip("/")
    files = fs.listFiles(top, True)
    while files.hasNext():
        name = files.next().getPath().toString()
        if not any(part.startswith((".", "_")) for part in name[len(root):].split("/")):
            yield name


def exists(spark: SparkSession, path: str) -> bool:
    fs, top = _file_system(spark, path)
    return fs.exists(top)


def load_raw(
    spark: SparkSession, folder: str, schema: str | T.StructType | None = None, pick: str = "all", json_array: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """Raw table of a folder, partitioned or not. ``pick="first"`` takes the first readable file by name.

    ``"all"`` hands the folder to the reader; files of several formats in it are an error. Suffixes match
    without case. Raises FileNotFoundError if there is no readable file.
    """
    formats, first = set(), None
    for name in data_files(spark, folder):
        suffix = name.rsplit(".", 1)[-1].lower()
        if suffix in READERS:
            formats.add(suffix)
            first = name if first is None else min(first, name)
    if first is None:
        raise FileNotFoundError(f"no readable table in {folder}")
    if pick == "all" and len(formats) > 1:
        raise ValueError(f"{folder} holds several formats: {', '.join(sorted(formats))}")
    path, suffix = (folder, formats.pop()) if pick == "all" else (first, first.rsplit(".", 1)[-1].lower())
    kind = READERS[suffix]
    if kind == "csv":
        return read_csv(spark, path, schema, multi_line=multi_line)
    if kind == "json":
        return read_json(spark, path, schema, array=json_array and suffix != "jsonl")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return nulls_for_nan(reader.parquet(path))


def read_or_empty(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet") -> DataFrame:
    """The table at the path, partitioned or not, or an empty one with the declared schema if no file is there."""
    if next(data_files(spark, path), None) is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(path)


def with_row_id(df: DataFrame, key_columns: Sequence[str], out: str = "row_id") -> DataFrame:
    """A row key derived from the data (not from file order), stable under repartitioning."""
    return df.withColumn(out, F.xxhash64(*key_columns))
