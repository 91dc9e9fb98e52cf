"""Vector columns as bytes: validity, classes of equal vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.common import NULL_ID, column, staged


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id (null as NULL_ID) and vec (little-endian doubles) of vectors that are not null or zero and whose
    components are all finite numbers."""
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            ids, vectors = [], []
            for key, v in zip(column(batch, "vec_id").to_pylist(), column(batch, "v").to_pylist(), strict=True):
                if v and None not in v:
                    x = np.array(v, np.float64) + 0.0  # no negative zero
                    if np.isfinite(x).all() and x.any():
                        ids.append(key)
                        vectors.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], ["vec_id", "vec"])

    return rows.mapInArrow(run, "vec_id long, vec binary")


def classes(vectors: DataFrame) -> DataFrame:
    """node (a number of its own, ascending with the smallest vec_id), n (rows) and vec of each distinct vector, written.

    Ids may be null or repeated, so they do not name a vector. Partial counts before the shuffle.
    """
    distinct = vectors.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    ordered = distinct.repartitionByRange("least", "vec").sortWithinPartitions("least", "vec")
    return staged(ordered.select(F.monotonically_increasing_id().alias("node"), "n", "vec"), "classes")


def matrix(values: pa.Array | list, dtype=np.float64) -> np.ndarray:
    values = values.to_pylist() if isinstance(values, pa.Array) else values
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1) if len(values) else np.zeros((0, 0), dtype)
