"""Registry of queries over the given tables, each with an equivalent SQL text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded double, so that the order of summation does not show."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table that may lie in one small file, dealt to several tasks per core, ahead of costly work per row."""
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, key)


def line_key() -> Column:
    """A key of a line item. Order and line number alone are not unique; the price in cents settles the rest."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents.cast("string"))


# Observed and predicted value per line item, used wherever an operator needs (y, prediction) rows.
PAIRS_SQL = """
pairs AS (
  SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS row_key,
         p_brand, p_type, l_quantity, l_extendedprice,
         ln(1 + l_extendedprice) AS y,
         ln(1 + l_quantity * p_retailprice) AS p
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        line_key().alias("row_key"),
        "p_brand", "p_type", "l_quantity", "l_extendedprice",
        F.log1p("l_extendedprice").alias("y"),
        F.log1p(F.col("l_quantity") * F.col("p_retailprice")).alias("p"),
    )


def hash32_sql(key: str, seed: int | str = 42) -> str:
    return f"('0x' || substr(md5(({key})::VARCHAR || '-{seed}'), 1, 8))::BIGINT"


def draw_sql(key: str, member: str, seed: int = 42) -> str:
    """The bootstrap draw of a member: eight hex digits of the digest of its block of four."""
    digest = f"md5(({key})::VARCHAR || '#' || ({member} // 4)::VARCHAR || '-{seed}')"
    return f"('0x' || substr({digest}, ({member} % 4) * 8 + 1, 8))::BIGINT"
