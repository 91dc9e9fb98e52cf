"""Scans and sinks as round trips: a table is written in each format and read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsieve.operators import encode, learn
from gridsieve.queries.common import query, r, table
from gridsieve.session import new_path
from gridsieve.sources import sinks, tables

ORDERS_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def orders(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )


@query("a1_folder_scan", ORDERS_SQL)
def a1(spark, d):
    path = sinks.write_table(orders(spark, d), new_path(spark, "a1"), fmt="csv")
    return tables.load_raw(spark, path, ORDERS_SCHEMA)


@query("a2_json_lines_scan", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def a2(spark, d):
    path = sinks.write_table(table(spark, d, "documents"), new_path(spark, "a2"), fmt="json")
    return tables.read_json(spark, path, "doc_id long, text string, lang string, source string, n_chars long")


@query("a3_csv_scan_nan_to_null", """
SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events
""")
def a3(spark, d):
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    e = table(spark, d, "events").select("event_id", "user_id", value.alias("value"))
    path = sinks.write_table(e, new_path(spark, "a3"), fmt="csv")
    return tables.read_csv(spark, path, "event_id long, user_id long, value double")


@query("a4_csv_with_row_id", "SELECT p_partkey AS row_id, p_brand, p_retailprice FROM part")
def a4(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), "p_brand", "p_retailprice")
    path = sinks.write_table(part, new_path(spark, "a4"), fmt="csv")
    return tables.read_csv(spark, path, "row_id long, p_brand string, p_retailprice double")


@query("a5_headerless_column", "SELECT l_tax AS w FROM lineitem")
def a5(spark, d):
    path = new_path(spark, "a5")
    table(spark, d, "lineitem").select("l_tax").write.csv(path, header=False)
    return tables.read_column(spark, path, "w")


@query("a6a12_table_sink", ORDERS_SQL + " WHERE o_orderstatus = 'F'")
def a6(spark, d):
    kept = orders(spark, d).filter("o_orderstatus = 'F'")
    path = sinks.write_table(kept, new_path(spark, "a6"), partition_by=["o_orderpriority"])
    return spark.read.parquet(path).select(*kept.columns)


@query("a7_record_sink", "SELECT count(*) AS n_rows, max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders")
def a7(spark, d):
    summary = table(spark, d, "orders").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo")
    )
    path = sinks.write_record(summary, new_path(spark, "a7"))
    return tables.read_json(spark, path, "n_rows long, hi double, lo double")


@query("a9_widened_table", "SELECT c_custkey, c_acctbal, c_acctbal > 0 AS solvent FROM customer")
def a9(spark, d):
    """The table is widened under its own name: a second version made from the first."""
    path = new_path(spark, "a9")
    sinks.write_version(table(spark, d, "customer").select("c_custkey", "c_acctbal"), path)
    sinks.write_version(sinks.read_version(spark, path).withColumn("solvent", F.col("c_acctbal") > 0), path)
    return sinks.read_version(spark, path)


@query("a10_saved_state", """
WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS q, quantile_cont(l_discount, 0.5) AS disc FROM lineitem)
SELECT round(q, 6) AS l_quantity, round(disc, 6) AS l_discount FROM m
""")
def a10(spark, d):
    cols = ["l_quantity", "l_discount"]
    fitted = encode.fit_medians(table(spark, d, "lineitem").select(*cols), cols)
    saved = sinks.save_state(fitted, new_path(spark, "a10"))
    return saved.select(*[r(c).alias(c) for c in cols])


@query("a10_saved_model", """
WITH s AS (SELECT count(*) AS n, avg(p_size) AS mx, avg(p_retailprice) AS my, sum(p_size * p_retailprice) AS sxy,
                  sum(p_size * p_size) AS sxx FROM part),
f AS (SELECT (sxy - n * mx * my) / (sxx - n * mx * mx + 1) AS b, mx, my FROM s)
SELECT p_partkey, round(my - b * mx + b * p_size, 4) AS prediction FROM part, f
""")
def a10_model(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), "p_retailprice")
    path = sinks.save_model(learn.fit_ridge(part, ["x"], "p_retailprice"), new_path(spark, "a10m"))
    scored = sinks.load_model(path).transform(part)
    return scored.select("p_partkey", r("prediction", 4).alias("prediction"))


@query("a13_result_or_empty", "SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#4'")
def a13(spark, d):
    schema = "p_partkey long, p_brand string"
    missing = tables.read_or_empty(spark, new_path(spark, "absent"), schema)
    found = tables.read_or_empty(spark, f"{d}/part.parquet", schema)
    return found.filter("p_brand = 'Brand#4'").unionByName(missing)


PARTITIONED_SQL = "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders"


@query("a1_partitioned_folder", PARTITIONED_SQL)
def a1_partitioned(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = sinks.write_table(o, new_path(spark, "a1p"), partition_by=["o_orderpriority"])
    return tables.load_raw(spark, path).select(*o.columns)


@query("a13_partitioned_or_empty", PARTITIONED_SQL)
def a13_partitioned(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = sinks.write_table(o, new_path(spark, "a13p"), partition_by=["o_orderpriority"])
    return tables.read_or_empty(spark, path, "o_orderkey long, o_totalprice double, o_orderpriority string")


@query("a12_text_export", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def a12_text(spark, d):
    path = sinks.write_table(table(spark, d, "documents"), new_path(spark, "a12"), fmt="csv")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return tables.load_raw(spark, path, schema, multi_line=True)


@query("a2_json_array_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def a2_array(spark, d):
    """Files of one array each, with a byte-order mark."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    line = F.to_json(F.struct(*c.columns))
    # one file per thousand keys
    files = c.select(F.floor(F.col("c_custkey") / 1000).alias("part"), line.alias("line")).groupBy("part").agg(F.collect_list("line").alias("lines"))
    array = F.concat(F.lit("\ufeff["), F.array_join("lines", ","), F.lit("]"))
    path = new_path(spark, "a2a")
    files.select(array.alias("value"), "part").repartition("part").write.partitionBy("part").text(path)
    return tables.read_json(spark, path, "c_custkey long, c_name string, c_acctbal double", array=True).select(*c.columns)
