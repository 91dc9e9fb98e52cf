"""Ranks, quantile bins, splits, folds and scaling."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridsieve.functions.ranking import average_ranks
from gridsieve.operators import split
from gridsieve.queries.common import hash32_sql, query, r, table


@query("e3_global_rank", """
SELECT o_totalprice, min(k) AS min_rank, count(*) AS n
FROM (SELECT o_totalprice, rank() OVER (ORDER BY o_totalprice) AS k FROM orders) GROUP BY 1
""")
def e3(spark, d):
    return average_ranks(table(spark, d, "orders"), "o_totalprice").select("o_totalprice", "min_rank", "n")


@query("e4_qcut", """
WITH q AS (SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM events)
SELECT event_id, len([x FOR x IN list_distinct(e) IF x < value])::INT AS bin FROM events, q
""")
def e4(spark, d):
    return split.add_quantile_bin(table(spark, d, "events"), "value").select("event_id", "bin")


@query("e4_qcut_duplicate_edges", """
WITH q AS (SELECT quantile_cont(l_tax, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS e FROM lineitem),
u AS (SELECT list_sort(list_distinct(e)) AS e FROM q)
SELECT len([x FOR x IN e[2:len(e) - 1] IF x < l_tax])::INT AS bin, count(*) AS n_rows FROM lineitem, u GROUP BY 1
""")
def e4_dup(spark, d):
    binned = split.add_quantile_bin(table(spark, d, "lineitem").select("l_tax"), "l_tax")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"))


@query("e5_average_rank", """
SELECT l_returnflag, l_quantity, count(*) AS n, avg(k)::DOUBLE AS avg_rank FROM (
  SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS k FROM lineitem)
GROUP BY 1, 2
""")
def e5(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    return average_ranks(li, "l_quantity", ["l_returnflag"]).select("l_returnflag", "l_quantity", "n", "avg_rank")


@query("e6_stratified_split", f"""
SELECT o_orderkey, o_orderpriority, CASE WHEN k <= round(n * 0.15::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hash32_sql("o_orderkey", 42)}, o_orderkey::VARCHAR) AS k,
         count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
""")
def e6(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return split.stratified_split(o, F.col("o_orderkey"), "o_orderpriority")


@query("e7_split", f"""
SELECT event_id, CASE WHEN {hash32_sql("event_id", 12)} / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split FROM events
""")
def e7(spark, d):
    return split.hash_split(table(spark, d, "events").select("event_id"), F.col("event_id"), 0.2, seed=12)


@query("e8_kfold", f"SELECT o_orderkey, ({hash32_sql('o_orderkey', 42)} % 5)::INT AS fold FROM orders")
def e8(spark, d):
    return split.kfold(table(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey"))


@query("e8_kfold_balanced", f"""
SELECT event_id, ((row_number() OVER (ORDER BY {hash32_sql("event_id", 42)}, event_id::VARCHAR) - 1) % 5)::INT AS fold FROM events
""")
def e8_balanced(spark, d):
    return split.kfold(table(spark, d, "events").select("event_id"), F.col("event_id"), balanced=True)


@query("e9_group_kfold", """
WITH RECURSIVE g AS (SELECT n, row_number() OVER (ORDER BY n DESC, user_id) AS rn FROM (
    SELECT user_id, count(*) AS n FROM events GROUP BY 1)),
w AS (SELECT 0::BIGINT AS rn, [0, 0, 0, 0, 0]::BIGINT[] AS loads, [0, 0, 0, 0, 0]::BIGINT[] AS groups
  UNION ALL
  SELECT g.rn, [loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN g.n ELSE 0 END FOR i IN [1, 2, 3, 4, 5]],
         [groups[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN 1 ELSE 0 END FOR i IN [1, 2, 3, 4, 5]]
  FROM w JOIN g ON g.rn = w.rn + 1),
f AS (SELECT loads, groups FROM w ORDER BY rn DESC LIMIT 1)
SELECT (i - 1)::INT AS fold, loads[i] AS n_rows, groups[i] AS n_groups FROM f, unnest([1, 2, 3, 4, 5]) t(i)
""")
def e9(spark, d):
    folds = split.group_kfold(table(spark, d, "events").select("user_id"), "user_id", 5)
    return folds.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("n_groups")
    )


@query("e10_leave_one_group_out", f"""
SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY h, p_brand) - 1 AS fold FROM (
  SELECT p_partkey, p_brand, {hash32_sql("p_brand", 42)} AS h FROM part)
""")
def e10(spark, d):
    return split.group_kfold(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", None)


@query("e12_minmax", """
SELECT event_id, round((value - lo) / (hi - lo), 9) AS scaled FROM events, (SELECT min(value) lo, max(value) hi FROM events)
""")
def e12(spark, d):
    out = split.minmax(table(spark, d, "events").select("event_id", "value"), "value", "scaled")
    return out.select("event_id", r("scaled", 9).alias("scaled"))


@query("e13_learning_subsets", f"""
WITH k AS (SELECT row_number() OVER (ORDER BY {hash32_sql("o_orderkey", 42)}, o_orderkey::VARCHAR) AS k, count(*) OVER () AS n FROM orders)
SELECT step::INT AS step, count(*) AS n_rows FROM (
  SELECT (SELECT min(i) FROM range(8) t(i) WHERE k <= floor(n * (0.1 + i * 0.9 / 7)::DOUBLE + 1e-9)) AS step FROM k) GROUP BY 1
""")
def e13(spark, d):
    fractions = [0.1 + i * 0.9 / 7 for i in range(8)]
    steps = split.learning_subsets(table(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey"), fractions)
    return steps.groupBy("step").agg(F.count(F.lit(1)).alias("n_rows"))


@query("e14_k_smallest", """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k
  FROM events) WHERE k <= 5
""")
def e14(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    k = F.row_number().over(W.partitionBy("user_id").orderBy("value", "event_id"))
    return e.withColumn("k", k).filter(F.col("k") <= 5).drop("k")
