"""Filters, deduplication, pruning profiles, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsieve.functions.ranking import exact_quantiles
from gridsieve.functions.text import contains_ci
from gridsieve.operators import curate
from gridsieve.operators.lookup import dim_lookup
from gridsieve.queries.common import hash32_sql, query, r, table
from gridsieve.sources import dims

LINE_TIEBREAK = (
    "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)
LINE_TIEBREAK_SQL = ", ".join(LINE_TIEBREAK)

# Illustrative type properties keyed like the part types; two types are absent on purpose.
TYPE_PROPS = [("promo", 3.2, 1), ("large", 2.4, 2), ("small", 1.7, 3), ("medium", 2.9, 4), ("unknown", 3.0, 0)]
TYPE_PROPS_SQL = (
    "tp(key, weight, tier) AS (VALUES ('promo', 3.2::DOUBLE, 1), ('large', 2.4, 2), ('small', 1.7, 3), "
    "('medium', 2.9, 4), ('unknown', 3.0, 0))"
)


def type_props(spark):
    return dims.dim(spark, TYPE_PROPS, "key string, weight double, tier int")


@query("m0_curated_leaderboard", f"""
WITH {TYPE_PROPS_SQL},
kept AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_extendedprice DESC NULLS LAST, {LINE_TIEBREAK_SQL}) AS rn
  FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_returnflag IS DISTINCT FROM 'A'
    AND l_quantity IS NOT NULL AND l_quantity > 0),
enriched AS (
  SELECT p_type, coalesce(tp.weight, u.weight) AS weight, ln(1 + l_extendedprice) AS y
  FROM kept JOIN part ON l_partkey = p_partkey
  LEFT JOIN tp ON tp.key = lower(trim(p_type))
  JOIN tp u ON u.key = 'unknown'
  WHERE rn = 1)
SELECT p_type, weight, count(*) AS n_rows, round(quantile_cont(y, 0.5), 6) AS median_log,
       round(quantile_cont(y, 0.9), 6) AS p90_log
FROM enriched GROUP BY p_type, weight HAVING count(*) >= 5
ORDER BY median_log DESC, p_type LIMIT 10
""")
def m0_curated_leaderboard(spark, d):
    li = table(spark, d, "lineitem")
    li = curate.at_least(li, "l_shipdate", F.lit("1996-01-01").cast("timestamp_ntz"))
    li = curate.positive(curate.not_equal_keep_null(li, "l_returnflag", "A"), "l_quantity")
    best = curate.keep_best(li, ["l_orderkey", "l_linenumber"], "l_extendedprice", LINE_TIEBREAK)
    part = table(spark, d, "part").select("p_partkey", "p_type")
    joined = best.select("l_partkey", "l_extendedprice").join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = dim_lookup(joined, "p_type", type_props(spark), ["weight"]).withColumn("y", F.log1p("l_extendedprice"))
    per_type = exact_quantiles(rows, "y", [0.5, 0.9], ["p_type", "weight"]).filter(F.col("n") >= 5)
    out = per_type.select(
        "p_type", "weight", F.col("n").alias("n_rows"),
        r(F.col("quantiles")[0]).alias("median_log"), r(F.col("quantiles")[1]).alias("p90_log"),
    )
    return curate.top_rows(out, [F.desc("median_log"), F.asc("p_type")], 10)


@query("b1b2b3_curation_filters", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus IS DISTINCT FROM 'P' AND o_totalprice > 0
""")
def b1b2b3(spark, d):
    o = table(spark, d, "orders")
    o = curate.at_least(o, "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"))
    o = curate.positive(curate.not_equal_keep_null(o, "o_orderstatus", "P"), "o_totalprice")
    return o.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("b2_not_equal_keeps_null", """
SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS DISTINCT FROM 0
""")
def b2_null(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return curate.not_equal_keep_null(joined, "quality", 0).select("doc_id", "quality")


@query("d32_drop_lineage", """
SELECT CASE WHEN NOT coalesce(o_orderdate >= TIMESTAMP '1998-01-01', FALSE) THEN 'old'
            WHEN NOT (o_orderstatus IS DISTINCT FROM 'P') THEN 'pending'
            WHEN NOT coalesce(o_totalprice > 20000, FALSE) THEN 'small' ELSE 'kept' END AS drop_reason,
       count(*) AS n_rows
FROM orders GROUP BY 1
""")
def d32(spark, d):
    steps = [
        ("old", F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")),
        ("pending", ~F.col("o_orderstatus").eqNullSafe(F.lit("P"))),
        ("small", F.col("o_totalprice") > 20000),
    ]
    return curate.drop_lineage(curate.drop_reasons(table(spark, d, "orders"), steps))


PROFILE_COLUMNS = ("doc_id", "lang", "source", "n_chars", "quality", "toxic")
PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) "
    f"AS null_share, (min({c}) IS NOT DISTINCT FROM max({c})) AS is_constant FROM j"
    for c in PROFILE_COLUMNS
)


def labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id", "left")


@query("b4b5_column_profile", f"""
WITH j AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
{PROFILE_SQL}
""")
def b4b5(spark, d):
    prof = curate.column_profile(labelled(spark, d))
    return prof.select("column", "n_rows", r("null_share").alias("null_share"), "is_constant")


@query("b4b5_prune_columns", """
SELECT d.doc_id, d.lang, d.source, d.n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def b4b5_prune(spark, d):
    rows = labelled(spark, d).withColumn("batch", F.lit("a"))
    return curate.prune_columns(rows, max_null_share=0.5)


@query("b11_substring_share", """
SELECT p_brand, count(*) AS n_rows, round(avg(CASE WHEN contains(lower(p_name), 'ring') THEN 1.0 ELSE 0.0 END), 6)
       AS share_ring
FROM part GROUP BY p_brand
""")
def b11(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n_rows"), r(F.avg(contains_ci("p_name", "RING").cast("double"))).alias("share_ring")
    )


@query("b12_multi_filter_topk", """
SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('O', 'F')
ORDER BY o_totalprice DESC, o_orderkey LIMIT 30
""")
def b12(spark, d):
    lists = {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": ["O", "F"], "o_custkey": []}
    kept = curate.multi_filter(table(spark, d, "orders"), lists)
    cols = ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]
    return curate.top_rows(kept.select(*cols), [F.desc("o_totalprice"), F.asc("o_orderkey")], 30)


@query("b13_cap_by_scalar_max", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_extendedprice <= 0.5 * (SELECT max(l_extendedprice) FROM lineitem WHERE l_quantity <= 5)
""")
def b13(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return curate.cap_by_reference_max(li, "l_extendedprice", li.filter("l_quantity <= 5"), "l_extendedprice", 0.5)


@query("b14_group_min_count", """
SELECT user_id, count(*) AS n_rows FROM events GROUP BY user_id HAVING count(*) >= 65
""")
def b14(spark, d):
    return curate.min_group_count(table(spark, d, "events"), ["user_id"], 65)


@query("b15_duplicate_keys", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1
""")
def b15(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return curate.duplicated_keys(li, ["l_orderkey", "l_linenumber"])


@query("b16_complete_pairs", """
SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL
""")
def b16(spark, d):
    return labelled(spark, d).dropna(subset=["quality", "toxic"]).select("doc_id", "n_chars", "quality", "toxic")


@query("b18_point_lookup_best", """
SELECT p_partkey, p_brand, p_type, p_retailprice FROM part WHERE lower(p_brand) = 'brand#4' AND lower(p_type) = 'promo'
ORDER BY p_retailprice DESC, p_partkey LIMIT 1
""")
def b18(spark, d):
    hit = table(spark, d, "part").filter((F.lower("p_brand") == "brand#4") & (F.lower("p_type") == "promo"))
    cols = ["p_partkey", "p_brand", "p_type", "p_retailprice"]
    return curate.top_rows(hit.select(*cols), [F.desc("p_retailprice"), F.asc("p_partkey")], 1)


@query("b20_hash_sample", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey::VARCHAR || '-7'), o_orderkey::VARCHAR LIMIT 500
""")
def b20(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return curate.hash_sample(o, F.col("o_orderkey"), 500, seed=7)


@query("e1_dedup_keep_best", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
     ORDER BY l_extendedprice DESC NULLS LAST, {LINE_TIEBREAK_SQL}) AS rn FROM lineitem) WHERE rn = 1
""")
def e1(spark, d):
    best = curate.keep_best(
        table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_extendedprice", LINE_TIEBREAK
    )
    return best.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query("e1_dedup_null_keys_and_scores", """
SELECT quality, toxic, doc_id, n_chars FROM (
  SELECT d.doc_id, d.n_chars, l.quality, l.toxic, row_number() OVER (PARTITION BY l.quality, l.toxic
     ORDER BY d.n_chars DESC NULLS LAST, d.doc_id) AS rn
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE rn = 1
""")
def e1_null(spark, d):
    best = curate.keep_best(labelled(spark, d), ["quality", "toxic"], "n_chars", ["doc_id"])
    return best.select("quality", "toxic", "doc_id", "n_chars")


@query("e2_best_per_pair", """
SELECT p_brand, p_type, p_partkey, p_retailprice FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS rn
  FROM part) WHERE rn = 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 100
""")
def e2(spark, d):
    best = curate.keep_best(table(spark, d, "part"), ["p_brand", "p_type"], "p_retailprice", ["p_partkey"])
    cols = ["p_brand", "p_type", "p_partkey", "p_retailprice"]
    return curate.top_rows(best.select(*cols), [F.desc("p_retailprice"), F.asc("p_partkey")], 100)


@query("e3_rank_after_topk", """
SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey, o_totalprice
FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50
""")
def e3(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return curate.top_rows(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 50, rank="rank")


@query("f1_sort_by_key", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
def f1(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey")


@query("f2_head_after_sort", """
SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20
""")
def f2(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return curate.top_rows(c, [F.desc("c_acctbal"), F.asc("c_custkey")], 20)


@query("f3_nlargest", """
SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 10
""")
def f3(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return curate.top_rows(e, [F.col("value").desc_nulls_last(), F.asc("event_id")], 10)


@query("f4_top_categories", """
SELECT user_id, count(*) AS n_rows FROM events WHERE user_id IS NOT NULL GROUP BY user_id
ORDER BY n_rows DESC, user_id LIMIT 10
""")
def f4(spark, d):
    return curate.top_categories(table(spark, d, "events"), "user_id", 10)


@query("f6_argmax_row", """
SELECT event_type, max(value) AS value, arg_max(event_id, (value, -event_id)) AS event_id FROM events GROUP BY event_type
""")
def f6(spark, d):
    e = table(spark, d, "events").select("event_type", "value", "event_id")
    best = F.max_by(F.struct("event_id", "value"), F.struct("value", (-F.col("event_id")).alias("t")))
    return e.groupBy("event_type").agg(best.alias("b")).select("event_type", "b.value", "b.event_id")


def large_orders(spark, d):
    return table(spark, d, "orders").filter("o_totalprice > 400000").select("o_custkey")


@query("g1_difference", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
""")
def g1(spark, d):
    orders = large_orders(spark, d).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").subtract(orders)


@query("g2_intersection", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def g2(spark, d):
    orders = large_orders(spark, d).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").intersect(orders)


@query("c11_anti_join", """
SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
""")
def c11(spark, d):
    o = large_orders(spark, d)
    c = table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_mktsegment")


@query("c12_semi_join", """
SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
""")
def c12(spark, d):
    o = large_orders(spark, d)
    c = table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_mktsegment")


@query("c13_topn_semi_join", """
SELECT p_partkey, p_brand FROM part WHERE p_brand IN (
  SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 5)
""")
def c13(spark, d):
    return curate.in_top_categories(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 5)
