"""Nearest-neighbour distances and the applicability domain over the embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsieve.operators import neighbors
from gridsieve.queries.common import hash32_sql, query, r, table

# Labels below 5 play the training rows, the others the rows to be judged; self-distances take all rows.
VEC_SQL = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
KNN_SQL = """
knn AS (SELECT vec_id, avg(d) AS dist FROM (
  SELECT q.vec_id, list_distance(q.e, x.e) AS d,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, x.e)) AS k
  FROM v q JOIN v x ON q.label >= 5 AND x.label < 5) WHERE k <= 5 GROUP BY 1)
"""
ALL_SQL = """
self AS (SELECT vec_id, avg(d) AS dist FROM (
  SELECT q.vec_id, list_distance(q.e, x.e) AS d,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, x.e)) AS k
  FROM v q JOIN v x ON q.vec_id <> x.vec_id) WHERE k <= 5 GROUP BY 1)
"""
SELF_SQL = """
self AS (SELECT vec_id, avg(d) AS dist FROM (
  SELECT q.vec_id, list_distance(q.e, x.e) AS d,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, x.e)) AS k
  FROM v q JOIN v x ON q.label < 5 AND x.label < 5 AND q.vec_id <> x.vec_id) WHERE k <= 5 GROUP BY 1)
"""


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def roles(spark, d):
    v = vectors(spark, d)
    return v.filter("label < 5"), v.filter("label >= 5")


@query("c17_knn_mean_distance", f"WITH {VEC_SQL}, {KNN_SQL} SELECT vec_id, round(dist, 6) AS ad_score FROM knn")
def c17(spark, d):
    train, queries = roles(spark, d)
    return neighbors.knn_mean_distance(queries, train, "e", 5, "ad_score").select("vec_id", r("ad_score").alias("ad_score"))


@query("c18_self_knn", f"WITH {VEC_SQL}, {ALL_SQL} SELECT vec_id, round(dist, 6) AS ad_score FROM self")
def c18(spark, d):
    return neighbors.knn_mean_distance(vectors(spark, d), None, "e", 5, "ad_score").select("vec_id", r("ad_score").alias("ad_score"))


@query("c19_novelty", f"""
WITH {VEC_SQL},
n AS (SELECT vec_id, avg(d) AS raw FROM (
  SELECT q.vec_id, list_distance(q.e, s.e) AS d,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, s.e)) AS k
  FROM v q JOIN v s ON q.label >= 5 AND s.label < 5) WHERE k <= 5 GROUP BY 1)
SELECT vec_id, round((raw - (SELECT min(raw) FROM n)) / ((SELECT max(raw) FROM n) - (SELECT min(raw) FROM n)), 6)
  AS novelty_score FROM n
""")
def c19(spark, d):
    train, queries = roles(spark, d)
    out = neighbors.novelty_score(queries, train, "e", 5)
    return out.select("vec_id", r("novelty_score").alias("novelty_score"))


@query("d19_ad_threshold", f"""
WITH {VEC_SQL}, {ALL_SQL}
SELECT round(avg(dist), 6) AS ad_mean, round(stddev_pop(dist), 6) AS ad_std, round(avg(dist) + stddev_pop(dist), 6)
  AS ad_threshold FROM self
""")
def d19(spark, d):
    t = neighbors.domain_threshold(neighbors.knn_mean_distance(vectors(spark, d), None, "e", 5, "dist"), "dist", 1.0)
    return t.select(*[r(c).alias(c) for c in t.columns])


@query("i14_ad_labels", f"""
WITH {VEC_SQL}, {SELF_SQL}, {KNN_SQL}, t AS (SELECT avg(dist) + stddev_pop(dist) AS th FROM self)
SELECT vec_id, round(dist, 6) AS ad_score, dist <= th AS within_ad,
       CASE WHEN dist <= th THEN 'within_AD' ELSE 'outside_AD' END AS ad_label FROM knn, t
""")
def i14(spark, d):
    train, queries = roles(spark, d)
    labelled, _ = neighbors.applicability_domain(train, queries, "e", 5)
    return labelled.select("vec_id", r("ad_score").alias("ad_score"), "within_ad", "ad_label")
