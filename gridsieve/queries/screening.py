"""Candidate generation, screening, scoring, schema shaping, and the streaming twin of scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsieve.functions.vectors import euclidean, feature_vector
from gridsieve.operators import candidates as C
from gridsieve.operators import encode, learn, metrics, neighbors, ridge, roles
from gridsieve.operators.lookup import dim_lookup
from gridsieve.queries.aggregates import N_MEMBERS, POISSON_SQL, QHAT_SQL, calibration_rows, rounded
from gridsieve.queries.common import PAIRS_SQL, draw_sql, hash32_sql, query, r, spread, table
from gridsieve.queries.curation import TYPE_PROPS_SQL, type_props
from gridsieve.queries.models import BOOT_FIT_SQL, ROWS_SQL, members, ridge1_sql, rows
from gridsieve.session import new_path
from gridsieve.sources.sinks import load_state, save_state
from gridsieve.streaming.scoring import file_stream, score_available

GRID_SQL = """
grid AS (SELECT * FROM (SELECT DISTINCT p_brand AS host FROM part), (SELECT DISTINCT p_type AS partner FROM part),
  (SELECT DISTINCT l_tax AS amount FROM lineitem), (SELECT DISTINCT o_orderpriority AS source FROM orders),
  (SELECT DISTINCT c_mktsegment AS segment FROM customer))
"""


def grid(spark, d):
    columns = {
        "host": ("part", "p_brand"), "partner": ("part", "p_type"), "amount": ("lineitem", "l_tax"),
        "source": ("orders", "o_orderpriority"), "segment": ("customer", "c_mktsegment"),
    }
    return C.grid_of_values(spark, {name: table(spark, d, t).select(c) for name, (t, c) in columns.items()})


@query("c15_cross_grid", f"WITH {GRID_SQL} SELECT host, partner, amount, source, segment FROM grid")
def c15(spark, d):
    return grid(spark, d).drop("row_id")


PARTNERS = {"PROMO": ["tio2", "zno", "cds"], "LARGE": ["wo3", "tio2"], "SMALL": ["bivo4", "g-c3n4", "zno", "fe2o3"]}


@query("c16_partner_pick", f"""
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN (['tio2', 'zno', 'cds'])[{hash32_sql("p_partkey", 42)} % 3 + 1]
  WHEN 'LARGE' THEN (['wo3', 'tio2'])[{hash32_sql("p_partkey", 42)} % 2 + 1]
  WHEN 'SMALL' THEN (['bivo4', 'g-c3n4', 'zno', 'fe2o3'])[{hash32_sql("p_partkey", 42)} % 4 + 1] ELSE 'none' END AS partner
FROM part
""")
def c16(spark, d):
    return table(spark, d, "part").select("p_partkey", C.pick_partner("p_type", PARTNERS, F.col("p_partkey")).alias("partner"))


FLOW_SQL = f"""
tr AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS x1, p_retailprice / 1000 AS x2, ln(1 + p_retailprice * p_size) AS y FROM part),
dr AS (SELECT x1, x2, y, b.m AS member, {draw_sql("p_partkey", "b.m")} / 4294967296.0 AS u FROM tr, range({N_MEMBERS}) b(m)),
bw AS (SELECT member, x1, x2, y, {POISSON_SQL} AS w FROM dr),
m AS (SELECT member, sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2, sum(w * y) / sum(w) AS my FROM bw GROUP BY 1),
s AS (SELECT member, m1, m2, my, sum(w * (x1 - m1) * (x1 - m1)) + 1 AS a, sum(w * (x1 - m1) * (x2 - m2)) AS b,
        sum(w * (x2 - m2) * (x2 - m2)) + 1 AS e, sum(w * (x1 - m1) * (y - my)) AS p, sum(w * (x2 - m2) * (y - my)) AS q
      FROM bw JOIN m USING (member) GROUP BY 1, 2, 3, 4),
fits AS (SELECT member, m1, m2, my, (p * e - b * q) / (a * e - b * b) AS b1, (a * q - b * p) / (a * e - b * b) AS b2 FROM s),
{GRID_SQL},
hd AS (SELECT p_brand AS host, avg(p_size) / 10 AS x1 FROM part GROUP BY 1),
pd AS (SELECT p_type AS partner, avg(p_retailprice) / 1000 AS px FROM part GROUP BY 1),
ca AS (SELECT grid.*, x1, px * (1 + amount) AS x2 FROM grid JOIN hd USING (host) JOIN pd USING (partner)),
v AS (SELECT DISTINCT x1, x2 FROM ca),
iv AS (SELECT v.x1, v.x2, quantile_cont(my + b1 * (v.x1 - m1) + b2 * (v.x2 - m2), 0.05) AS lo,
         quantile_cont(my + b1 * (v.x1 - m1) + b2 * (v.x2 - m2), 0.5) AS med,
         quantile_cont(my + b1 * (v.x1 - m1) + b2 * (v.x2 - m2), 0.95) AS hi FROM v, fits GROUP BY 1, 2),
nn AS (SELECT x1, x2, avg(d) AS raw FROM (
  SELECT v.x1, v.x2, sqrt((v.x1 - tr.x1) * (v.x1 - tr.x1) + (v.x2 - tr.x2) * (v.x2 - tr.x2)) AS d,
         row_number() OVER (PARTITION BY v.x1, v.x2 ORDER BY (v.x1 - tr.x1) * (v.x1 - tr.x1) + (v.x2 - tr.x2) * (v.x2 - tr.x2)) AS k
  FROM v, tr) WHERE k <= 5 GROUP BY 1, 2),
sc AS (SELECT ca.*, lo, med, hi, med + (hi - lo) / 2 AS ucb,
         (raw - (SELECT min(raw) FROM nn)) / ((SELECT max(raw) FROM nn) - (SELECT min(raw) FROM nn)) AS novelty
       FROM ca JOIN iv USING (x1, x2) JOIN nn USING (x1, x2)),
fl AS (SELECT * FROM sc WHERE exp(med) - 1 <= 3 * (SELECT max(exp(y) - 1) FROM tr))
"""


def screening_flow(spark, d):
    """The whole flow: fit an ensemble, generate candidates, score, novelty, cap, upper bound."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    train = part.select(
        "p_partkey", (F.col("p_size") / 10.0).alias("x1"), (F.col("p_retailprice") / 1000).alias("x2"),
        F.log1p(F.col("p_retailprice") * F.col("p_size")).alias("y"), (F.col("p_retailprice") * F.col("p_size")).alias("target"),
    )
    hosts = part.groupBy(F.col("p_brand").alias("host")).agg((F.avg("p_size") / 10).alias("x1"))
    partners = part.groupBy(F.col("p_type").alias("partner")).agg((F.avg("p_retailprice") / 1000).alias("px"))
    hosts, partners = (save_state(x, new_path(spark, "dims")) for x in (hosts, partners))
    cand = grid(spark, d).join(hosts, "host").join(partners, "partner").withColumn("x2", F.col("px") * (1 + F.col("amount"))).drop("px")
    fits = learn.bootstrap_ridge(train, ["x1", "x2"], "y", F.col("p_partkey"), N_MEMBERS)
    scored = learn.ensemble_interval(cand, fits).withColumn("vec", feature_vector(["x1", "x2"]))
    scored = save_state(scored, new_path(spark, "scored-candidates"))
    scored = neighbors.novelty_score(scored, train.select(feature_vector(["x1", "x2"]).alias("vec")), "vec", 5)
    return C.screening_table(scored, "host", "partner", "amount", train, "target", cap_factor=3.0)


KEYS = ["host", "partner", "amount", "source", "segment"]


@query("i12_candidate_screening", f"""
WITH {FLOW_SQL}
SELECT host, partner, amount, source, segment, round(med, 6) AS pred_median_log, round(ucb, 6) AS ucb_log, round(novelty, 6) AS novelty_score,
       CASE WHEN (hi - lo) / med <= 0.3 THEN 'HIGH' WHEN (hi - lo) / med <= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM fl
""")
def i12(spark, d):
    out = screening_flow(spark, d)
    return rounded(out.select(*KEYS, "pred_median_log", "ucb_log", "novelty_score", "confidence"), keep=("amount",))


@query("i12_top_candidates", f"""
WITH {FLOW_SQL},
best AS (SELECT *, row_number() OVER (PARTITION BY host, partner ORDER BY round(ucb, 9) DESC, amount, source, segment) AS rn FROM fl)
SELECT host, partner, amount, source, segment, host || '/' || partner || ' (' || amount::VARCHAR || ' wt%)' AS composition,
       round(ucb, 6) AS ucb_log
FROM best WHERE rn = 1 ORDER BY round(ucb, 9) DESC, amount, source, segment, host, partner LIMIT 100
""")
def i12_top(spark, d):
    out = screening_flow(spark, d).withColumn("ucb_log", F.round("ucb_log", 9))
    best = C.best_candidates(out, ["host", "partner"], ["amount", "source", "segment", "host", "partner"], 100)
    return best.select(*KEYS, "composition", r("ucb_log").alias("ucb_log"))


@query("i13_conformal_rescore", f"""
WITH {FLOW_SQL}, {PAIRS_SQL}, {QHAT_SQL}
SELECT host, partner, amount, source, segment, round(med - q_hat, 5) AS pred_p05_log, round(med + q_hat, 5) AS ucb_log FROM fl, q
""")
def i13(spark, d):
    q = metrics.conformal_quantile(calibration_rows(spark, d), "y", "p", 0.10)
    out = C.conformal_rescore(screening_flow(spark, d), "pred_median_log", q)
    return rounded(out.select(*KEYS, "pred_p05_log", "ucb_log"), 5, keep=("amount",))


@query("i23_novelty_performance", f"""
WITH {FLOW_SQL}, t AS (SELECT *, round(ucb, 6) AS u, round(novelty, 6) AS nv FROM fl),
o AS (SELECT *, row_number() OVER (ORDER BY u DESC, host, partner, amount, source, segment) AS rn FROM t),
fr AS (SELECT DISTINCT nv, u FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.nv >= a.nv AND b.u >= a.u AND (b.nv > a.nv OR b.u > a.u)))
SELECT o.host, o.partner, o.amount, o.source, o.segment, o.nv AS novelty_score, round(exp(o.u) - 1, 3) AS ucb_orig, round(exp(med) - 1, 3) AS pred_orig,
       CASE WHEN rn <= 10 THEN o.host || '/' || o.partner END AS annotation, fr.u IS NOT NULL AS on_front
FROM o LEFT JOIN fr ON fr.nv = o.nv AND fr.u = o.u
""")
def i23(spark, d):
    out = screening_flow(spark, d).withColumn("ucb_log", F.round("ucb_log", 6)).withColumn("novelty_score", F.round("novelty_score", 6))
    view = C.novelty_performance(out, F.concat_ws("/", "host", "partner"), KEYS)
    return view.select(
        *KEYS, "novelty_score", r("ucb_orig", 3).alias("ucb_orig"), r("pred_orig", 3).alias("pred_orig"), "annotation", "on_front"
    )


@query("i12_ensemble_screening", f"""
WITH {ROWS_SQL},
dr AS (SELECT x1, x2, y, b.m AS member, {draw_sql("row_key", "b.m")} / 4294967296.0 AS u FROM rws, range({N_MEMBERS}) b(m)),
bw AS (SELECT member, x1, x2, y, {POISSON_SQL} AS w FROM dr),
m AS (SELECT member, sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2, sum(w * y) / sum(w) AS my FROM bw GROUP BY 1),
s AS (SELECT member, m1, m2, my, sum(w * (x1 - m1) * (x1 - m1)) + 1 AS a, sum(w * (x1 - m1) * (x2 - m2)) AS b,
        sum(w * (x2 - m2) * (x2 - m2)) + 1 AS e, sum(w * (x1 - m1) * (y - my)) AS p, sum(w * (x2 - m2) * (y - my)) AS q
      FROM bw JOIN m USING (member) GROUP BY 1, 2, 3, 4),
fits AS (SELECT m1, m2, my, (p * e - b * q) / (a * e - b * b) AS b1, (a * q - b * p) / (a * e - b * b) AS b2 FROM s),
pr AS (SELECT p_partkey, p_brand, p_type, my + b1 * (p_size - m1) + b2 * (p_retailprice / 1000 - m2) AS pred FROM part, fits),
iv AS (SELECT p_partkey, p_brand, p_type, quantile_cont(pred, 0.05) AS lo, quantile_cont(pred, 0.5) AS med, quantile_cont(pred, 0.95) AS hi
       FROM pr GROUP BY 1, 2, 3),
best AS (SELECT *, round(med + (hi - lo) / 2, 9) AS ucb, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY round(med + (hi - lo) / 2, 9) DESC, p_partkey) AS rn FROM iv)
SELECT p_partkey AS row_id, round(med, 6) AS pred_median_log, round(lo, 6) AS pred_p05_log, round(hi, 6) AS pred_p95_log, round(ucb, 6) AS ucb_log,
       CASE WHEN (hi - lo) / med <= 0.3 THEN 'HIGH' WHEN (hi - lo) / med <= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM best WHERE rn = 1 ORDER BY best.ucb DESC, p_partkey LIMIT 100
""")
def i12_ensemble(spark, d):
    fits = learn.bootstrap_ridge(rows(spark, d), ["x1", "x2"], "y", F.col("row_key"), 100)
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"), "p_brand", "p_type", "p_retailprice",
        F.col("p_size").cast("double").alias("x1"), (F.col("p_retailprice") / 1000).alias("x2"),
    )
    scored = learn.ensemble_interval(spread(part, "row_id"), fits)
    out = C.screening_table(scored, "p_brand", "p_type", "p_retailprice").withColumn("ucb_log", F.round("ucb_log", 9))
    best = C.best_candidates(out, ["p_brand", "p_type"], ["row_id"], 100)
    logs = ["pred_median_log", "pred_p05_log", "pred_p95_log", "ucb_log"]
    return best.select("row_id", *[r(x).alias(x) for x in logs], "confidence")


@query("i12_screening_flow", f"""
WITH {FLOW_SQL}
SELECT host, partner, amount, source, segment, round(med, 6) AS pred_median_log, round(hi - lo, 6) AS width_log,
       round(ucb, 6) AS ucb_log, round(novelty, 6) AS novelty_score,
       row_number() OVER (ORDER BY round(ucb, 9) DESC, host || '|' || partner || '|' || amount::VARCHAR || '|' || source || '|' || segment) AS rank
FROM fl
""")
def i12_flow(spark, d):
    key = F.concat_ws("|", "host", "partner", F.col("amount").cast("string"), "source", "segment")
    out = screening_flow(spark, d).withColumn("_u", F.round("ucb_log", 9)).withColumn("_key", key)
    out = learn.rank_by_prediction(out, "_u", "_key")
    width = r(F.col("pred_p95_log") - F.col("pred_p05_log")).alias("width_log")
    return out.select(
        "host", "partner", "amount", "source", "segment", r("pred_median_log").alias("pred_median_log"), width,
        r("ucb_log").alias("ucb_log"), r("novelty_score").alias("novelty_score"), "rank",
    )


SCORE_SQL = f"""
WITH {ROWS_SQL}, fit AS {ridge1_sql("rws", "w")}
"""


def scorer(spark, d):
    mom = ridge.moments(rows(spark, d), ["x1"], "y", "w")
    return ridge.solve(mom, mom.total())


@query("i11_batch_scoring", f"""
{SCORE_SQL}, {TYPE_PROPS_SQL}, {BOOT_FIT_SQL},
iv AS (SELECT p_partkey, quantile_cont(f.a + f.b * p_size, 0.1) AS lo, quantile_cont(f.a + f.b * p_size, 0.5) AS mid,
              quantile_cont(f.a + f.b * p_size, 0.9) AS hi FROM part, fits f GROUP BY 1)
SELECT p_partkey, round(coalesce(tp.weight, u.weight), 6) AS weight, round(fit.a + fit.b * p_size, 6) AS pred_log,
       round(greatest(exp(fit.a + fit.b * p_size) - 1, 0), 4) AS pred_orig, round(lo, 6) AS p10_log, round(mid, 6) AS p50_log,
       round(hi, 6) AS p90_log, round(hi - lo, 6) AS width_log, round(greatest(exp(lo) - 1, 0), 3) AS p10_orig,
       round(greatest(exp(mid) - 1, 0), 3) AS p50_orig, round(greatest(exp(hi) - 1, 0), 3) AS p90_orig,
       round(greatest(exp(hi) - 1, 0) - greatest(exp(lo) - 1, 0), 3) AS width_orig,
       row_number() OVER (ORDER BY round(mid, 9) DESC, p_partkey) AS rank
FROM part JOIN iv USING (p_partkey) LEFT JOIN tp ON tp.key = lower(trim(p_type)) JOIN tp u ON u.key = 'unknown', fit
""")
def i11(spark, d):
    """Every part enriched, shaped, scored with its interval and ranked by the ensemble's median."""
    part = spread(table(spark, d, "part").select("p_partkey", "p_type", "p_size"), "p_partkey")
    enriched = dim_lookup(part, "p_type", type_props(spark), ["weight"])
    shaped = roles.complete_schema(roles.alias_columns(enriched, {"p_size": "x1"}), {"x1": 0.0, "note": "missing"})
    scored = learn.score(scorer(spark, d), shaped, "pred_log")
    scored = learn.ensemble_interval(scored, members(spark, d), (0.1, 0.5, 0.9), ("p10_log", "p50_log", "p90_log"))
    scored = learn.original_scale(scored).withColumn("_p", F.round("p50_log", 9))
    ranked = learn.rank_by_prediction(scored, "_p", "p_partkey")
    logs = ["weight", "pred_log", "p10_log", "p50_log", "p90_log", "width_log"]
    origs = ["p10_orig", "p50_orig", "p90_orig", "width_orig"]
    return ranked.select(
        "p_partkey", *[r(c).alias(c) for c in logs], r("pred_orig", 4).alias("pred_orig"), *[r(c, 3).alias(c) for c in origs], "rank"
    )


@query("i11_stream_scoring", f"""
{SCORE_SQL} SELECT event_id, round(a + b * value / 10, 4) AS pred_log FROM events, fit
""")
def i11_stream(spark, d):
    fitted = scorer(spark, d)
    stream = file_stream(spark, d, table(spark, d, "events").schema, glob="events.parquet")

    def apply(df):
        return learn.score(fitted, df.select("event_id", (F.col("value") / 10).alias("x1")))

    out = score_available(stream, apply)
    return load_state(spark, out).select("event_id", r("pred_log", 4).alias("pred_log"))


@query("b6_role_projection", "SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem")
def b6(spark, d):
    spec = roles.ColumnRoles(
        target="l_extendedprice", log_target="y", key="l_orderkey", leakage=("l_shipdate",), provenance=("l_linenumber",),
        material=("l_partkey",), confidence=("l_suppkey",), identifiers=(),
    )
    return roles.select_features(table(spark, d, "lineitem"), spec)


@query("b7_drop_by_suffix", "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def b7(spark, d):
    return roles.drop_by_suffix(table(spark, d, "part"), "price")


@query("b8_schema_completion", """
SELECT c_custkey, c_acctbal, 'missing' AS c_region,
       round((SELECT quantile_cont(o_totalprice, 0.5) FROM orders), 6) AS o_totalprice, 0.0::DOUBLE AS extra FROM customer
""")
def b8(spark, d):
    medians = encode.fit_medians(table(spark, d, "orders").select("o_totalprice"), ["o_totalprice"])
    fill = {
        "c_acctbal": -1.0, "c_region": "missing", "o_totalprice": r(medians.select("o_totalprice").scalar()), "extra": 0.0,
    }
    return roles.complete_schema(table(spark, d, "customer").select("c_custkey", "c_acctbal"), fill)


@query("b9b10_alias_reindex", """
SELECT p_size AS size_mm, p_retailprice AS price, NULL::DOUBLE AS weight, p_partkey AS row_id FROM part
""")
def b9b10(spark, d):
    part = roles.alias_columns(
        table(spark, d, "part"), {"p_size": "size_mm", "p_retailprice": "price", "p_partkey": "row_id", "absent": "x"}
    )
    return roles.reindex(part, ["size_mm", "price", "weight", "row_id"])


@query("b17_interval_predicate", f"""
WITH {PAIRS_SQL} SELECT row_key, y >= p - 0.5 AND y <= p + 0.5 AS covered FROM pairs
""")
def b17(spark, d):
    from gridsieve.queries.common import pairs

    return pairs(spark, d).select("row_key", F.col("y").between(F.col("p") - 0.5, F.col("p") + 0.5).alias("covered"))


B19_RULES = {"price": ["price", "tax", "discount"], "flag": ["flag", "status"], "key": ["key", "price"]}


@query("b19_feature_groups", """
SELECT feature_group, feature, round(avg(value), 6) AS mean_value FROM (
  SELECT 'price' AS feature_group, 'l_extendedprice' AS feature, l_extendedprice AS value FROM lineitem
  UNION ALL SELECT 'price', 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'price', 'l_tax', l_tax FROM lineitem
  UNION ALL SELECT 'key', 'l_orderkey', l_orderkey FROM lineitem UNION ALL SELECT 'key', 'l_partkey', l_partkey FROM lineitem
  UNION ALL SELECT 'key', 'l_suppkey', l_suppkey FROM lineitem) GROUP BY 1, 2
""")
def b19(spark, d):
    li = table(spark, d, "lineitem").drop("l_returnflag", "l_linestatus", "l_shipdate")
    groups = learn.feature_groups(li.columns, B19_RULES)
    name = {c: g for g, cols in groups.items() for c in cols}
    packed = F.array(*[
        F.struct(F.lit(g).alias("feature_group"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
        for c, g in name.items()
    ])
    long = li.select(F.explode(packed).alias("s")).select("s.*")
    return long.groupBy("feature_group", "feature").agg(r(F.avg("value")).alias("mean_value"))


@query("f5_vector_topk_positions", """
SELECT vec_id, pos::INT AS pos, rank::INT AS rank FROM (
  SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS rank FROM (
    SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)) WHERE rank <= 5
""")
def f5(spark, d):
    pairs_ = F.transform("embedding", lambda x, i: F.struct((-x).alias("v"), i.alias("pos")))
    top = F.slice(F.array_sort(pairs_), 1, 5)
    out = table(spark, d, "embeddings").select("vec_id", F.posexplode(top).alias("rank", "s"))
    return out.select("vec_id", F.col("s.pos").alias("pos"), (F.col("rank") + 1).alias("rank"))


@query("h10_vector_distance", """
WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label, pos, avg(v) AS m FROM u GROUP BY 1, 2)
SELECT vec_id, round(sqrt(sum((v - m) * (v - m))), 6) AS distance FROM u JOIN c USING (label, pos) GROUP BY 1
""")
def h10(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    means = v.select("label", F.posexplode("e").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    centres = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("c"))
    centres = centres.select("label", F.transform("c", lambda s: s["m"]).alias("c"))
    return v.join(centres, "label").select("vec_id", r(euclidean("e", "c")).alias("distance"))
