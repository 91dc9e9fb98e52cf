"""Profiles, metrics, conformal quantities, ensembles and target encoding."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridsieve.functions.hashing import hash32
from gridsieve.functions.ranking import column_quantiles
from gridsieve.operators import encode, ensemble, metrics, profile, split
from gridsieve.queries.common import PAIRS_SQL, draw_sql, hash32_sql, pairs, query, r, spread, table
from gridsieve.queries.curation import PROFILE_COLUMNS, labelled
from gridsieve.session import new_path
from gridsieve.sources.sinks import save_state


def rounded(df, digits=6, keep=()):
    """Rounds every double column."""
    return df.select(*[
        r(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes
    ])


@query("d1_null_share", f"""
WITH j AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
{" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(100 * avg(({c} IS NULL)::INT), 6) AS null_pct FROM j" for c in PROFILE_COLUMNS)}
""")
def d1(spark, d):
    return rounded(profile.null_shares(labelled(spark, d)))


@query("d2_kpis", """
SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_customers, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
       round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(avg((o_orderstatus = 'F')::INT), 6) AS share_f
FROM orders
""")
def d2(spark, d):
    o = table(spark, d, "orders")
    basic = o.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_custkey").alias("n_customers"),
        F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"),
        r(F.avg((F.col("o_orderstatus") == "F").cast("double"))).alias("share_f"),
    )
    median = column_quantiles(o, ["o_totalprice"], [0.5]).select(F.col("quantiles")[0]).scalar()
    return basic.withColumn("median", r(median))


@query("d3_value_counts", """
SELECT event_type, count(*) AS n_rows FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1
""")
def d3(spark, d):
    return profile.value_counts(table(spark, d, "events"), "event_type")


def _share_sql(col):
    cats = ("0", "1", "9")
    return f"SELECT '{col}' AS \"column\", " + ", ".join(
        f"round(coalesce(avg(({col} = {c})::INT), 0), 6) AS \"{c}\"" for c in cats
    ) + " FROM j"


@query("d4_share_pivot", f"""
WITH j AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
{_share_sql("quality")} UNION ALL {_share_sql("toxic")}
""")
def d4(spark, d):
    text = labelled(spark, d).select(F.col("quality").cast("string"), F.col("toxic").cast("string"))
    return rounded(profile.category_shares(text, ["quality", "toxic"], ["0", "1", "9"]))


@query("d5_group_median_topn", """
WITH top AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8)
SELECT p_brand, count(*) AS n_rows, round(quantile_cont(p_retailprice, 0.5), 6) AS median
FROM part WHERE p_brand IN (SELECT p_brand FROM top) GROUP BY 1
""")
def d5(spark, d):
    from gridsieve.operators.curate import in_top_categories

    part = in_top_categories(table(spark, d, "part").select("p_brand", "p_retailprice"), "p_brand", 8)
    return rounded(profile.group_quantiles(part, ["p_brand"], "p_retailprice", [0.5], ["median"]))


@query("d6_group_median_std", """
SELECT user_id, count(value) AS n_rows, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std
FROM events GROUP BY user_id
""")
def d6(spark, d):
    return rounded(profile.group_median_std(table(spark, d, "events").select("user_id", "value"), ["user_id"], "value"))


PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)


@query("d7_percentiles", f"""
SELECT l_returnflag, {", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS p{int(p * 100)}" for p in PROBS)},
       count(*) AS n_rows FROM lineitem GROUP BY 1
""")
def d7(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    names = [f"p{int(p * 100)}" for p in PROBS]
    return rounded(profile.group_quantiles(li, ["l_returnflag"], "l_extendedprice", PROBS, names))


@query("d8_column_medians", """
SELECT round(quantile_cont(l_quantity, 0.5), 6) AS l_quantity, round(quantile_cont(l_extendedprice, 0.5), 6) AS
  l_extendedprice, round(quantile_cont(l_discount, 0.5), 6) AS l_discount, round(quantile_cont(l_tax, 0.5), 6) AS l_tax
FROM lineitem
""")
def d8(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(encode.fit_medians(table(spark, d, "lineitem").select(*cols), cols))


@query("d9_histogram", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 30.0 AS w FROM events),
c AS (SELECT least(floor((value - lo) / w), 29)::INT AS bin, count(*) AS n FROM events, s GROUP BY 1)
SELECT b.bin::INT AS bin, round(lo + b.bin * w, 6) AS lower, round(lo + (b.bin + 1) * w, 6) AS upper, coalesce(n, 0) AS n_rows
FROM range(30) b(bin) CROSS JOIN s LEFT JOIN c ON c.bin = b.bin
""")
def d9(spark, d):
    return rounded(profile.histogram(table(spark, d, "events"), "value", 30))


@query("d10_log_histogram", """
WITH x AS (SELECT log10(o_totalprice + 1) AS v FROM orders),
c AS (SELECT least(floor((v - 0) / (6.0 / 29)), 28)::INT AS bin, count(*) AS n FROM x WHERE v >= 0 AND v <= 6 GROUP BY 1)
SELECT b.bin::INT AS bin, round(b.bin * (6.0 / 29), 6) AS lower, round((b.bin + 1) * (6.0 / 29), 6) AS upper,
       coalesce(n, 0) AS n_rows
FROM range(29) b(bin) LEFT JOIN c ON c.bin = b.bin
""")
def d10(spark, d):
    return rounded(profile.histogram(table(spark, d, "orders"), F.log10(F.col("o_totalprice") + 1), 29, 0.0, 6.0))


@query("d11_box_stats", """
WITH top AS (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
e AS (SELECT event_type, value FROM events WHERE event_type IN (SELECT event_type FROM top)),
q AS (SELECT event_type, count(*) AS n_rows, min(value) AS min, quantile_cont(value, 0.25) AS q1,
             quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS max FROM e GROUP BY 1)
SELECT q.event_type, n_rows, round(q.min, 6) AS min, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(q.max, 6) AS max,
       (SELECT min(value) FROM e WHERE e.event_type = q.event_type AND value >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
       (SELECT max(value) FROM e WHERE e.event_type = q.event_type AND value <= q3 + 1.5 * (q3 - q1)) AS whisker_hi
FROM q
""")
def d11(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    return rounded(profile.box_stats(e, "event_type", "value", top=3))


CORR_COLS = ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey")


@query("d12_corr_with_target", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(corr({c}::DOUBLE, ln(1 + l_extendedprice)), 6) AS corr FROM lineitem"
    for c in CORR_COLS
))
def d12(spark, d):
    li = table(spark, d, "lineitem").withColumn("y", F.log1p("l_extendedprice"))
    return rounded(profile.correlations(li, CORR_COLS, "y"))


METRICS_SQL = """
  count(*) AS n_rows,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2_log,
  round(avg(abs(y - p)), 6) AS mae_log,
  round(1 - sum(power(exp(y) - exp(greatest(p, 0)), 2)) / (var_pop(exp(y) - 1) * count(*)), 6) AS r2_orig,
  round(avg(abs(exp(y) - exp(greatest(p, 0)))), 4) AS mae_orig,
  round(sqrt(avg(power(exp(y) - exp(greatest(p, 0)), 2))), 4) AS rmse_orig
"""


def _metric_cols(df):
    return df.withColumns({
        "r2_log": r("r2_log"), "mae_log": r("mae_log"), "r2_orig": r("r2_orig"),
        "mae_orig": r("mae_orig", 4), "rmse_orig": r("rmse_orig", 4),
    })


@query("d13_regression_metrics", f"WITH {PAIRS_SQL} SELECT {METRICS_SQL} FROM pairs")
def d13(spark, d):
    return _metric_cols(metrics.regression_metrics(pairs(spark, d), "y", "p"))


@query("d14_group_metrics", f"WITH {PAIRS_SQL} SELECT p_brand, {METRICS_SQL} FROM pairs GROUP BY 1 HAVING count(*) >= 2000")
def d14(spark, d):
    return _metric_cols(metrics.regression_metrics(pairs(spark, d), "y", "p", ["p_brand"], 2000))


@query("d15_spearman", f"""
WITH {PAIRS_SQL},
k AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry,
             rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM pairs),
s AS (SELECT count(*) AS n_rows, corr(ry, rp) AS rho FROM k)
SELECT n_rows, round(rho, 6) AS rho, round(rho * sqrt((n_rows - 2) / (1 - rho * rho)), 4) AS t_stat FROM s
""")
def d15(spark, d):
    out = metrics.spearman(pairs(spark, d), "y", "p")
    return out.select("n_rows", r("rho").alias("rho"), r("t_stat", 4).alias("t_stat"))


@query("d16_normality", """
WITH x AS (SELECT value - avg(value) OVER (PARTITION BY event_type) AS res FROM events),
c AS (SELECT res - avg(res) OVER () AS z FROM x),
m AS (SELECT count(*)::DOUBLE AS n, avg(z * z) AS m2, avg(z * z * z) AS m3, avg(z * z * z * z) AS m4 FROM c),
g AS (SELECT n, m3 / power(m2, 1.5) AS g1, m4 / (m2 * m2) AS b2,
   3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
   6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM m),
h AS (SELECT *, sqrt(2 * (beta2 - 1)) - 1 AS w2, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS a,
   (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x2 FROM g),
z AS (SELECT *, asinh(g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1,
   (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x2 * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM h)
SELECT n::BIGINT AS n_rows, round(g1, 6) AS skewness, round(b2 - 3, 6) AS kurtosis, round(z1 * z1 + z2 * z2, 4) AS k2,
       round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p_value FROM z
""")
def d16(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    means = save_state(e.groupBy("event_type").agg(F.avg("value").alias("m")), new_path(spark, "means"))
    res = e.join(means, "event_type").select((F.col("value") - F.col("m")).alias("res"))
    return rounded(metrics.normality_test(res, "res"), keep=("k2",)).withColumn("k2", r("k2", 4))


@query("d17_coverage", f"""
WITH {PAIRS_SQL}
SELECT p_type, count(*) AS n_rows, sum((y BETWEEN p - 1 AND p + 1)::INT)::BIGINT AS n_covered,
  round(avg((y BETWEEN p - 1 AND p + 1)::INT), 6) AS coverage, round(avg((p + 1) - (p - 1)), 6) AS mean_width_log,
  round(avg(exp(p + 1) - exp(p - 1)), 3) AS mean_width_orig
FROM pairs GROUP BY 1
""")
def d17(spark, d):
    rows = pairs(spark, d).withColumns({"lo": F.col("p") - 1, "hi": F.col("p") + 1})
    out = metrics.coverage(rows, "y", "lo", "hi", ["p_type"])
    return out.withColumns({
        "coverage": r("coverage"), "mean_width_log": r("mean_width_log"), "mean_width_orig": r("mean_width_orig", 3),
    })


QHAT_SQL = f"""
cal AS (SELECT abs(y - p) AS s FROM pairs WHERE {hash32_sql("row_key", 12)} / 4294967296.0 < 0.2),
lv AS (SELECT count(*) AS n_cal, least(1.0, ceil((count(*) + 1) * (1 - 0.1::DOUBLE)) / count(*)) AS level FROM cal),
srt AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM cal),
pos AS (SELECT n_cal, level, (n_cal - 1) * level AS h FROM lv),
q AS (SELECT n_cal, level, a.s + (b.s - a.s) * (h - floor(h)) AS q_hat FROM pos
      JOIN srt a ON a.i = floor(h) JOIN srt b ON b.i = ceil(h))
"""


def calibration_rows(spark, d):
    tagged = split.hash_split(pairs(spark, d), F.col("row_key"), 0.2, seed=12, out="part_of")
    return tagged.filter(F.col("part_of") == "test")


@query("d18_conformal_quantile", f"""
WITH {PAIRS_SQL}, {QHAT_SQL} SELECT n_cal, round(level, 9) AS level, round(q_hat, 6) AS q_hat FROM q
""")
def d18(spark, d):
    q = metrics.conformal_quantile(calibration_rows(spark, d), "y", "p", 0.10)
    return q.select("n_cal", r("level", 9).alias("level"), r("q_hat").alias("q_hat"))


@query("h19_conformal_intervals", f"""
WITH {PAIRS_SQL}, {QHAT_SQL}
SELECT row_key, round(p - q_hat, 5) AS lower_log, round(p + q_hat, 5) AS upper_log,
       round(greatest(exp(p - q_hat) - 1, 0), 2) AS lower_orig, (y BETWEEN p - q_hat AND p + q_hat) AS covered
FROM pairs, q WHERE {hash32_sql("row_key", 12)} / 4294967296.0 >= 0.2
""")
def h19(spark, d):
    q = metrics.conformal_quantile(calibration_rows(spark, d), "y", "p", 0.10)
    tagged = split.hash_split(pairs(spark, d), F.col("row_key"), 0.2, seed=12, out="part_of")
    out = metrics.add_conformal_interval(tagged.filter(F.col("part_of") == "train"), "p", q)
    return out.select(
        "row_key", r("lower_log", 5).alias("lower_log"), r("upper_log", 5).alias("upper_log"),
        r("lower_orig", 2).alias("lower_orig"), F.col("y").between(F.col("lower_log"), F.col("upper_log")).alias("covered"),
    )


@query("d20_domain_counts", """
SELECT user_id, count_if(value <= 60)::BIGINT AS n_within, count_if(NOT value <= 60)::BIGINT AS n_outside,
       round(100 * avg((value <= 60)::INT), 6) AS pct_within FROM events GROUP BY 1
""")
def d20(spark, d):
    e = table(spark, d, "events").withColumn("within", F.col("value") <= 60)
    return rounded(metrics.domain_counts(e, "within", ["user_id"]))


# P(X<=k) = sum of 1/(e k!); the draws are 32 bits wide, so nothing beyond 12 can be told apart
POISSON_SQL = "CASE " + " ".join(
    f"WHEN u < exp(-1) * ({' + '.join(f'1.0::DOUBLE / {math.factorial(i)}' for i in range(k + 1))}) THEN {k}" for k in range(12)
) + " ELSE 12 END"
N_MEMBERS = 100
BOOT_SQL = f"""
draws AS (SELECT event_id, event_type, value, b.m AS member,
   {draw_sql("event_id", "b.m")} / 4294967296.0 AS u
   FROM events, range({N_MEMBERS}) b(m)),
boot AS (SELECT *, {POISSON_SQL} AS w FROM draws),
members AS (SELECT event_type, member::INT AS member, sum(w)::BIGINT AS n_draws, sum(w * value) / sum(w) AS pred
   FROM boot WHERE w > 0 GROUP BY 1, 2)
"""


def member_sums(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return ensemble.bootstrap_sums(e, F.col("event_id"), ["event_type"], "value", N_MEMBERS)


def member_means(spark, d):
    means = F.transform(F.arrays_zip("n_draws", "sums"), lambda m: m["sums"] / F.nullif(m["n_draws"], F.lit(0)))
    return member_sums(spark, d).select("event_type", means.alias("preds"))


@query("e11_poisson_bootstrap", f"WITH {BOOT_SQL} SELECT event_type, member, n_draws, round(pred, 6) AS pred FROM members")
def e11(spark, d):
    long = member_sums(spark, d).select("event_type", F.posexplode(F.arrays_zip("n_draws", "sums")).alias("member", "m"))
    return rounded(long.select("event_type", "member", "m.n_draws", (F.col("m.sums") / F.col("m.n_draws")).alias("pred")))


@query("e11_exact_bootstrap", f"""
SELECT b.m::INT AS member, count(*) AS n_draws, TRUE AS some_rows_left_out, TRUE AS mean_is_near
FROM events, range({N_MEMBERS}) b(m) GROUP BY 1
""")
def e11_exact(spark, d):
    """Every member draws exactly as many rows as there are; about a share of 1/e of them is left out."""
    e = table(spark, d, "events").select("event_id", "value")
    drawn = ensemble.exact_bootstrap(e, F.col("event_id"), N_MEMBERS, leaf=1000)
    long = drawn.select("value", F.posexplode("boot_weights").alias("member", "w"))
    whole = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count(F.lit(1)).alias("n")).first()
    mean = F.sum(F.col("w") * F.col("value")) / F.sum("w")
    return long.groupBy("member").agg(
        F.sum("w").alias("n_draws"), (F.abs(F.avg((F.col("w") == 0).cast("double")) - math.exp(-1)) < 0.05).alias("some_rows_left_out"),
        (F.abs(mean - whole.m) < 6 * whole.s / math.sqrt(whole.n)).alias("mean_is_near"),
    )


@query("d21_ensemble_quantiles", f"""
WITH {BOOT_SQL} SELECT event_type, round(quantile_cont(pred, 0.05), 6) AS p05, round(quantile_cont(pred, 0.5), 6) AS median,
  round(quantile_cont(pred, 0.95), 6) AS p95 FROM members GROUP BY 1
""")
def d21(spark, d):
    return rounded(ensemble.quantile_columns(member_means(spark, d)).drop("preds"))


@query("d22_disagreement", f"""
WITH {BOOT_SQL} SELECT event_type, round(stddev_pop(pred), 6) AS disagreement FROM members GROUP BY 1
""")
def d22(spark, d):
    return rounded(member_means(spark, d).select("event_type", ensemble.array_disagreement().alias("disagreement")))


@query("d23_calibration_curve", f"""
WITH draws AS (SELECT c_custkey, c_acctbal AS y, b.m AS member, c_acctbal +
     ({hash32_sql("c_custkey::VARCHAR || '#' || b.m::VARCHAR", 5)} / 4294967296.0 - 0.45) * 3000 AS pred
   FROM customer, range({N_MEMBERS}) b(m)),
lv AS (SELECT i / 20.0 AS c FROM range(1, 20) t(i)),
iv AS (SELECT c_custkey, y, quantile_cont(pred, [{", ".join(f"{(1 - i / 20) / 2}" for i in range(1, 20))}]) AS lo,
          quantile_cont(pred, [{", ".join(f"{1 - (1 - i / 20) / 2}" for i in range(1, 20))}]) AS hi FROM draws GROUP BY 1, 2)
SELECT round(i / 20.0, 10)::DOUBLE AS nominal, count(*) AS n_rows, round(avg((y BETWEEN lo[i] AND hi[i])::INT), 6) AS empirical
FROM iv, range(1, 20) t(i) GROUP BY i
""")
def d23(spark, d):
    c = spread(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("y")), "c_custkey")
    noise = lambda m: hash32(F.concat_ws("#", F.col("c_custkey").cast("string"), m.cast("string")), 5)
    preds = F.transform(F.sequence(F.lit(0), F.lit(N_MEMBERS - 1)), lambda m: F.col("y") + (noise(m) / F.lit(4294967296.0) - 0.45) * 3000)
    return rounded(ensemble.array_calibration(c.withColumn("preds", preds), "y"))


FOLD_R2_SQL = f"""
folds AS (SELECT p_type, {hash32_sql("row_key", 42)} % 5 AS fold, y, p FROM pairs),
scores AS (SELECT p_type AS model, fold, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM folds GROUP BY 1, 2),
cv AS (SELECT model, count(r2) AS n_folds, avg(r2) AS mean, stddev_pop(r2) AS std FROM scores GROUP BY 1)
"""


def fold_scores(spark, d):
    rows = split.kfold(pairs(spark, d), F.col("row_key"))
    return rows.groupBy(F.col("p_type").alias("model"), "fold").agg(metrics.r2_expr("y", "p").alias("r2"))


@query("d24_cv_summary", f"""
WITH {PAIRS_SQL}, {FOLD_R2_SQL} SELECT model, n_folds, round(mean, 6) AS mean, round(std, 6) AS std FROM cv
""")
def d24(spark, d):
    return rounded(metrics.cv_summary(fold_scores(spark, d), ["model"]))


SHIFTED_SQL = """
base AS (SELECT p_type AS model, corr(y, p) * corr(y, p) AS group_r2, corr(exp(y), exp(p)) * corr(exp(y), exp(p)) AS test_r2
         FROM pairs GROUP BY 1),
scored AS (SELECT *, 0.6 * greatest(group_r2, 0) + 0.4 * greatest(test_r2, 0) AS composite FROM base)
"""


def model_metrics(spark, d):
    a, b = F.corr("y", "p"), F.corr(F.exp("y"), F.exp("p"))
    base = pairs(spark, d).groupBy(F.col("p_type").alias("model")).agg((a * a).alias("group_r2"), (b * b).alias("test_r2"))
    return metrics.composite_scores(base, "group_r2", "test_r2")


@query("d28_model_selection", f"""
WITH {PAIRS_SQL}, {SHIFTED_SQL} SELECT model, round(composite, 9) AS composite FROM scored
ORDER BY scored.composite DESC, model DESC LIMIT 1
""")
def d28(spark, d):
    return rounded(metrics.select_best(model_metrics(spark, d)), 9)


@query("d29_delta_baseline", f"""
WITH {PAIRS_SQL}, {FOLD_R2_SQL}
SELECT model, round(mean, 6) AS mean, round(mean - (SELECT mean FROM cv WHERE model = 'ECONOMY'), 6) AS delta FROM cv
""")
def d29(spark, d):
    cv = metrics.cv_summary(fold_scores(spark, d), ["model"])
    out = metrics.delta_to_baseline(cv, F.col("model") == "ECONOMY", "mean", "delta")
    return rounded(out.select("model", "mean", "delta"))


@query("i21_metric_pivot", f"""
WITH {PAIRS_SQL}, {SHIFTED_SQL}
SELECT model, round(group_r2, 9) AS group_r2, round(test_r2, 9) AS test_r2, round(composite, 9) AS composite FROM scored
""")
def i21(spark, d):
    names = ["group_r2", "test_r2", "composite"]
    long = model_metrics(spark, d).unpivot("model", names, "metric", "value")
    return rounded(metrics.metric_pivot(long, names), 9)


@query("a8_metric_upsert", f"""
WITH {PAIRS_SQL}, {SHIFTED_SQL},
old AS (SELECT model, 'group_r2' AS metric, group_r2 AS value FROM scored UNION ALL SELECT model, 'composite', 0 FROM scored),
new AS (SELECT model, 'composite' AS metric, composite AS value FROM scored UNION ALL SELECT model, 'test_r2', test_r2 FROM scored)
SELECT coalesce(o.model, n.model) AS model, coalesce(o.metric, n.metric) AS metric, round(coalesce(n.value, o.value), 9) AS value
FROM old o FULL OUTER JOIN new n ON o.model = n.model AND o.metric = n.metric
""")
def a8(spark, d):
    m = model_metrics(spark, d)
    old = m.select("model", "group_r2", F.lit(0.0).alias("composite")).unpivot("model", ["group_r2", "composite"], "metric", "value")
    new = m.unpivot("model", ["composite", "test_r2"], "metric", "value")
    return rounded(metrics.upsert(old, new, ["model", "metric"], "value"), 9)


TE_SQL = f"""
o AS (SELECT o_orderkey, c_mktsegment AS cat, ln(1 + o_totalprice) AS y, {hash32_sql("o_orderkey", 42)} % 5 AS fold,
        CASE WHEN {hash32_sql("o_orderkey", 1)} / 4294967296.0 < 0.15 THEN 'test' ELSE 'train' END AS split
      FROM orders JOIN customer ON o_custkey = c_custkey),
train AS (SELECT * FROM o WHERE split = 'train'),
fs AS (SELECT f.fold, t.cat, count(*) AS n, avg(t.y) AS m, var_pop(t.y) AS v FROM range(5) f(fold) JOIN train t ON t.fold <> f.fold GROUP BY 1, 2),
fg AS (SELECT f.fold, avg(t.y) AS gm, var_pop(t.y) AS gv FROM range(5) f(fold) JOIN train t ON t.fold <> f.fold GROUP BY 1),
cs AS (SELECT cat, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM train GROUP BY 1),
cg AS (SELECT avg(y) AS gm, var_pop(y) AS gv FROM train)
"""


@query("d25_target_encoding", f"""
WITH {TE_SQL}
SELECT o_orderkey, 'train' AS split, round((n * gv / (n * gv + v)) * m + (1 - n * gv / (n * gv + v)) * gm, 6) AS encoding
FROM train JOIN fs USING (fold, cat) JOIN fg USING (fold)
UNION ALL
SELECT o_orderkey, 'test', round((n * gv / (n * gv + v)) * m + (1 - n * gv / (n * gv + v)) * gm, 6)
FROM o JOIN cs USING (cat), cg WHERE split = 'test'
""")
def d25(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.log1p("o_totalprice").alias("y"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("cat"))
    rows = split.hash_split(split.kfold(o.join(c, "o_custkey"), F.col("o_orderkey")), F.col("o_orderkey"), 0.15, seed=1)
    train = rows.filter(F.col("split") == "train")
    inside = encode.cross_fit_target_encoding(train, "cat", "y", "fold", "encoding_")
    fitted = encode.fit_target_encoding(train, "cat", "y")
    outside = encode.apply_target_encoding(rows.filter(F.col("split") == "test"), fitted, "cat", "encoding_")
    cols = ["o_orderkey", "split", r("encoding_").alias("encoding")]
    return inside.select(*cols).union(outside.select(*cols))


@query("d30_predicate_pair_counts", """
SELECT count_if(value > 100 AND event_type = 'click')::BIGINT AS n_novel_high, count_if(event_type = 'click')::BIGINT AS n_high,
  (SELECT round(avg(value), 6) FROM (SELECT value FROM events ORDER BY value DESC, event_id LIMIT 10)) AS top10_mean
FROM events
""")
def d30(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    top = e.orderBy(F.desc("value"), "event_id").limit(10).agg(r(F.avg("value")).alias("m")).scalar()
    high = F.col("event_type") == "click"
    return e.agg(
        F.count_if((F.col("value") > 100) & high).alias("n_novel_high"), F.count_if(high).alias("n_high")
    ).withColumn("top10_mean", top)


@query("d31_distinct_sorted", "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY 1")
def d31(spark, d):
    return profile.distinct_sorted(table(spark, d, "part"), "p_brand")


@query("d33_year_counts", "SELECT year(o_orderdate)::INT AS year, count(*) AS n_rows FROM orders GROUP BY 1 ORDER BY 1")
def d33(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows")
    ).orderBy("year")
