"""Positions, quantiles, fronts, merges and versions that hold no table in one task."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsieve.functions import ranking
from gridsieve.operators import candidates, encode, ensemble, learn, lookup, ridge
from gridsieve.session import new_path
from gridsieve.sources import sinks


def test_rank_keeps_rows_without_a_prediction(spark):
    rows = [(1, 2.0), (2, None), (3, 5.0), (4, 2.0), (None, 2.0), (6, None), (7, float("nan"))]
    df = spark.createDataFrame(rows, "id long, p double").repartition(3)
    got = learn.rank_by_prediction(df, "p", "id").orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in got] == [(7, 1), (3, 2), (None, 3), (1, 4), (4, 5), (2, 6), (6, 7)]
    assert learn.rank_by_prediction(df.limit(0), "p", "id").count() == 0


def test_ties_of_one_prediction_are_spread(spark):
    df = spark.range(20_000).select(F.col("id"), F.lit(1.5).alias("p"))
    got = learn.rank_by_prediction(df, "p", "id")
    assert got.filter(F.col("rank") != F.col("id") + 1).count() == 0
    sizes = [r["count"] for r in spark.range(20_000).select("id", F.lit(1.5).alias("p")).repartitionByRange(8, F.col("p").desc(), "id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 8_000


def test_text_codes(spark):
    values = ["b", "a", "", "é", "z", "a", None, "ab", "B"] + [f"v{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "t string").repartition(5)
    want = {v: i for i, v in enumerate(sorted({v for v in values if v is not None}, key=lambda v: v.encode()))}
    assert {r.t: r.code for r in ranking.text_codes(df, "t").collect()} == want
    coded = encode.label_encode(df, "t", "c")
    assert coded.filter("t IS NULL AND c IS NULL").count() == 1 and coded.count() == len(values)
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert "v00001" not in plan


@pytest.mark.parametrize("accuracy,grid", [(4096, 256), (3, 7), (10_000, 3)])
def test_bracketed_quantiles_do_not_depend_on_the_sketch(spark, accuracy, grid):
    rng = np.random.default_rng(5)
    a = rng.normal(size=3000)
    b = np.where(rng.random(3000) < 0.6, 7.0, rng.integers(0, 20, 3000))
    rows = [(float(x), float(y) if i % 5 else None, None) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0, lambda n: (n - 3) / n]
    got = ranking.bracketed_quantiles(df, ["a", "b", "c"], probs, grid, accuracy)
    kept = b[np.arange(3000) % 5 > 0]
    for name, x in (("a", a), ("b", kept)):
        n, values = got[name]
        assert n == len(x)
        levels = [p(n) if callable(p) else p for p in probs]
        np.testing.assert_allclose(values, np.quantile(x, levels), rtol=1e-12, atol=1e-12)
    assert got["c"] == (0, [None] * len(probs))


def test_quantiles_of_few_rows_and_many_distinct_values(spark, monkeypatch):
    df = spark.createDataFrame([(3.0,), (1.0,)], "x double")
    assert ranking.bracketed_quantiles(df, ["x"], [0.5, 1.0])["x"] == (2, [2.0, 3.0])
    monkeypatch.setattr(ranking, "FEW", 5)
    many = spark.range(5000).select((F.col("id") * 1.0).alias("x"))
    assert ranking.bracketed_quantiles(many, ["x"], [0.5])["x"] == (5000, [2499.5])


def test_front_equals_all_pairs(spark):
    rng = np.random.default_rng(6)
    points = [(float(x), float(y)) for x, y in rng.integers(0, 30, (300, 2))] + [(None, 99.0), (5.0, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, x double, y double").repartition(4)
    full = [p for p in points if None not in p]
    want = {i for i, (x, y) in enumerate(points) if None not in (x, y) and not any(a >= x and b >= y and (a > x or b > y) for a, b in full)}
    rows = candidates.pareto_front(df, "x", "y").collect()
    assert len(rows) == len(points) and {r.id for r in rows if r.on_front} == want
    assert candidates.pareto_front(df.limit(0), "x", "y").count() == 0


def test_exactly_n_candidates_are_labelled(spark):
    rows = [(i, 1.0, 0.5, 0.1) for i in range(8)] + [(9, 2.0, 0.5, 0.1)]
    df = spark.createDataFrame(rows, "id long, ucb_log double, pred_median_log double, novelty_score double")
    view = candidates.novelty_performance(df, F.lit("x"), ["id"], 3)
    assert sorted(r.id for r in view.filter("annotation = 'x'").collect()) == [0, 1, 9]


def test_many_partials_merge_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(ridge, "MERGED", 4)
    rng = np.random.default_rng(7)
    x = rng.normal(50, 3, (400, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=400)
    df = spark.createDataFrame([(i % 2, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "k int, a double, b double, y double")
    one, many = (ridge.moments(df.repartition(n), ["a", "b"], "y", None, keys) for n, keys in ((1, ["k"]), (40, ["k"])))
    for k in one.by_key:
        np.testing.assert_allclose(ridge.solve(one, one.by_key[k]).coefficients, ridge.solve(many, many.by_key[k]).coefficients, rtol=1e-9)
    fits = [ridge.solve(m, m.total()) for m in (ridge.moments(df.repartition(n), ["a", "b"], "y") for n in (1, 40))]
    np.testing.assert_allclose(fits[0].coefficients, fits[1].coefficients, rtol=1e-9)


def test_versions_of_one_table(spark):
    path = new_path(spark, "t-versions")
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, path)
    sinks.write_version(spark.range(3), path)
    first = sinks.read_version(spark, path)
    sinks.write_version(first.withColumn("more", F.col("id") * 2), path)
    assert first.count() == 3 and sinks.read_version(spark, path).columns == ["id", "more"]
    broken = spark.range(3).select(F.raise_error(F.lit("stop")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_version(broken, path)
    assert sinks.read_version(spark, path).columns == ["id", "more"]
    # rows without a pointer, as an interrupted writer leaves them, are nobody's version
    spark.range(9).write.parquet(f"{path}/v9-interrupted")
    assert sinks.read_version(spark, path).count() == 3
    sinks.write_version(spark.range(5), path)
    assert sinks.read_version(spark, path).count() == 5 and len(sinks._versions(spark, path)) == 2


@pytest.mark.parametrize("leaf", [4096, 20, 1])
def test_every_member_draws_n_of_n(spark, leaf):
    df = spark.range(700).select("id", (F.col("id") * 0.5).alias("x"))
    drawn = ensemble.exact_bootstrap(df.repartition(3), F.col("id"), 7, leaf=leaf)
    rows = {r.id: r.boot_weights for r in drawn.collect()}
    w = np.array([rows[i] for i in range(700)])
    assert w.shape == (700, 7) and (w.sum(0) == 700).all() and drawn.columns == ["id", "x", "boot_weights"]
    again = ensemble.exact_bootstrap(df.repartition(11, "x"), F.col("id"), 7, leaf=leaf).collect()
    assert {r.id: r.boot_weights for r in again} == rows
    assert abs((w == 0).mean() - np.exp(-1)) < 0.03 and abs((w == 1).mean() - np.exp(-1)) < 0.03
    assert len({tuple(c) for c in w.T}) == 7
    assert ensemble.exact_bootstrap(df.limit(0), F.col("id"), 3).count() == 0


def test_member_sums_equal_the_long_form(spark):
    rows = [(i, "ab"[i % 2] if i % 7 else None, float(i) if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(4)
    boot = ensemble.poisson_bootstrap(df.filter("v IS NOT NULL"), F.col("id"), 9, 3)
    long = boot.groupBy("g", "member").agg(F.sum("boot_weight").alias("n"), F.sum(F.col("boot_weight") * F.col("v")).alias("s")).collect()
    want = {(r.g, r.member): (r.n, r.s) for r in long}
    for r in ensemble.bootstrap_sums(df, F.col("id"), ["g"], "v", 9, 3).collect():
        for m in range(9):
            assert (r.n_draws[m], r.sums[m]) == pytest.approx(want.get((r.g, m), (0, 0.0)))


def test_member_sums_are_those_of_the_decimals(spark):
    """Sums of cents come out right to the last bit or so, whatever the order of the rows."""
    df = spark.createDataFrame([(i, (i * 7919 % 100_003) / 100 + 1e6) for i in range(20_000)], "id long, v double").repartition(4)
    weights = ensemble.poisson_bootstrap(df, F.col("id"), 6, 3).groupBy("member").agg(F.collect_list(F.struct("boot_weight", "v")).alias("all"))
    want = {r.member: math.fsum(round(a.v * 100) * a.boot_weight for a in r["all"]) / 100 for r in weights.collect()}
    (got,) = ensemble.bootstrap_sums(df, F.col("id"), [], "v", 6, 3).collect()
    assert all(abs(got.sums[m] - want[m]) <= math.ulp(want[m]) for m in range(6))


def test_seed_index_finds_the_longest_key(spark):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcé😀 "), rng.integers(1, 9))) for _ in range(150)]
    texts = ["".join(rng.choice(words, 40)) for _ in range(60)] + ["", None, "  ", "a", "no hit Ω" * 3, "x" * 50_000, "aaaa" * 5000]
    keys = [(w, i, i * 10) for i, w in enumerate(words)] + [("xxxxx", 900, 1), ("XXX", 901, 2), ("", 902, 3), (None, 903, 4), ("aaaaaaaa", 904, 5)]
    strip = lambda t: (t or "").strip(" \t\n\r\x0b\x0c").lower()
    known = [(strip(k), o, v) for k, o, v in keys if strip(k)]

    def want(t):
        hits = [(-len(k), o, v) for k, o, v in known if k in strip(t)]
        return min(hits)[2] if hits else None

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(3)
    dictionary = spark.createDataFrame(keys, "k string, o int, v int")
    got = {r.id: r.found for r in lookup.longest_substring_join(df, "t", dictionary, "k", "v", "o", "found").collect()}
    assert got == {i: want(t) for i, t in enumerate(texts)}
    none = lookup.longest_substring_join(df, "t", dictionary.limit(0), "k", "v", "o", "found")
    assert none.count() == len(texts) and none.filter("found IS NOT NULL").count() == 0
