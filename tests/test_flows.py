"""Curation edge cases, end-to-end flows, sources and sinks, streaming."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsieve.operators import candidates, curate, learn, metrics, ridge
from gridsieve.operators.roles import ColumnRoles, alias_columns, drop_by_suffix, reindex
from gridsieve.plans import curation, screening
from gridsieve.session import new_path
from gridsieve.sources import sinks, tables
from gridsieve.streaming.scoring import file_stream, score_available

SCHEMA = (
    "row_id long, experiment_hash string, metadata_completeness_score double, data_quality_flag string, year double, "
    "HER_std_umol_g_h double, AQY_pct double, DOI string, confidence_HER string, confidence_light string, "
    "host_material string, co_catalyst string, form string, co_catalyst_wt_pct double, glycerol_concentration_v_pct double, "
    "catalyst_loading_g_L double, light_source_type string, pH double, mostly_null double, constant string"
)
HOSTS = [" TiO2 ", "ZnO", "CdS", "g-C3N4", "weird"]
PARTNERS = ["Pt", "none", None, "Ni", "", "nan"]


def experiments(spark, n=400):
    rows = []
    for i in range(n):
        host, partner = HOSTS[i % 5], PARTNERS[i % 6]
        her = math.exp(3 + (i % 5) + 0.3 * (i % 7)) * (1 + (i * 37 % 11) / 40)
        rows.append((
            i, f"h{i}", 0.4 + (i % 6) / 10, "OK" if i % 9 else None, 2000.0 + i % 20, her, float(i % 13), "doi",
            ["High", "low", None][i % 3], "MEDIUM", host, partner, ["\tfilm ", "POWDER", "null"][i % 3],
            [0.5, 1.0, 2.0][i % 3], float(i % 4 * 10), 0.5 + i % 2, ["visible", "solar"][i % 2],
            7.0 + i % 3 if i % 10 else None, 1.0 * i if i % 25 == 0 else None, "same" if i % 4 else None,
        ))
    bad = list(rows[0])
    for k, change in enumerate([
        {"year": 1927.0}, {"year": None}, {"flag": "LIKELY_ERROR"}, {"her": 0.0}, {"her": -5.0}, {"her": None},
        {"hash": "h1", "score": 0.01}, {"hash": "h1", "score": None}, {"hash": None}, {"hash": None},
    ]):
        row = list(bad)
        row[0], row[1] = 1000 + k, change.get("hash", f"bad{k}") if "hash" in change else f"bad{k}"
        row[2] = change.get("score", row[2])
        row[3], row[4], row[5] = change.get("flag", "OK"), change.get("year", 2010.0), change.get("her", 50.0)
        rows.append(tuple(row))
    return spark.createDataFrame(rows, SCHEMA)


def test_curation_edge_rows(spark):
    raw = experiments(spark)
    lineage = {r["drop_reason"]: r["n_rows"] for r in curate.drop_lineage(curate.drop_reasons(raw, curation.drop_steps(ColumnRoles()))).collect()}
    assert lineage == {"year": 2, "quality_flag": 1, "target": 3, "kept": 404}
    clean = curation.curate_experiments(raw)
    assert clean.count() == 401  # three copies of h1 become one, the two NULL keys become one
    assert "mostly_null" not in clean.columns and "constant" not in clean.columns and "pH" in clean.columns
    assert clean.filter("row_id = 1").count() == 1 and clean.filter("experiment_hash is null").count() == 1
    assert {r[0] for r in clean.select("form").distinct().collect()} == {"film", "powder", None}
    assert clean.filter("host_material = 'tio2'").select("semi_bandgap_eV").distinct().collect()[0][0] == 3.2


def test_flow_from_raw_to_screening(spark, tmp_path):
    roles = ColumnRoles()
    table = curation.split_and_weigh(curation.curate_experiments(experiments(spark)), roles)
    weights = table.agg(F.min("w"), F.max("w")).first()
    assert weights[0] >= 0.1 and weights[1] <= 1.0
    features, state = curation.fit_features(table, roles)
    assert features.count() == 401
    assert features.select([F.sum(F.col(c).isNull().cast("int")).alias(c) for c in state.features]).first().asDict() == {
        c: 0 for c in state.features
    }
    assert not {"AQY_pct", "DOI", "confidence_HER", "host_material", "experiment_hash"} & set(state.features)
    saved = state.save(str(tmp_path / "state"))
    train = features.filter("split = 'train'")
    fitted = learn.fit_ridge(train, state.features, "y", "w")
    members = learn.bootstrap_ridge(train, state.features, "y", F.col("row_id"), 8)
    test_r2 = fitted.transform(features.filter("split = 'test'")).agg(metrics.r2_expr("y", "prediction")).first()[0]
    assert test_r2 > 0.5

    again = curation.FeatureState.load(spark, str(tmp_path / "state"), state.numeric, state.categorical)
    new = experiments(spark, 12).filter("row_id < 12").drop("pH")
    scored = screening.score_rows(new, again, fitted, members)
    rows = scored.collect()
    assert len(rows) == 12 and all(r["p10_log"] <= r["p50_log"] <= r["p90_log"] and r["pred_orig"] >= 0 for r in rows)

    grid = {
        "host_material": ["zno", "cds", "g-c3n4"], "co_catalyst": ["pt", "ni"], "cocatalyst_wt_pct": [0.5, 2.0],
        "glycerol_vol_pct": [10.0, 30.0], "light_source_type": ["visible", "solar"], "catalyst_loading_g_L": [0.5, 1.5],
    }
    reference = train.join(table.select("row_id", roles.target), "row_id")
    result = screening.screen_candidates(spark, saved, members, reference, grid, target=roles.target, n_top=5)
    out = result.table.toPandas()
    assert 0 < len(out) <= 96 and out["novelty_score"].between(0, 1).all()
    # loading and concentration reach the features, so predictions vary within a host/co-catalyst pair
    assert out.groupby(["host_material", "co_catalyst"])["pred_median_log"].nunique().min() > 1
    top = result.top.toPandas()
    assert not top.duplicated(["host_material", "co_catalyst"]).any() and top["ucb_log"].is_monotonic_decreasing
    conformal = screening.screen_candidates(spark, saved, members, reference, grid, q_hat=0.7, n_top=5).table.toPandas()
    assert (conformal["pred_p95_log"] - conformal["pred_p05_log"]).round(9).eq(1.4).all()


def test_duplicates_match_plain_counting(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4), ("b", 5)], "k string, v int")
    assert sorted(r["v"] for r in curate.duplicated_keys(df, ["k"]).collect()) == [1, 2, 4, 5]
    best = curate.keep_best(df, ["k"], "v", ["v"])
    assert sorted(r["v"] for r in best.collect()) == [2, 3, 5]


def test_schema_shaping(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b_reported string, c double")
    assert drop_by_suffix(df, "_reported").columns == ["a", "c"]
    assert drop_by_suffix(df, "_reported", ["b_reported"]).columns == df.columns
    assert alias_columns(df, {"a": "z", "nope": "y", "c": "a"}).columns == ["z", "b_reported", "c"]
    assert reindex(df, ["c", "new"]).first().asDict() == {"c": 2.0, "new": None}
    assert curate.at_least(df, "absent", 3).count() == 1 and curate.multi_filter(df, {"a": []}, {"x": None}).count() == 1


def test_interval_overwrite(spark):
    df = spark.createDataFrame([(1.0,), (-2.0,)], "p double")
    rows = candidates.conformal_rescore(df, "p", 0.5).collect()
    assert [r["ucb_log"] for r in rows] == [1.5, -1.5] and rows[1]["pred_orig"] == 0.0


def test_json_array_with_byte_order_mark(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / ".hidden.csv").write_text("a\n1\n")
    payload = json.dumps([{"a": 1, "s": "x"}, {"a": None, "s": "y"}])
    (folder / "b.json").write_bytes(b"\xef\xbb\xbf" + payload.encode())
    rows = tables.load_raw(spark, str(folder), "a double, s string").orderBy("s").collect()
    assert [(r["a"], r["s"]) for r in rows] == [(1.0, "x"), (None, "y")]
    (folder / "a.csv").write_text("a,s\n2,z\nNaN,w\n")
    first = tables.load_raw(spark, str(folder), "a double, s string", pick="first").orderBy("s").collect()
    assert [(r["a"], r["s"]) for r in first] == [(None, "w"), (2.0, "z")]
    with pytest.raises(ValueError, match="several formats"):
        tables.load_raw(spark, str(folder), "a double, s string")
    upper = tmp_path / "upper"
    upper.mkdir()
    (upper / "A.CSV").write_text("a,s\n5,v\n")
    assert tables.load_raw(spark, str(upper), "a double, s string").first()["a"] == 5.0
    empty = tmp_path / "none"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        tables.load_raw(spark, str(empty))


def test_sinks_guard_their_input(spark, tmp_path):
    df = spark.range(3)
    path = sinks.write_table(df, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        sinks.write_augmented(df, path, path + "/")
    with pytest.raises(ValueError):
        sinks.write_record(df, str(tmp_path / "r"))
    assert tables.read_or_empty(spark, str(tmp_path / "gone"), "id long").count() == 0
    assert tables.read_or_empty(spark, path, "id long").count() == 3


def test_partitioned_tables_and_texts_survive(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", "x"), (2, None, "y"), (4, ' q"u, ', "y")], "id long, t string, part string")
    path = sinks.write_table(df, str(tmp_path / "p"), partition_by=["part"])
    assert tables.read_or_empty(spark, path, df.schema).count() == 3
    assert tables.load_raw(spark, path).count() == 3
    csv = sinks.write_table(df, str(tmp_path / "c"), fmt="csv")
    back = tables.load_raw(spark, csv, df.schema, multi_line=True)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        tables.read_csv(spark, csv, "id long, t string, part string").collect()


def test_fits_do_not_depend_on_partitions(spark):
    rows = [(i, 1e6 + i * 0.5 + (7 if i % 3 else 0), 2.0 * i + (i % 5), 1.0 + i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, y double, w double")
    fits = []
    for parts in (1, 7):
        mom = ridge.moments(df.repartition(parts, "id"), ["x"], "y", "w")
        fit = ridge.solve(mom, mom.total())
        fits.append((fit.coefficients[0], fit.intercept))
    assert fits[0] == pytest.approx(fits[1], rel=1e-9)
    x, y, w = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
    mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
    assert fits[0][0] == pytest.approx((w * (x - mx) * (y - my)).sum() / ((w * (x - mx) ** 2).sum() + 1), rel=1e-9)
    many = learn.bootstrap_ridge(df, ["x"], "y", F.col("id"), 6)
    again = learn.bootstrap_ridge(df.repartition(5, "id"), ["x"], "y", F.col("id"), 6)
    assert [m.coefficients[0] for m in many] == pytest.approx([m.coefficients[0] for m in again], rel=1e-9)


def test_grid_of_values(spark):
    a = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "a string")
    b = spark.createDataFrame([(2.0,), (1.0,), (3.0,)], "b double")
    rows = candidates.grid_of_values(spark, {"one": a, "two": b}).orderBy("row_id").collect()
    assert [(r["row_id"], r["one"], r["two"]) for r in rows] == [(i, "xy"[i // 3], i % 3 + 1.0) for i in range(6)]


def test_stream_scoring_continues_after_restart(spark, tmp_path):
    source, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    fit = ridge.RidgeFit(["x"], [2.0], 1.0)
    for batch in (range(0, 5), range(5, 8)):
        spark.createDataFrame([(i, float(i)) for i in batch], "id long, x double").write.mode("append").parquet(source)
        stream = file_stream(spark, source, "id long, x double")
        score_available(stream, lambda df: learn.score(fit, df), out, offsets)
    rows = spark.read.parquet(out).orderBy("id").collect()
    assert [(r["id"], r["pred_log"]) for r in rows] == [(i, 2.0 * i + 1) for i in range(8)]


def test_paths_are_fresh(spark):
    assert new_path(spark, "x") != new_path(spark, "x")
