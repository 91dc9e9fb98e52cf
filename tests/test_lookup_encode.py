"""Lookup edge cases and encoders."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridsieve.functions import scalars as S
from gridsieve.functions import text as T
from gridsieve.operators import encode
from gridsieve.operators.lookup import add_physical_features, dim_lookup, longest_substring_join, sample_weight
from gridsieve.sources import dims


def one(spark, value, col):
    return spark.createDataFrame([(value,)], "s string").select(col.alias("out")).first()["out"]


@pytest.mark.parametrize("text,want", [
    ("zno-zns", 3.37), ("Rutile TiO2 film", 3.03), ("\ttio2 ", 3.20), ("cdse", 1.74), ("xyz", None), (None, None),
    ("wо3", None), ("GaN/ZnO", 2.70),
])
def test_longest_substring(spark, text, want):
    assert one(spark, text, T.longest_substring("s", dims.BANDGAP_EV)) == want
    rows = [(k, v, i) for i, (k, v) in enumerate(dims.BANDGAP_EV)]
    table = spark.createDataFrame(rows, "k string, v double, o int")
    df = spark.createDataFrame([(text,)], "s string")
    assert longest_substring_join(df, "s", table, "k", "v", "o", "out").first()["out"] == want


def test_table_keys_are_ascii():
    tables = (dims.BANDGAP_EV, dims.ELECTRON_AFFINITY_EV, dims.ELECTRONEGATIVITY, dims.IONIC_RADIUS_ANG, dims.D_ELECTRON_COUNT)
    assert all(k.isascii() for t in tables for k, _ in t)
    assert len(dims.SEMICONDUCTOR_PROPS) == 25 and len(dims.COCATALYST_PROPS) == 28
    assert math.prod(len(v) for v in dims.CANDIDATE_GRID.values()) == 91_800


@pytest.mark.parametrize("text,want", [
    (None, "none"), ("NaN", "none"), ("Pt", "noble"), ("cobalt", "earth_abundant"), ("graphene", "carbon"), ("xyz", "unknown"),
])
def test_keyword_group_follows_rule_order(spark, text, want):
    assert one(spark, text, T.keyword_group("s", dims.COCATALYST_GROUPS)) == want


@pytest.mark.parametrize("text,want", [
    ("sol-gel", "composite"), ("direct Z-scheme", "z_scheme"), ("plain", "none"), (None, "none"), ("p–n", "p_n"),
])
def test_joint_keyword(spark, text, want):
    assert one(spark, text, T.joint_keyword(["s", F.lit(None).cast("string")], dims.HETEROJUNCTION_KEYWORDS)) == want


def test_property_defaults(spark):
    rows = [("TiO2", "Pt"), ("nope", None), (None, ""), ("zno ", "nan"), ("zno", "nope"), ("zno", "none")]
    out = add_physical_features(spark.createDataFrame(rows, "host_material string, co_catalyst string"))
    got = [(r["semi_bandgap_eV"], r["cocat_work_function"]) for r in out.collect()]
    assert got == [(3.2, 5.65), (3.0, 0.0), (3.0, 0.0), (3.37, 0.0), (3.37, 4.9), (3.37, 0.0)]
    flagged = dim_lookup(
        spark.createDataFrame([("x",), ("zno",)], "h string"), "h", dims.semiconductor_props(spark), ["density"], matched="hit"
    )
    assert [r["hit"] for r in flagged.collect()] == [False, True]


def test_sample_weight_is_case_insensitive_and_clipped(spark):
    rows = [(1.0, "HIGH", "high"), (1.0, "Medium", "LOW"), (None, "HIGH", None), (0.1, "low", "low"), (5.0, "high", "high")]
    df = spark.createDataFrame(rows, "m double, a string, b string")
    got = [r["w"] for r in df.select(sample_weight("m", ["a", "b"]).alias("w")).collect()]
    assert got == pytest.approx([1.0, 0.21, 0.25, 0.1, 1.0])


def test_scalars(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,), ("-2",)], "s string")
    assert [r[0] for r in df.select(S.to_number("s")).collect()] == [1.5, None, None, None, -2.0]
    assert [r[0] for r in df.select(S.any_positive(["s"])).collect()] == [1, 0, 0, 0, 0]
    nums = spark.createDataFrame([(0.2,), (0.3,), (0.6,), (0.7,), (None,)], "x double")
    assert [r[0] for r in nums.select(S.cut("x", [0.3, 0.6], ["HIGH", "MEDIUM", "LOW"])).collect()] == [
        "HIGH", "HIGH", "MEDIUM", "LOW", None,
    ]
    assert nums.select(S.clip("x", 0.25, 0.65)).collect()[-1][0] is None


def te_frame(spark):
    rng = np.random.default_rng(0)
    cats = rng.choice(["a", "b", "c"], 300, p=[0.7, 0.25, 0.05])
    y = rng.normal(1e4, 1, 300) + (cats == "a")
    pdf = pd.DataFrame({"id": range(300), "cat": cats, "y": y, "fold": np.arange(300) % 5})
    return pdf, spark.createDataFrame(pdf)


def shrunk(y, g):
    lam = len(y) * g.var() / (len(y) * g.var() + y.var())
    return lam * y.mean() + (1 - lam) * g.mean()


def test_target_encoding_matches_formula(spark):
    pdf, df = te_frame(spark)
    fitted = encode.fit_target_encoding(df, "cat", "y").toPandas().set_index("cat")["encoding"]
    for c, part in pdf.groupby("cat"):
        assert fitted[c] == pytest.approx(shrunk(part["y"].to_numpy(), pdf["y"].to_numpy()), rel=1e-10)
    got = encode.cross_fit_target_encoding(df, "cat", "y", "fold", "te").toPandas().set_index("id")["te"]
    for i in (0, 7, 123):
        rest = pdf[pdf["fold"] != pdf.loc[i, "fold"]]
        same = rest[rest["cat"] == pdf.loc[i, "cat"]]["y"].to_numpy()
        assert got[i] == pytest.approx(shrunk(same, rest["y"].to_numpy()), rel=1e-10)


def test_cross_fit_ignores_own_fold(spark):
    pdf, df = te_frame(spark)
    changed = df.withColumn("y", F.when(F.col("fold") == 2, F.col("y") + 50).otherwise(F.col("y")))
    a = encode.cross_fit_target_encoding(df, "cat", "y", "fold", "te").filter("fold = 2").orderBy("id").toPandas()
    b = encode.cross_fit_target_encoding(changed, "cat", "y", "fold", "te").filter("fold = 2").orderBy("id").toPandas()
    np.testing.assert_allclose(a["te"], b["te"], rtol=1e-12)


def test_unseen_and_single_fold_categories(spark):
    pdf, df = te_frame(spark)
    fitted = encode.fit_target_encoding(df, "cat", "y")
    new = spark.createDataFrame([("zzz",), (None,)], "cat string")
    got = [r["te"] for r in encode.apply_target_encoding(new, fitted, "cat", "te").collect()]
    assert got == pytest.approx([pdf["y"].mean()] * 2)
    lone = df.withColumn("cat", F.when(F.col("id") == 5, F.lit("only")).otherwise(F.col("cat")))
    te = encode.cross_fit_target_encoding(lone, "cat", "y", "fold", "te").filter("id = 5").first()["te"]
    assert te == pytest.approx(pdf[pdf["fold"] != 0]["y"].mean(), rel=1e-10)


def test_label_codes_are_alphabetical(spark):
    values = [f"v{i % 37:02d}" for i in range(400)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = {r["s"]: r["code"] for r in encode.label_encode(df, "s", "code").distinct().collect()}
    assert got == {**{f"v{i:02d}": i for i in range(37)}, None: None}
