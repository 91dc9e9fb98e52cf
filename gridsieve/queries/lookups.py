"""Dimension lookups, keyword rules and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsieve.functions import scalars as S
from gridsieve.functions import text as T
from gridsieve.operators import encode
from gridsieve.operators.lookup import add_descriptors, add_physical_features, dim_lookup, longest_substring_join, sample_weight
from gridsieve.queries.common import query, r, table
from gridsieve.queries.curation import TYPE_PROPS_SQL, labelled, type_props
from gridsieve.sources import dims


@query("c1_dim_lookup_default", f"""
WITH {TYPE_PROPS_SQL}
SELECT p_partkey, coalesce(tp.weight, u.weight) AS semi_weight, coalesce(tp.tier, u.tier) AS semi_tier,
       tp.key IS NOT NULL AS matched
FROM part LEFT JOIN tp ON tp.key = lower(trim(p_type)) JOIN tp u ON u.key = 'unknown'
""")
def c1(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type")
    out = dim_lookup(part, "p_type", type_props(spark), ["weight", "tier"], "semi_", matched="matched")
    return out.select("p_partkey", "semi_weight", "semi_tier", "matched")


@query("c1_dim_lookup_table", """
SELECT o_orderkey, coalesce(c.c_mktsegment, 'MACHINERY') AS dim_c_mktsegment
FROM orders LEFT JOIN customer c ON c.c_custkey::VARCHAR = o_custkey::VARCHAR
""")
def c1_table(spark, d):
    side = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_mktsegment")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    out = dim_lookup(orders, "o_custkey", side, ["c_mktsegment"], "dim_", default_key="0")
    return out.select("o_orderkey", "dim_c_mktsegment")


LABEL_PROPS = [("1", 5.65, 5), ("none", 0.0, 0), ("unknown", 4.9, 3)]


@query("c2_null_default", """
WITH lp(key, work, price) AS (VALUES ('1', 5.65::DOUBLE, 5), ('none', 0.0, 0), ('unknown', 4.9, 3)),
j AS (SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'none' ELSE l.quality::VARCHAR END AS k
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, coalesce(lp.work, u.work) AS cocat_work, coalesce(lp.price, u.price) AS cocat_price
FROM j LEFT JOIN lp ON lp.key = k JOIN lp u ON u.key = 'unknown'
""")
def c2(spark, d):
    side = dims.dim(spark, LABEL_PROPS, "key string, work double, price int")
    out = dim_lookup(labelled(spark, d), "quality", side, ["work", "price"], "cocat_", empty_key="none")
    return out.select("doc_id", "cocat_work", "cocat_price")


def _values(rows):
    def lit(x):
        return "'" + x + "'" if isinstance(x, str) else f"{x}"

    return ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows)


def _materials(spark, d):
    """Host and co-catalyst names spread over the parts by key, with unknown and missing names among them."""
    hosts = [k for k, *_ in dims.SEMICONDUCTOR_PROPS] + ["kryptonite"]
    partners = [k for k, *_ in dims.COCATALYST_PROPS] + ["", "vibranium"]
    size = F.col("p_size")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"), "p_name", "p_type",
        F.upper(F.element_at(F.array(*map(F.lit, hosts)), size % len(hosts) + 1)).alias("host_material"),
        F.element_at(F.array(*map(F.lit, partners)), size % len(partners) + 1).alias("co_catalyst"),
    )


_HOSTS = [k for k, *_ in dims.SEMICONDUCTOR_PROPS] + ["kryptonite"]
_PARTNERS = [k for k, *_ in dims.COCATALYST_PROPS] + ["", "vibranium"]
_MATERIALS_SQL = f"""
m AS (SELECT p_partkey AS row_id, p_name, p_type,
        upper((['{"','".join(_HOSTS)}'])[p_size % {len(_HOSTS)} + 1]) AS host_material,
        (['{"','".join(_PARTNERS)}'])[p_size % {len(_PARTNERS)} + 1] AS co_catalyst FROM part)
"""


@query("c3_physical_features", f"""
WITH {_MATERIALS_SQL},
s(key, {", ".join(dims.SEMICONDUCTOR_COLUMNS)}) AS (VALUES {_values(dims.SEMICONDUCTOR_PROPS)}),
c(key, {", ".join(dims.COCATALYST_COLUMNS)}) AS (VALUES {_values(dims.COCATALYST_PROPS)})
SELECT row_id,
  {", ".join(f"(CASE WHEN s.key IS NULL THEN su.{p} ELSE s.{p} END)::DOUBLE AS semi_{p}" for p in dims.SEMICONDUCTOR_COLUMNS)},
  {", ".join(f"(CASE WHEN c.key IS NULL THEN cu.{p} ELSE c.{p} END)::DOUBLE AS cocat_{p}" for p in dims.COCATALYST_COLUMNS)}
FROM m LEFT JOIN s ON s.key = lower(trim(host_material)) JOIN s su ON su.key = 'unknown'
LEFT JOIN c ON c.key = CASE WHEN lower(trim(co_catalyst)) IN ('', 'nan') THEN 'none' ELSE lower(trim(co_catalyst)) END
JOIN c cu ON cu.key = 'unknown'
""")
def c3(spark, d):
    out = add_physical_features(_materials(spark, d))
    props = [f"semi_{p}" for p in dims.SEMICONDUCTOR_COLUMNS] + [f"cocat_{p}" for p in dims.COCATALYST_COLUMNS]
    return out.select("row_id", *[F.col(p).cast("double").alias(p) for p in props])


# Keys nested in one another, and a tie of equal length ("ring" and "gear" never meet; "old" and "rod" do).
NAME_TABLE = [
    ("ring", 1.0), ("small ring", 2.0), ("rod", 3.0), ("old", 4.0), ("gear", 5.0), ("d gear", 6.0),
    ("large widget", 7.0), ("widget", 8.0), ("hot", 9.0),
]
_NAME_ROWS = [(k, v, i) for i, (k, v) in enumerate(NAME_TABLE)]


@query("c4_longest_substring", f"""
WITH nt(key, value, ord) AS (VALUES {_values(_NAME_ROWS)}),
texts AS (SELECT DISTINCT lower(trim(p_name)) AS t FROM part),
hit AS (SELECT t, value, row_number() OVER (PARTITION BY t ORDER BY length(key) DESC, ord) AS rn
        FROM texts JOIN nt ON contains(t, key))
SELECT p_partkey, value::DOUBLE AS value FROM part LEFT JOIN hit ON t = lower(trim(p_name)) AND rn = 1
""")
def c4(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", T.longest_substring("p_name", NAME_TABLE).cast("double").alias("value")
    )


@query("c4_longest_substring_table", """
WITH tokens AS (SELECT DISTINCT unnest(string_split_regex(lower(url), '[^a-z]+')) AS k FROM pages),
keys AS (SELECT k FROM tokens WHERE k <> '' UNION SELECT DISTINCT lower(p_type) FROM part),
hit AS (SELECT page_id, k, row_number() OVER (PARTITION BY page_id ORDER BY length(k) DESC, k) AS rn
        FROM pages JOIN keys ON contains(lower(trim(url)), k))
SELECT p.page_id, k AS longest_key FROM pages p LEFT JOIN hit ON p.page_id = hit.page_id AND rn = 1
""")
def c4_table(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    tokens = pages.select(F.explode(F.split(F.lower("url"), "[^a-z]+")).alias("k"))
    types = table(spark, d, "part").select(F.lower("p_type").alias("k"))
    # the table order is the alphabetical one; the key itself serves as ordinal
    keys = tokens.union(types).distinct().select("k", F.col("k").alias("value"), F.col("k").alias("ord"))
    out = longest_substring_join(pages, "url", keys, "k", "value", "ord", "longest_key")
    return out.select("page_id", "longest_key")


@query("c4_longest_substring_texts", """
WITH keys AS (SELECT DISTINCT lower(trim(unnest(string_split(p_name, ' ')))) AS k FROM part UNION SELECT lower(text[1:12]) FROM benchmark
  UNION SELECT lower(text[20:40]) FROM benchmark UNION SELECT DISTINCT lower(c_mktsegment) FROM customer UNION SELECT lower(text[1:30]) FROM documents),
kk AS (SELECT DISTINCT trim(k, E' \\t\\n\\r\\x0b\\x0c') AS k FROM keys WHERE k IS NOT NULL AND trim(k, E' \\t\\n\\r\\x0b\\x0c') <> ''),
hit AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY length(k) DESC, k) AS rn
        FROM documents JOIN kk ON contains(lower(text), k))
SELECT d.doc_id, k AS longest_key FROM documents d LEFT JOIN hit ON d.doc_id = hit.doc_id AND rn = 1
""")
def c4_texts(spark, d):
    """Whole documents, of up to 20,000 words, against a dictionary of words and passages of many lengths."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    bench = table(spark, d, "benchmark")
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("k"))
    keys = words.union(bench.select(F.substring("text", 1, 12))).union(bench.select(F.substring("text", 20, 21)))
    keys = keys.union(table(spark, d, "customer").select("c_mktsegment")).union(docs.select(F.substring("text", 1, 30)))
    keys = keys.select(T.strip_lower("k").alias("k")).filter("k <> ''").distinct().select("k", F.col("k").alias("value"), F.col("k").alias("ord"))
    return longest_substring_join(docs, "text", keys, "k", "value", "ord", "longest_key").select("doc_id", "longest_key")


NAME_RULES = [("wid", "panel"), ("ring", "round"), ("ro", "long"), ("old", "aged"), ("ar", "toothed"), ("r", "other_r")]
_CASE_NAME = " ".join(f"WHEN contains(lower(trim(p_name)), '{k}') THEN '{v}'" for k, v in NAME_RULES)


@query("c5_first_keyword", f"""
SELECT p_partkey, CASE WHEN lower(trim(coalesce(p_name, ''))) IN ('', 'nan', 'none', 'null') THEN 'none'
  {_CASE_NAME} ELSE 'unknown' END AS name_group FROM part
""")
def c5(spark, d):
    return table(spark, d, "part").select("p_partkey", T.keyword_group("p_name", NAME_RULES).alias("name_group"))


@query("c6_concat_keyword", """
SELECT p_partkey, CASE WHEN contains(t, 'ring promo') THEN 'both' WHEN contains(t, 'rod') THEN 'rod'
   WHEN contains(t, '/') OR contains(t, 'ge') THEN 'composite' ELSE 'none' END AS joint
FROM (SELECT p_partkey, lower(trim(p_name)) || ' ' || lower(trim(p_type)) AS t FROM part)
""")
def c6(spark, d):
    rules = [("ring promo", "both"), ("rod", "rod")]
    joint = T.joint_keyword(["p_name", "p_type"], rules, separators=("/", "ge"))
    return table(spark, d, "part").select("p_partkey", joint.alias("joint"))


@query("c7_keyword_flag", """
SELECT doc_id, (contains(lower(text), 'dop') OR contains(lower(text), 'carbon') OR contains(lower(text), 'the'))::INT
  AS flagged FROM documents
""")
def c7(spark, d):
    return table(spark, d, "documents").select("doc_id", T.any_keyword("text", ["dop", "carbon", "the"]).alias("flagged"))


@query("c8_any_positive_flag", """
SELECT d.doc_id, (coalesce(try_cast(d.source AS DOUBLE) > 0, FALSE) OR coalesce(l.quality > 0, FALSE)
  OR coalesce(l.toxic > 0, FALSE))::INT AS proxy
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def c8(spark, d):
    return labelled(spark, d).select("doc_id", S.any_positive(["source", "quality", "toxic"]).alias("proxy"))


def _longest_sql(rows, text):
    ordered = sorted(rows, key=lambda kv: -len(kv[0]))
    return "CASE " + " ".join(f"WHEN contains({text}, '{k}') THEN {float(v)}" for k, v in ordered) + " END"


_GROUP_CASE = " ".join(f"WHEN contains(c, '{k}') THEN '{v}'" for k, v in dims.COCATALYST_GROUPS)
_JUNCTION_CASE = " ".join(f"WHEN contains(t, '{k}') THEN '{v}'" for k, v in dims.HETEROJUNCTION_KEYWORDS)


def _ordinal_sql(expr, table_):
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table_.items()) + " ELSE 0 END"


@query("c9_descriptor_assembly", f"""
WITH {_MATERIALS_SQL},
n AS (SELECT row_id, lower(trim(host_material)) AS h, lower(trim(co_catalyst)) AS c,
             lower(trim(p_name)) || ' ' || lower(trim(p_type)) AS t, lower(trim(p_type)) AS prep FROM m)
SELECT row_id,
  ({_longest_sql(dims.BANDGAP_EV, 'h')})::DOUBLE AS bandgap_ev,
  ({_longest_sql(dims.ELECTRON_AFFINITY_EV, 'h')})::DOUBLE AS electron_affinity_ev,
  ({_longest_sql(dims.ELECTRONEGATIVITY, 'h')})::DOUBLE AS electronegativity,
  ({_longest_sql(dims.IONIC_RADIUS_ANG, 'h')})::DOUBLE AS ionic_radius_ang,
  ({_longest_sql(dims.D_ELECTRON_COUNT, 'h')})::DOUBLE AS crystal_field_d_elec,
  ({" OR ".join(f"contains(prep, '{w}')" for w in dims.DOPING_KEYWORDS)})::INT AS defect_engineering,
  0 AS surface_area_proxy,
  {_ordinal_sql(f"CASE WHEN c IN ('', 'none', 'nan', 'null') THEN 'none' {_GROUP_CASE} ELSE 'unknown' END", dims.COCATALYST_GROUP_ORD)}
    AS cocatalyst_group_ord,
  {_ordinal_sql(f"CASE {_JUNCTION_CASE} WHEN contains(t, '/') OR contains(t, '-') OR contains(t, 'composite') OR contains(t, 'hybrid') THEN 'composite' ELSE 'none' END", dims.HETEROJUNCTION_ORD)}
    AS heterojunction_ord
FROM n
""")
def c9(spark, d):
    clean = _materials(spark, d).withColumnsRenamed({"p_name": "structure", "p_type": "preparation_photocatalyst"})
    features = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"))
    return add_descriptors(clean, features)


@query("c10_row_key_join", """
SELECT l.doc_id, l.quality, d.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id
""")
def c10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "quality", "source")


@query("c14_map_weight", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.7 WHEN '3-MEDIUM' THEN 0.3
  ELSE 0.5 END::DOUBLE AS weight FROM orders
""")
def c14(spark, d):
    weights = {"1-URGENT": 1.0, "2-HIGH": 0.7, "3-MEDIUM": 0.3}
    return table(spark, d, "orders").select("o_orderkey", T.map_lookup("o_orderpriority", weights, 0.5).alias("weight"))


@query("c20_column_concat", """
SELECT c_custkey, ln(1 + greatest(c_acctbal, 0)) AS log_balance, upper(c_mktsegment) AS segment,
       length(c_name) AS name_length FROM customer
""".replace("ln(1 + greatest(c_acctbal, 0))", "round(ln(1 + greatest(c_acctbal, 0)), 6)"))
def c20(spark, d):
    c = table(spark, d, "customer")
    left = c.select("c_custkey", r(F.log1p(S.clip("c_acctbal", 0.0, None))).alias("log_balance"))
    right = c.select("c_custkey", F.upper("c_mktsegment").alias("segment"), F.length("c_name").alias("name_length"))
    return left.join(right, "c_custkey")


@query("h1h2h3_text_normalise", """
SELECT row_id, k, coalesce(CASE WHEN k IN ('nan', 'none', 'null') THEN NULL ELSE k END, 'missing') AS filled FROM (
  SELECT p_partkey AS row_id, lower(trim(CASE p_size % 4 WHEN 0 THEN E'\\t' || upper(p_type) || ' '
     WHEN 1 THEN ' NONE ' WHEN 2 THEN 'NaN' ELSE p_type END, E' \\t')) AS k FROM part)
""")
def h1h2h3(spark, d):
    which = F.col("p_size") % 4
    dirty = (
        F.when(which == 0, F.concat(F.lit("\t"), F.upper("p_type"), F.lit(" ")))
        .when(which == 1, F.lit(" NONE ")).when(which == 2, F.lit("NaN")).otherwise(F.col("p_type"))
    )
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"), T.strip_lower(dirty).alias("k"),
        F.coalesce(T.normalise(dirty), F.lit("missing")).alias("filled"),
    )


@query("h4_median_impute", """
WITH j AS (SELECT d.doc_id, d.n_chars::DOUBLE AS n_chars, l.quality::DOUBLE AS quality, l.toxic::DOUBLE AS toxic
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT quantile_cont(n_chars, 0.5) AS n_chars, quantile_cont(quality, 0.5) AS quality,
             quantile_cont(toxic, 0.5) AS toxic FROM j)
SELECT doc_id, coalesce(j.n_chars, m.n_chars) AS n_chars, coalesce(j.quality, m.quality) AS quality,
       coalesce(j.toxic, m.toxic) AS toxic FROM j, m
""")
def h4(spark, d):
    cols = ["n_chars", "quality", "toxic"]
    rows = labelled(spark, d).select("doc_id", *[F.col(c).cast("double").alias(c) for c in cols])
    return encode.apply_medians(rows, encode.fit_medians(rows, cols), cols)


@query("h5h6h7h8_log_clip", """
SELECT event_id, round(ln(1 + value), 6) AS log1p_value,
       round(greatest(exp(value / 100 - 1) - 1, 0), 6) AS back_value,
       least(greatest(value, 1), 100)::DOUBLE AS clipped, round(log10(value + 1), 6) AS log10_value FROM events
""")
def h5h6h7h8(spark, d):
    return table(spark, d, "events").select(
        "event_id", r(F.log1p("value")).alias("log1p_value"),
        r(S.expm1_clipped(F.col("value") / 100 - 1)).alias("back_value"),
        S.clip("value", 1, 100).alias("clipped"), r(F.log10(F.col("value") + 1)).alias("log10_value"),
    )


@query("h9_abs_round_ceil", """
SELECT c_custkey, abs(c_acctbal) AS absolute, ceil(c_acctbal)::BIGINT AS ceiling, round(c_acctbal / 7, 4) AS rounded,
       least(c_acctbal, 100.0)::DOUBLE AS low, greatest(c_acctbal, 100.0)::DOUBLE AS high FROM customer
""")
def h9(spark, d):
    bal = F.col("c_acctbal")
    return table(spark, d, "customer").select(
        "c_custkey", F.abs(bal).alias("absolute"), F.ceil(bal).alias("ceiling"), r(bal / 7, 4).alias("rounded"),
        F.least(bal, F.lit(100.0)).alias("low"), F.greatest(bal, F.lit(100.0)).alias("high"),
    )


@query("h11_composition_label", """
SELECT p_partkey, lower(p_brand) || '/' || lower(p_type) || ' (' || p_retailprice::VARCHAR || ' wt%)' AS label FROM part
""")
def h11(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", S.composition_label(F.lower("p_brand"), F.lower("p_type"), "p_retailprice").alias("label")
    )


@query("h12_confidence_bins", """
SELECT event_id, CASE WHEN rel <= 0.3 THEN 'HIGH' WHEN rel <= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (
  SELECT event_id, CASE WHEN value - 5 > 0 THEN (2 + value / 50) / (value - 5) ELSE 2 + value / 50 END AS rel FROM events)
""")
def h12(spark, d):
    centre, width = F.col("value") - 5, 2 + F.col("value") / 50
    conf = S.cut(S.relative_width(width, centre), [0.3, 0.6], ["HIGH", "MEDIUM", "LOW"])
    return table(spark, d, "events").select("event_id", conf.alias("confidence"))


@query("h13_ordinal_encode", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 2 WHEN 'FURNITURE' THEN 1 ELSE 0 END
  AS code FROM customer
""")
def h13(spark, d):
    codes = {"BUILDING": 3, "MACHINERY": 2, "FURNITURE": 1}
    return table(spark, d, "customer").select("c_custkey", T.map_lookup("c_mktsegment", codes, 0).alias("code"))


@query("h14_label_encode", """
SELECT p_partkey, p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM part
""")
def h14(spark, d):
    return encode.label_encode(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "code")


@query("h15_try_cast", """
SELECT event_id, try_cast(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) IS NULL
  AND event_type IS NOT NULL AS failed FROM events
""")
def h15(spark, d):
    return table(spark, d, "events").select(
        "event_id", S.to_number(F.regexp_extract("props", "[0-9]+", 0)).alias("k"),
        (S.to_number("event_type").isNull() & F.col("event_type").isNotNull()).alias("failed"),
    )


@query("h16_bool_label", """
SELECT vec_id, CASE WHEN label < 5 THEN 'within' ELSE 'outside' END AS side FROM embeddings
""")
def h16(spark, d):
    return table(spark, d, "embeddings").select("vec_id", S.bool_label(F.col("label") < 5, "within", "outside").alias("side"))


@query("h17_sample_weight", """
SELECT o_orderkey, least(greatest(round(c * a * b, 9), 0.1), 1.0)::DOUBLE AS weight FROM (
  SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 0.5 ELSE o_totalprice / 500000 END AS c,
    CASE lower(split_part(o_orderpriority, '-', 2)) WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.3
      ELSE 0.5 END AS a,
    CASE o_orderstatus WHEN 'F' THEN 1.0 ELSE 0.5 END AS b FROM orders)
""")
def h17(spark, d):
    score = F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice") / 500000)
    priority = F.element_at(F.split("o_orderpriority", "-"), 2)
    status = F.when(F.col("o_orderstatus") == "F", F.lit("High"))
    return table(spark, d, "orders").select(
        "o_orderkey", r(sample_weight(score, [priority, status]), 9).alias("weight")
    )


@query("h18h22_ucb_error_bars", """
SELECT event_id, round(value + 1.5 * ((value * 1.2 + 1) - (value * 0.8 - 1)) / 2.0, 6) AS ucb,
       round((value * 1.2 + 1) - value, 6) AS err_hi, round(value - (value * 0.8 - 1), 6) AS err_lo FROM events
""")
def h18h22(spark, d):
    v = F.col("value")
    lo, hi = v * 0.8 - 1, v * 1.2 + 1
    return table(spark, d, "events").select(
        "event_id", r(S.upper_bound(v, lo, hi, 1.5)).alias("ucb"), r(hi - v).alias("err_hi"), r(v - lo).alias("err_lo")
    )


@query("h20_colour_by_substring", f"""
SELECT p_partkey, CASE {_CASE_NAME} ELSE 'grey' END AS colour FROM part
""")
def h20(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", T.first_keyword(T.strip_lower("p_name"), NAME_RULES, F.lit("grey")).alias("colour")
    )


@query("h21_threshold_bands", """
SELECT o_orderkey, CASE WHEN o_totalprice <= 100000 THEN 'minor' WHEN o_totalprice <= 250000 THEN 'moderate'
  ELSE 'strong' END AS band FROM orders
""")
def h21(spark, d):
    band = S.cut("o_totalprice", [100000, 250000], ["minor", "moderate", "strong"])
    return table(spark, d, "orders").select("o_orderkey", band.alias("band"))


@query("h23_one_hot", """
SELECT event_id, (event_type = 'click')::INT AS is_click, (event_type = 'view')::INT AS is_view,
       (event_type = 'error')::INT AS is_error FROM events
""")
def h23(spark, d):
    return table(spark, d, "events").select("event_id", *T.one_hot("event_type", ["click", "view", "error"]))


@query("h24_percent_share", """
SELECT lang, round(100 * avg(CASE WHEN contains(lower(text), 'http') THEN 1.0 ELSE 0.0 END), 4) AS pct
FROM documents GROUP BY lang
""")
def h24(spark, d):
    share = F.avg(T.contains_ci("text", "http").cast("double"))
    return table(spark, d, "documents").groupBy("lang").agg(r(100 * share, 4).alias("pct"))
