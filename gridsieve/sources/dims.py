"""Embedded constant dimensions: property tables, lookup tables and ordered keyword rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A constant dimension is broadcast up to so many rows and characters.
MAX_BROADCAST_ROWS, MAX_BROADCAST_CHARS = 10_000, 1 << 20

# Host properties
# (key, bandgap_eV, electron_affinity_eV, dielectric, crystal, density).
SEMICONDUCTOR_COLUMNS = ("bandgap_eV", "electron_affinity_eV", "dielectric", "crystal", "density")
SEMICONDUCTOR_PROPS = [
    ("tio2", 3.20, 4.21, 86.0, 1, 3.89),
    ("tio2_p25", 3.15, 4.21, 80.0, 1, 3.90),
    ("zno", 3.37, 4.35, 8.5, 3, 5.61),
    ("cds", 2.42, 4.20, 8.9, 3, 4.82),
    ("g-c3n4", 2.70, 4.30, 3.0, 6, 1.60),
    ("ceo2", 3.10, 4.40, 26.0, 4, 7.22),
    ("wo3", 2.70, 5.24, 42.0, 5, 7.16),
    ("bivo4", 2.40, 3.70, 68.0, 8, 6.83),
    ("fe2o3", 2.10, 5.88, 14.2, 4, 5.24),
    ("srtio3", 3.20, 3.90, 300.0, 7, 5.12),
    ("bi2wo6", 2.80, 3.85, 32.0, 6, 9.00),
    ("la0.2na0.98tao3", 4.00, 3.50, 45.0, 7, 7.80),
    ("pbtio3", 3.40, 3.50, 150.0, 7, 7.99),
    ("zns", 3.54, 3.90, 8.3, 3, 4.09),
    ("cuo", 1.70, 4.07, 18.1, 5, 6.31),
    ("sral2o4", 5.80, 1.50, 9.8, 5, 3.50),
    ("moo3", 2.90, 6.70, 12.5, 6, 4.69),
    ("in2o3", 2.90, 5.00, 9.0, 4, 7.18),
    ("nb2o5", 3.40, 4.30, 41.0, 5, 4.55),
    ("sno2", 3.60, 4.90, 14.0, 4, 6.99),
    ("znin2s4", 2.34, 4.10, 9.2, 6, 3.85),
    ("in2s3", 2.00, 4.20, 13.5, 6, 4.90),
    ("cdse", 1.74, 4.95, 10.6, 3, 5.81),
    ("gan", 3.40, 4.10, 9.7, 3, 6.15),
    ("unknown", 3.00, 4.20, 20.0, 1, 5.00),
]

# Co-catalyst properties
# (key, work_function, d_band_center, atomic_radius, electronegativity, price).
COCATALYST_COLUMNS = ("work_function", "d_band_center", "atomic_radius", "electronegativity", "price")
COCATALYST_PROPS = [
    ("pt", 5.65, -2.25, 139, 2.28, 5),
    ("pd", 5.22, -1.83, 137, 2.20, 5),
    ("au", 5.10, -3.56, 144, 2.54, 5),
    ("ag", 4.26, -4.30, 144, 1.93, 4),
    ("cu", 4.65, -2.67, 128, 1.90, 2),
    ("ni", 5.15, -1.29, 124, 1.91, 2),
    ("co", 5.00, -1.17, 125, 1.88, 2),
    ("fe", 4.67, -0.92, 126, 1.83, 1),
    ("rh", 4.98, -1.73, 134, 2.28, 5),
    ("ir", 5.27, -2.11, 136, 2.20, 5),
    ("ru", 4.71, -1.41, 134, 2.20, 4),
    ("nise2", 4.70, -1.40, 124, 1.91, 2),
    ("nio", 4.90, -1.50, 124, 1.91, 1),
    ("cuo", 4.60, -2.50, 128, 1.90, 1),
    ("rgo", 4.50, 0.00, 77, 2.55, 1),
    ("cos2", 4.80, -1.30, 125, 1.88, 2),
    ("ni2p", 4.90, -1.10, 124, 1.91, 2),
    ("wc", 4.95, -1.60, 139, 2.36, 3),
    ("fes2", 4.74, -0.80, 126, 1.83, 1),
    ("mn", 4.10, -0.50, 127, 1.55, 1),
    ("mos2", 5.00, -1.00, 139, 2.16, 2),
    ("cuox", 4.55, -2.50, 128, 1.90, 1),
    ("niox", 4.85, -1.50, 124, 1.91, 1),
    ("ruo2", 4.71, -1.41, 134, 2.20, 4),
    ("au-pd", 5.16, -2.04, 140, 2.24, 5),
    ("pt-cu", 5.15, -2.46, 133, 2.09, 4),
    ("none", 0.00, 0.00, 0, 0.00, 0),
    ("unknown", 4.90, -2.00, 130, 2.00, 3),
]

# Longest-substring lookup tables, in order (ties go to the earlier entry).
BANDGAP_EV = [
    ("tio2", 3.20), ("anatase tio2", 3.20), ("rutile tio2", 3.03),
    ("zno", 3.37), ("zns", 3.54), ("cds", 2.42),
    ("cdse", 1.74), ("g-c3n4", 2.70), ("c3n4", 2.70),
    ("bi2wo6", 2.75), ("bi2o3", 2.80), ("bivo4", 2.40),
    ("fe2o3", 2.20), ("wo3", 2.60),
    ("nb2o5", 3.40), ("ta2o5", 4.00), ("srtio3", 3.20),
    ("zntio3", 3.10), ("sno2", 3.60), ("in2o3", 2.93),
    ("gan", 3.40), ("gan/zno", 2.70),
    ("zro2", 5.00), ("moo3", 2.90), ("v2o5", 2.24),
    ("cuo", 1.70), ("cu2o", 2.17), ("nife2o4", 2.00), ("cufeo2", 2.40),
    ("zif-8", 5.00), ("mof", 3.50), ("graphene", 0.00),
    ("rgo", 0.00), ("cnt", 0.00), ("carbon", 0.00),
    ("p25", 3.20), ("p-25", 3.20),
]
ELECTRON_AFFINITY_EV = [
    ("tio2", 4.21), ("anatase tio2", 4.21), ("rutile tio2", 4.42),
    ("zno", 4.35), ("zns", 3.90), ("cds", 4.08), ("g-c3n4", 1.40),
    ("c3n4", 1.40), ("bivo4", 3.33), ("fe2o3", 5.88), ("wo3", 5.30),
    ("cu2o", 3.74), ("cuo", 5.30), ("srtio3", 4.17),
]
ELECTRONEGATIVITY = [
    ("tio2", 1.54), ("anatase tio2", 1.54), ("rutile tio2", 1.54),
    ("zno", 1.65), ("zns", 1.65), ("cds", 1.69), ("cdse", 1.69),
    ("g-c3n4", 3.04), ("c3n4", 3.04), ("bivo4", 1.90), ("fe2o3", 1.83),
    ("wo3", 2.36), ("cuo", 1.90), ("cu2o", 1.90), ("srtio3", 1.54),
    ("nb2o5", 1.60), ("ta2o5", 1.50), ("zro2", 1.33), ("v2o5", 1.63),
]
IONIC_RADIUS_ANG = [
    ("tio2", 0.605), ("anatase tio2", 0.605), ("rutile tio2", 0.605),
    ("zno", 0.740), ("zns", 0.740), ("cds", 0.950), ("cdse", 0.950),
    ("fe2o3", 0.645), ("wo3", 0.600), ("bivo4", 1.030), ("nb2o5", 0.640),
    ("ta2o5", 0.640), ("zro2", 0.720), ("srtio3", 1.180), ("cuo", 0.730),
    ("cu2o", 0.770), ("ga2o3", 0.620), ("in2o3", 0.800),
]
D_ELECTRON_COUNT = [
    ("tio2", 0), ("anatase tio2", 0), ("rutile tio2", 0), ("srtio3", 0),
    ("v2o5", 0), ("nb2o5", 0), ("ta2o5", 0), ("zro2", 0),
    ("moo3", 0), ("wo3", 0),
    ("fe2o3", 5), ("nife2o4", 5), ("bivo4", 10), ("cuo", 9), ("cu2o", 10),
    ("cds", 10), ("cdse", 10), ("zno", 10), ("zns", 10),
    ("g-c3n4", -1), ("c3n4", -1), ("carbon", -1), ("graphene", -1),
]

# Ordered keyword rules (the first pattern found in the text wins).
COCATALYST_GROUPS = [
    ("pt", "noble"), ("au", "noble"), ("pd", "noble"), ("rh", "noble"),
    ("ru", "noble"), ("ir", "noble"), ("ag", "noble"),
    ("ni", "earth_abundant"), ("co", "earth_abundant"), ("fe", "earth_abundant"),
    ("cu", "earth_abundant"), ("mn", "earth_abundant"), ("mo", "earth_abundant"),
    ("ni2p", "earth_abundant"), ("mos2", "earth_abundant"), ("wc", "earth_abundant"),
    ("cos2", "earth_abundant"), ("fes2", "earth_abundant"),
    ("nip", "earth_abundant"), ("cop", "earth_abundant"),
    ("rgo", "carbon"), ("graphene", "carbon"), ("cnt", "carbon"),
    ("graphene oxide", "carbon"), ("reduced graphene oxide", "carbon"),
    ("none", "none"),
]
HETEROJUNCTION_KEYWORDS = [
    ("z-scheme", "z_scheme"), ("z scheme", "z_scheme"), ("direct z-scheme", "z_scheme"),
    ("type-ii", "type_ii"), ("type ii", "type_ii"), ("staggered", "type_ii"),
    ("p-n junction", "p_n"), ("pn junction", "p_n"), ("p–n", "p_n"),
    ("homojunction", "homojunction"),
    ("isotype", "isotype"),
]
DOPING_KEYWORDS = [
    "dop", "nitrogen", "sulfur", "carbon", "fluorine", "phosphor", "defect",
    "vacancy", "interstitial", "substitut", "codop", "co-dop",
]

# Ordinal codes and confidence weights.
COCATALYST_GROUP_ORD = {"noble": 3, "earth_abundant": 2, "carbon": 1, "none": 0, "unknown": 0}
HETEROJUNCTION_ORD = {
    "z_scheme": 4, "type_ii": 3, "p_n": 3, "composite": 2, "isotype": 1, "homojunction": 1, "none": 0,
}
CONFIDENCE_WEIGHTS = {"HIGH": 1.0, "MEDIUM": 0.7, "LOW": 0.3}

# Candidate grid and partner lists.
CANDIDATE_GRID = {
    "host_material": [
        "g-c3n4", "bivo4", "bi2wo6", "fe2o3", "wo3", "nb2o5", "ta2o5", "srtio3",
        "cu2o", "ga2o3", "in2o3", "zns", "moo3", "v2o5", "nife2o4",
    ],
    "co_catalyst": [
        "pt", "ni", "cu", "co", "mos2", "ni2p", "rgo", "pd", "au",
        "ru", "rh", "ir", "fe", "mn", "wc", "cos2", "fes2",
    ],
    "cocatalyst_wt_pct": [0.1, 0.5, 1.0, 2.0, 3.0, 5.0],
    "glycerol_vol_pct": [5.0, 10.0, 20.0, 30.0, 50.0],
    "light_source_type": ["visible", "solar", "uv-vis"],
    "catalyst_loading_g_L": [0.5, 1.0, 1.5, 2.0],
}
HETEROJUNCTION_PAIRS = {
    "g-c3n4": ["tio2", "zno", "bivo4", "wo3", "cds", "bi2wo6", "fe2o3"],
    "bivo4": ["tio2", "wo3", "g-c3n4", "fe2o3"],
    "bi2wo6": ["tio2", "g-c3n4", "zno"],
    "fe2o3": ["tio2", "g-c3n4", "zno", "wo3"],
    "wo3": ["tio2", "g-c3n4", "bivo4", "fe2o3"],
    "zno": ["tio2", "g-c3n4", "cds", "wo3"],
    "cds": ["zno", "tio2", "g-c3n4"],
    "srtio3": ["tio2", "g-c3n4", "zno"],
}
CANDIDATE_ALIASES = {
    "cocatalyst_wt_pct": "co_catalyst_wt_pct",
    "glycerol_vol_pct": "glycerol_concentration_v_pct",
}


def dim(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A constant dimension as a DataFrame.

    Marked for broadcast only because its size is known and bounded; a longer list stays an
    ordinary join side whose strategy the optimizer picks.
    """
    df = spark.createDataFrame(list(rows), schema)
    small = len(rows) <= MAX_BROADCAST_ROWS and sum(len(str(v)) for row in rows for v in row) <= MAX_BROADCAST_CHARS
    return F.broadcast(df) if small else df


def semiconductor_props(spark: SparkSession) -> DataFrame:
    return dim(
        spark, SEMICONDUCTOR_PROPS,
        "key string, bandgap_eV double, electron_affinity_eV double, dielectric double, crystal int, density double",
    )


def cocatalyst_props(spark: SparkSession) -> DataFrame:
    return dim(
        spark, COCATALYST_PROPS,
        "key string, work_function double, d_band_center double, atomic_radius int, "
        "electronegativity double, price int",
    )
