"""Property lookups and descriptor assembly from dimensions and rule tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsieve.functions.scalars import any_positive, clip
from gridsieve.functions.text import (
    NULL_TOKENS,
    any_keyword,
    joint_keyword,
    keyword_group,
    longest_substring,
    map_lookup,
    strip_lower,
)
from gridsieve.session import new_path
from gridsieve.sources import dims
from gridsieve.sources.sinks import save_state


def dim_lookup(
    df: DataFrame,
    key: str | Column,
    dimension: DataFrame,
    props: Sequence[str],
    prefix: str = "",
    default_key: str = "unknown",
    empty_key: str | None = None,
    matched: str | None = None,
) -> DataFrame:
    """Appends the properties of the normalised key.

    Unmatched keys take the dimension's default row. With ``empty_key`` set, NULL, empty and
    ``nan`` keys take that row instead. ``matched`` adds a flag telling real hits from defaults.
    The join strategy follows from the dimension: constants from ``dims.dim`` are broadcast,
    tables are left to the optimizer and its size statistics.
    """
    norm = strip_lower(key)
    if empty_key is not None:
        norm = F.when(norm.isNull() | norm.isin("", "nan"), F.lit(empty_key)).otherwise(norm)
    fallback = dimension.filter(F.col("key") == default_key).select(F.struct(*props).alias("d")).scalar()
    side = dimension.select(F.col("key").alias("_key"), *[F.col(p).alias(f"_p_{p}") for p in props])
    out = df.withColumn("_norm", norm).join(side, F.col("_norm") == F.col("_key"), "left")
    cols = [F.when(F.col("_key").isNotNull(), F.col(f"_p_{p}")).otherwise(fallback[p]).alias(prefix + p) for p in props]
    if matched:
        cols.append(F.col("_key").isNotNull().alias(matched))
    return out.select(*df.columns, *cols)


def add_physical_features(df: DataFrame, host: str = "host_material", partner: str = "co_catalyst") -> DataFrame:
    """Ten property columns: five ``semi_*`` of the host and five ``cocat_*`` of the co-catalyst."""
    spark = df.sparkSession
    with_host = dim_lookup(
        df, host, dims.semiconductor_props(spark), dims.SEMICONDUCTOR_COLUMNS, "semi_"
    )
    return dim_lookup(
        with_host, partner, dims.cocatalyst_props(spark), dims.COCATALYST_COLUMNS, "cocat_", empty_key="none"
    )


#: Bits of the filter per key, the least and most bits of it as powers of two, places a key sets, and hits a task emits at once.
KEY_BITS, LEAST_BITS, MOST_BITS, HITS = 32, 20, 29, 20_000
_BASE, _MIX = 0x100000001B3, 0xFF51AFD7ED558CCD
_PROBES = [1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93]


class _Hashes:
    """Hashes of a text's windows of any length, from running sums."""

    _powers = _inverse = np.ones(1, np.uint64)

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        n = len(codes)
        if len(_Hashes._powers) <= n:
            steps = [np.r_[np.uint64(1), np.full(2 * n, b % (1 << 64), np.uint64)] for b in (_BASE, pow(_BASE, -1, 1 << 64))]
            _Hashes._powers, _Hashes._inverse = (np.multiply.accumulate(x) for x in steps)
        self.n, self.sums = n, np.zeros(n + 1, np.uint64)
        np.cumsum(codes * _Hashes._powers[:n], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """The hash of the window from each position on."""
        last = self.n - length + 1
        return self._mixed(self.sums[length:] - self.sums[:last], _Hashes._inverse[:last], length)

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return self._mixed(self.sums[starts + length] - self.sums[starts], _Hashes._inverse[starts], length)

    @staticmethod
    def _mixed(h: np.ndarray, inverse: np.ndarray, length: int) -> np.ndarray:
        h = h * inverse + np.uint64(length)
        h = (h ^ h >> np.uint64(33)) * np.uint64(_MIX)
        return h ^ h >> np.uint64(29)


def _head(length: int) -> int:
    """The largest power of two up to a length."""
    return 1 << length.bit_length() - 1


def _places(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (hashes * np.uint64(_PROBES[probe]) >> np.uint64(64 - bits)).astype(np.int64)


class _Filter:
    """Which hashes may be those of a key or of a key's head: a set bit for each probe."""

    def __init__(self, packed: np.ndarray, bits: int):
        self.packed, self.bits = packed, bits

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that pass."""
        left = self._set(hashes, 0)
        for probe in range(1, len(_PROBES)):
            left = left[self._set(hashes[left], probe)]
        return left

    def _set(self, hashes: np.ndarray, probe: int) -> np.ndarray:
        at = _places(hashes, probe, self.bits)
        return np.flatnonzero(self.packed[at >> 3] & self._bit[at & 7])

    _bit = np.array([128 >> i for i in range(8)], np.uint8)


def longest_substring_join(
    df: DataFrame, text: str, dictionary: DataFrame, key: str, value: str, ordinal: str, out: str
) -> DataFrame:
    """Longest-substring lookup against a dictionary table of any size.

    A filter holds the hashes of all keys and of their heads (the first characters, a power of two of them): KEY_BITS bits
    a key, at most 2^MOST_BITS. Texts are scanned where they lie: a window that passes as a head is looked up
    with every key length from there, and what passes again goes on as (digest of the text, piece), once per text. Pieces meet the keys
    by equality, so the filter's size and its false hits never change the result; no text is shuffled. Texts without a key get NULL.
    """
    spark = df.sparkSession
    norm = dictionary.select(
        strip_lower(key).alias("_key"), F.col(value).alias("_value"), F.col(ordinal).alias("_ord")
    ).filter(F.length("_key") > 0)
    keys = save_state(norm, new_path(spark, "dictionary"))
    seen = keys.groupBy(F.length("_key").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per length
    normal = F.coalesce(strip_lower(text), F.lit(""))
    if not seen:
        return df.withColumn(out, F.lit(None).cast(dictionary.schema[value].dataType))
    bits = min(MOST_BITS, max(LEAST_BITS, (KEY_BITS * sum(r["n"] for r in seen) - 1).bit_length()))
    classes: dict[int, list[int]] = {}
    for r in sorted(seen):
        classes.setdefault(_head(r["length"]), []).append(r["length"])

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = np.zeros(1, np.int64)
        for pdf in batches:
            if len(pdf):
                found = [h.at(first, n) for k in pdf["_key"] for h in [_Hashes(k)] for n in {_head(len(k)), len(k)}]
                found = np.concatenate(found)
                yield pd.DataFrame({"place": np.unique(np.concatenate([_places(found, p, bits) for p in range(len(_PROBES))]))})

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, own = pdf["chunk"].iloc[0], np.zeros(1 << bits - 8, bool)
        own[pdf["place"].to_numpy() & (1 << bits - 8) - 1] = True
        return pd.DataFrame({"chunk": [chunk], "bits": [np.packbits(own).tobytes()]})

    places = keys.select("_key").mapInPandas(file, "place long").withColumn("chunk", F.shiftright("place", bits - 8))
    packed = np.zeros((256, 1 << bits - 11), np.uint8)
    for r in places.groupBy("chunk").applyInPandas(unite, "chunk long, bits binary").toLocalIterator():
        packed[r["chunk"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    filter_ = spark.sparkContext.broadcast(packed.ravel())

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marked = _Filter(filter_.value, bits)
        for pdf in batches:
            hits: set[tuple[bytes, str]] = set()
            for i, t in zip(pdf["_id"], pdf["_text"]):
                hashes = _Hashes(t)
                for head, lengths in classes.items():
                    if head > hashes.n:
                        continue
                    starts = marked.passing(hashes.every(head))
                    for n in lengths:
                        here = starts[: np.searchsorted(starts, hashes.n - n, side="right")]
                        if len(here):
                            whole = hashes.at(here, n)
                            passed = marked.passing(whole) if n > head else slice(None)
                            # a piece is cut once
                            hits.update((i, t[p : p + n]) for p in dict(zip(whole[passed].tolist(), here[passed].tolist())).values())
                if len(hits) >= HITS:
                    yield pd.DataFrame(list(hits), columns=["_id", "_key"])
                    hits = set()
            if hits:
                yield pd.DataFrame(list(hits), columns=["_id", "_key"])

    digest = F.unhex(F.sha2(normal, 256))
    texts = df.select(normal.alias("_text")).filter(F.col("_text") != "").withColumn("_id", F.unhex(F.sha2("_text", 256)))
    held = texts.select("_id", "_text").mapInPandas(scan, "_id binary, _key string")
    best = held.join(keys, "_key").groupBy("_id").agg(
        F.min_by("_value", F.struct((-F.length("_key")).alias("l"), F.col("_ord"))).alias(out)
    )
    return df.withColumn("_id", digest).join(best, "_id", "left").select(*df.columns, out)


def sample_weight(
    completeness: str | Column,
    confidences: Sequence[str | Column],
    weights: Mapping[str, float] = dims.CONFIDENCE_WEIGHTS,
    missing: float = 0.5,
    lo: float = 0.1,
    hi: float = 1.0,
) -> Column:
    """Completeness times the confidence weights (case-insensitive labels), clipped to [lo, hi]."""
    base = F.col(completeness) if isinstance(completeness, str) else completeness
    out = F.coalesce(base.cast("double"), F.lit(missing))
    folded = {k.lower(): float(v) for k, v in weights.items()}
    for c in confidences:
        out = out * map_lookup(strip_lower(c), folded, missing)
    return clip(out, lo, hi)


def descriptor_columns(
    host: str | Column = "host_material",
    partner: str | Column = "co_catalyst",
    structure: str | Column = "structure",
    preparation: str | Column = "preparation_photocatalyst",
    surface_columns: Sequence[str] = (),
) -> list[Column]:
    """The nine descriptor columns as map-only expressions."""
    group = keyword_group(partner, dims.COCATALYST_GROUPS, empty_tokens=("", *NULL_TOKENS))
    junction = joint_keyword([structure, preparation], dims.HETEROJUNCTION_KEYWORDS)
    return [
        longest_substring(host, dims.BANDGAP_EV).cast("double").alias("bandgap_ev"),
        longest_substring(host, dims.ELECTRON_AFFINITY_EV).cast("double").alias("electron_affinity_ev"),
        longest_substring(host, dims.ELECTRONEGATIVITY).cast("double").alias("electronegativity"),
        longest_substring(host, dims.IONIC_RADIUS_ANG).cast("double").alias("ionic_radius_ang"),
        longest_substring(host, dims.D_ELECTRON_COUNT).cast("double").alias("crystal_field_d_elec"),
        any_keyword(preparation, dims.DOPING_KEYWORDS).alias("defect_engineering"),
        any_positive(surface_columns).alias("surface_area_proxy"),
        map_lookup(group, dims.COCATALYST_GROUP_ORD, 0).alias("cocatalyst_group_ord"),
        map_lookup(junction, dims.HETEROJUNCTION_ORD, 0).alias("heterojunction_ord"),
    ]


def add_descriptors(clean: DataFrame, features: DataFrame, key: str = "row_id") -> DataFrame:
    """Appends the descriptors computed from the clean table to a feature table, joined on the row key."""
    empty = F.lit(None).cast("string")

    def pick(*names: str) -> str | Column:
        return next((n for n in names if n in clean.columns), empty)

    surface = [c for c in clean.columns if "bet" in c.lower() or "surface_area" in c.lower()]
    described = clean.select(
        key,
        *descriptor_columns(
            pick("host_material"), pick("co_catalyst"), pick("structure"),
            pick("preparation_photocatalyst", "preparation_semiconductor"), surface,
        ),
    )
    return features.join(described, key, "left")
