"""Suffix, SimHash and vector near-duplicates, and nearest neighbours, against brute force."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridsieve.llm import components, descent, rangejoin, simhash, suffix, suffixes
from gridsieve.llm.queries import QUERIES

STRINGS = st.lists(st.lists(st.binary(max_size=12).map(lambda b: b"aaaaaaaaab"[: len(b)] + b[:3]), max_size=12), max_size=7)


@given(STRINGS)
@settings(max_examples=200, deadline=None)
def test_loser_tree_merges_front_coded_runs(runs):
    runs = [sorted(r) for r in runs]
    coded = [list(suffixes.decoded(*suffixes.front_code(r))) for r in runs]
    assert [[s for s, _ in r] for r in coded] == runs
    out = list(suffixes.merge_runs(coded))
    assert [s for _, s, _ in out] == sorted(x for r in runs for x in r)
    last = b""
    for _, s, shared in out:
        assert shared == suffixes.common(last, s, 0)
        last = s


def suffix_rows(df):
    return sorted((tuple(r) for r in suffix.digests(suffix.remove_repeats(df)).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_suffix_query(spark, sf_dir):
    docs = brute.read(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in QUERIES["op4_suffix_dedup"](spark, sf_dir).collect())
    assert got == [(d.doc_id, *r) for d, r in zip(docs, brute.repeats([d.text for d in docs]), strict=True)]


def test_suffix_of_odd_rows(spark):
    docs = sorted(set(brute.ODD_DOCS), key=lambda r: (r[0] is not None, r[0] or 0))
    want = {d[0]: r for d, r in zip(docs, brute.repeats([d[1] for d in docs]), strict=True)}
    got = suffix_rows(brute.odd_docs(spark))
    assert got == sorted(((d, *want[d]) for d, _ in brute.ODD_DOCS), key=lambda r: (r[0] is not None, r[0] or 0))
    assert suffix_rows(brute.empty_docs(spark)) == []


@pytest.mark.parametrize("seed", range(3))
def test_suffix_of_random_passages(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(6)]
    docs = []
    for i in range(80):
        parts = [rng.choice(passages)[rng.randint(0, 20) :] if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(30)) for _ in range(rng.randint(0, 6))]
        docs.append((i, "".join(parts) + rng.choice(["", "é" * 60, "z" * 300])))
    got = suffix_rows(spark.createDataFrame(docs, brute.SCHEMA).repartition(5))
    assert got == [(d[0], *r) for d, r in zip(docs, brute.repeats([d[1] for d in docs]), strict=True)]


def test_suffix_frequent_pieces(spark, monkeypatch):
    """The same results whether pieces are counted or taken as frequent, and however small the runs are."""
    docs = [(i, brute.LONG * 2 + str(i) * 40 + brute.LONG[:60]) for i in range(30)]
    df = spark.createDataFrame(docs, brute.SCHEMA)
    want = [(d[0], *r) for d, r in zip(docs, brute.repeats([d[1] for d in docs]), strict=True)]
    assert suffix_rows(df) == want
    assert suffix_rows(df.coalesce(1)) == want


def test_candidates_of_a_frequent_piece_meet_whole():
    """A piece that occurs 5,000 times does not turn its candidates into single strings."""
    rng = random.Random(5)
    records = sorted((bytes(rng.choices(b"abcd", k=120)), i, 7, 3, 1, 5_000) for i in range(50))
    runs = suffix.Runs(suffix._by_range([]), 1, 0)
    runs.records = list(records)
    sent = suffix._merge_suffixes([], 1)((pa.scalar(0),), pa.Table.from_batches(runs.batches(last=True))).to_pylist()
    assert sum(len(zstandard.decompress(r["lengths"])) for r in sent if r["lengths"]) == len(records)


@pytest.mark.parametrize("seed", range(20))
def test_candidates_of_one_piece_settle_alike(monkeypatch, seed):
    """Pair by pair, sorted by distance, or string by string: the same bytes repeat."""
    rng = random.Random(seed)
    piece, group = b"0123456789abcdefghijklmn", []
    for _ in range(12):
        left, right = (b"".join(rng.choices([b"ab" * 4, b"cd" * 4], k=10)) for _ in range(2))
        left = left[-rng.randint(1, 76) :]
        right = right[: rng.randint(76 - len(left), 76)]
        group.append((b"h" * 8 + bytes([len(left)]) + left + piece + right, rng.randint(0, 2), rng.randint(0, 1), rng.randint(0, 2) * 5, 1, 12))
    seen, want = {}, set()
    for s, k, t, at, *_ in sorted(group, key=lambda r: (r[1], r[2], r[3] + r[0][8])):
        for i in range(9, len(s) - 99):
            place = (k, t, at + i - 9)
            if seen.setdefault(s[i : i + 100], place) != place:
                want |= {(k, t, place[2] + j) for j in range(100)}
    for most in (40, 0):
        monkeypatch.setattr(suffix, "ALL_PAIRS", most)
        assert {(k, t, i) for k, t, a, b in suffix._settle_piece(group).tolist() for i in range(a, b)} == want


def test_suffix_of_many_rows_without_an_id(spark):
    """Rows without an id follow each other by a hash of their texts, and are dealt by it."""
    docs = [(None, f"{i} " * 20 + brute.LONG + "z" * i) for i in range(12)] + [(1, brute.LONG + "end"), (1, "another " + brute.LONG)]
    df = spark.createDataFrame(docs, brute.SCHEMA)
    tags = {r.text: r.tag for r in df.select("text", F.xxhash64("text").alias("tag")).collect()}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, tags[d[1]]))
    want = [(d, *r) for (d, _), r in zip(order, brute.repeats([t for _, t in order]), strict=True)]
    assert sorted(suffix_rows(df.repartition(4)), key=str) == sorted(want, key=str)


def test_clean_texts(spark):
    docs = brute.odd_docs(spark)
    got = suffix.clean_texts(docs)
    assert got.columns == docs.columns and got.count() == len(brute.ODD_DOCS)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[2].text is None and rows[3].text == "" and rows[7].text.startswith(brute.LONG) and rows[8].source == "web"
    assert len(rows[8].text) < 150


def simhash_want(docs, k=3, bits=3):
    fps = np.array([brute.fingerprint(t, k) for _, t in docs], np.uint64)
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if int(np.bitwise_count(fps[i] ^ fps[j])) <= bits]
    group = brute.smallest(list(range(len(docs))), pairs)
    least = {g: min((d for (d, _), x in zip(docs, group, strict=True) if x == g and d is not None), default=None) for g in set(group)}
    return sorted(((d, f"{int(f):016x}", least[g]) for (d, _), f, g in zip(docs, fps, group, strict=True)), key=str)


def test_simhash_of_null_and_repeated_ids(spark):
    """Rows without an id, or with the same one, tie no unrelated texts together."""
    text = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(4)]
    docs = [(None, text[0]), (None, text[1]), (5, text[0]), (9, text[1]), (7, text[2]), (7, text[3]), (8, text[3]), (None, "alone here"), (6, text[2])]
    got = simhash.near_duplicates(spark.createDataFrame(docs, brute.SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == simhash_want(docs)
    assert {r.component_id for r in got if r.doc_id in (5, 9)} == {5, 9}


def test_simhash_query_and_odd_rows(spark, sf_dir):
    docs = [tuple(r) for r in brute.read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op9_simhash"](spark, sf_dir).collect()), key=str) == simhash_want(docs)
    got = simhash.near_duplicates(brute.odd_docs(spark)).collect()
    assert sorted((tuple(r) for r in got), key=str) == simhash_want(brute.ODD_DOCS)
    assert simhash.near_duplicates(brute.empty_docs(spark)).count() == 0


@pytest.mark.parametrize("radius,chunk", [(3, 64), (3, 32768), (7, 64), (11, 128)])
def test_gray_index_finds_every_link(spark, radius, chunk):
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2)
    fps = [int(s) for s in seeds]
    for s in seeds:
        for _ in range(8):
            flips = rng.choice(64, rng.integers(0, radius + 4), replace=False)
            fps.append(int(s) ^ sum(1 << int(b) for b in flips))
    fps = sorted(set(fps))
    v = np.array(fps, np.uint64)
    want = brute.smallest(list(range(len(v))), [(i, j) for i in range(len(v)) for j in range(i) if int(np.bitwise_count(v[i] ^ v[j])) <= radius])
    entries = spark.createDataFrame([(i, simhash.signed(f)) for i, f in enumerate(fps)], "node long, fp long")
    found = {r.node: r.component for r in components.components(simhash.links(entries, radius, chunk)).collect()}
    assert [found.get(i, i) for i in range(len(v))] == want


def test_gray_rank_is_the_inverse_gray_code():
    x = np.arange(1 << 12, dtype=np.uint64)
    assert (simhash.gray_rank(x ^ x >> np.uint64(1)) == x).all()


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (5000, 4000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(200)) and got[5000] == 4000
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


ODD_VECTORS = [
    (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.1, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]),
    (6, [float("nan"), 1.0, 0.0]), (7, [None, 1.0, 0.0]), (8, [1.0, -0.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, []),
    (10, [float("inf"), 0.0, 0.0]), (11, [0.0, 1e200, 1e199]), (12, [-1.0, 0.0, 0.0]), (None, [0.0, 0.0, 5.0]), (13, [0.0, 1e-3, 1.0]),
    (14, [1.0, 1.0]), (15, [3.0, 3.1]),
]


def vector_want(rows, least):
    ok = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for _, v in rows]
    unit = [np.array(v) / np.abs(v).max() if o else None for (_, v), o in zip(rows, ok, strict=True)]

    def cos(a, b):
        return (a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum())

    pairs = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and cos(unit[i], unit[j]) >= least]
    group = brute.smallest(list(range(len(rows))), pairs)
    least_id = {g: min((i for (i, _), x in zip(rows, group, strict=True) if x == g and i is not None), default=None) for g in set(group)}
    return sorted(((i, sum(a == k for a, _ in pairs), least_id[g], i == least_id[g]) for k, ((i, _), g) in enumerate(zip(rows, group, strict=True))), key=str)


AWKWARD_IDS = [
    (None, [1.0, 0.0, 0.0]), (None, [0.0, 1.0, 0.0]), (1, [1.0, 0.01, 0.0]), (2, [0.0, 1.0, 0.01]), (7, [0.0, 0.0, 1.0]), (7, [1.0, 1.0, 0.0]),
    (8, [0.0, 0.01, 1.0]), (9, [1.0, 1.01, 0.0]), (None, [-1.0, 0.0, 0.0]), (None, [-1.0, 0.0, 0.0]), (7, [1.0, 1.0, 0.0]),
]
LARGE = [(1, [1e200, 0.0]), (2, [0.95005e200, 0.3121e200]), (3, [1.0, 0.0]), (4, [0.95005, 0.3121]), (5, [1e-200, 0.0])]


@pytest.mark.parametrize("rows", [AWKWARD_IDS, LARGE])
def test_range_join_of_null_and_repeated_ids_and_large_components(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in rangejoin.near_vectors(df, 0.95).collect()), key=str) == vector_want(rows, 0.95)


@pytest.mark.parametrize("wanted", [1, 7, 40])
def test_range_join_with_any_number_of_pivots_and_blocks(spark, wanted, monkeypatch):
    monkeypatch.setattr(rangejoin, "_pivots", lambda drawn, n, r, block: drawn[:wanted])
    monkeypatch.setattr(rangejoin, "BLOCK", 64)
    monkeypatch.setattr(rangejoin, "BLOCK_LEAST", 16)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(9, 6))
    rows = [(i, (centres[i % 9] + rng.normal(size=6) * rng.choice([0.02, 0.4])).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in rangejoin.near_vectors(df, 0.9).collect()), key=str) == vector_want(rows, 0.9)


def test_nearest_of_null_and_repeated_ids(spark):
    rows = [(100, [0.0, 0.1]), (7, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [3.0, 0.0]), (9, [4.0, 0.0]), (None, [5.0, 0.0]), (None, [6.0, 0.0]), (100, [9.0, 0.0])]
    df = spark.createDataFrame([*rows, rows[1]], "vec_id long, embedding array<double>")
    got = descent.search_nearest(df, F.col("vec_id") == 100, 10).collect()
    want = []
    for q in (rows[0], rows[-1]):
        d = sorted((np.sqrt(((np.array(v) - np.array(q[1])) ** 2).sum()), i) for i, (_, v) in enumerate(rows) if v != q[1])
        want += [(100, k + 1, rows[i][0], float(x)) for k, (x, i) in enumerate(d)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_range_join_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, "x") for r in ODD_VECTORS], "vec_id long, embedding array<double>, cell string")
    got = rangejoin.near_vectors(df, 0.95).collect()
    assert sorted((tuple(r) for r in got), key=str) == vector_want(ODD_VECTORS, 0.95)
    assert rangejoin.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.5, 0.95])
def test_range_join_of_random_rows(spark, least):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * rng.choice([0.02, 0.3, 1.0])).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in rangejoin.near_vectors(df, least).collect()), key=str) == vector_want(rows, least)


def test_range_join_query(spark, sf_dir):
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in brute.read(spark, sf_dir, "embeddings").collect()]
    assert sorted((tuple(r) for r in QUERIES["op5_range_join"](spark, sf_dir).collect()), key=str) == vector_want(rows, 0.95)


def recall(got, rows, k, step):
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    hit = total = 0
    for q in ids[ids % step == 0]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))][: min(k, len(ids) - 1)]
        assert [r["rank"] for r in mine] == list(range(1, len(best) + 1))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - d[ids == r.vec_id][0]) < 1e-9 for r in mine)
        hit += len(set(best) & {r.vec_id for r in mine})
        total += len(best)
    return hit / total


def test_nearest_query(spark, sf_dir):
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in brute.read(spark, sf_dir, "embeddings").collect()]
    assert recall(QUERIES["op7_nn_descent"](spark, sf_dir).collect(), rows, 10, 100) >= 0.9


def test_nearest_of_random_rows_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[5][1]) for i in range(40)] + [(4000, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = descent.search_nearest(df, F.col("vec_id") % 250 == 0, 10).collect()
    assert recall(got, rows, 10, 250) >= 0.9
    copies = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 3000 and r.score == 0)
    assert [v for _, v in copies] == [5, *range(3001, 3010)]


def test_nearest_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, "x") for r in ODD_VECTORS], "vec_id long, embedding array<double>, d string")
    got = descent.search_nearest(df, F.col("vec_id") % 4 == 0, 10).collect()
    assert {r.query_id for r in got} <= {8, 12, None}
    assert not {r.vec_id for r in got} & {4, 5, 6, 7, 9, 10, 14, 15}
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 8), key=lambda r: r["rank"])][0] == 1
    assert descent.search_nearest(df.limit(0), F.col("vec_id") % 4 == 0).count() == 0
