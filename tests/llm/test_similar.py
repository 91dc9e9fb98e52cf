"""Near-duplicate groups by candidate fingerprints and exact sets, against brute force."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsieve.llm import similar


def test_keep_one_of_each_group(spark):
    base = [f"w{i}" for i in range(300)]
    near = base.copy()
    near[150] = "changed"
    docs = [(5, " ".join(base)), (6, " ".join(base)), (7, " ".join(near)), (8, " ".join(f"v{i}" for i in range(300))), (8, " ".join(f"v{i}" for i in range(300))), (9, None), (10, "")]
    df = spark.createDataFrame([(*d, 1) for d in docs], brute.SCHEMA + ", extra int")
    kept = similar.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [5, 8, 9]


def shingled(words):
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_keep_one_finds_links_at_the_bound(spark):
    """Pairs between 0.8 and 0.82, where one fingerprint within 11 bits misses many."""
    rng, docs, pairs = np.random.default_rng(4), [], 0
    for k in range(120):
        base = [f"w{k}x{i}" for i in range(400)]
        near = base.copy()
        for at in rng.permutation(np.arange(4, 396, 6))[:60]:
            near[at] = f"n{k}x{at}"
            a, b = shingled(base), shingled(near)
            if len(a & b) / len(a | b) < 0.82:
                break
        assert 0.8 <= len(a & b) / len(a | b) < 0.82
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    kept = [r.doc_id for r in similar.keep_one(spark.createDataFrame(docs, brute.SCHEMA)).collect()]
    assert sorted(kept) == list(range(0, 240, 2))


def test_keep_one_keeps_what_is_less_similar(spark):
    """Pairs a little below 0.8, which an estimate takes for similar."""
    rng, docs = np.random.default_rng(5), []
    for k in range(60):
        base = [f"w{k}x{i}" for i in range(400)]
        near = base.copy()
        for at in rng.permutation(np.arange(4, 396, 6))[:60]:
            near[at] = f"n{k}x{at}"
            a, b = shingled(base), shingled(near)
            if len(a & b) / len(a | b) < 0.8:
                break
        assert 0.77 < len(a & b) / len(a | b) < 0.8
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    kept = [r.doc_id for r in similar.keep_one(spark.createDataFrame(docs, brute.SCHEMA)).collect()]
    assert sorted(kept) == list(range(120))


@pytest.mark.parametrize("block", [4, 32, 256])
def test_exact_components_of_large_candidates(spark, block):
    """A chain, copies of one set with a few changes, and sets like none: one component of candidates."""
    rng, sets = np.random.default_rng(6), []
    chain = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets += [chain[5 * i : 5 * i + 50] for i in range(40)]
    star = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets += [np.concatenate([star[rng.permutation(100)[:95]], rng.integers(0, 2**63, 3, dtype=np.uint64)]) for _ in range(40)]
    sets += [np.concatenate([star[:60], rng.integers(0, 2**63, 40, dtype=np.uint64)]) for _ in range(10)]
    sets = [np.unique(s) for s in sets]
    like = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = brute.smallest(list(range(90)), [(i, j) for i in range(90) for j in range(i) if like(sets[i], sets[j]) >= 0.8])
    rows = spark.createDataFrame([(i, 0, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, component long, set binary")
    label = {r.node: r.label for r in similar.exact_components(rows, 0.8, block).collect()}
    first = {}
    for i in range(90):
        first.setdefault(label[i], i)
    assert [first[label[i]] for i in range(90)] == want


def test_keep_one_tells_rows_of_one_id_apart(spark):
    text = [" ".join(f"w{k}x{i}" for i in range(300)) for k in range(6)]
    near = text[0] + " end"
    docs = [(None, text[0]), (None, text[1]), (None, text[2]), (None, text[2]), (3, near), (4, text[3]), (4, text[4]), (5, text[5])]
    kept = similar.keep_one(spark.createDataFrame(docs, brute.SCHEMA)).collect()
    want = [(None, text[0]), (None, text[1]), (None, text[2]), (4, text[3]), (4, text[4]), (5, text[5])]
    assert sorted((tuple(r) for r in kept), key=str) == sorted(want, key=str)


def exact_kept(docs):
    """doc_ids that stay: smallest id of each component of Jaccard 0.8 or more over sets of five-word shingles."""
    words = [(t or "").encode().lower().split() for _, t in docs]
    sets = [{b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(i, j) for i, s in enumerate(sets) if not s for j in [min(k for k, t in enumerate(sets) if not t)]}
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        pairs |= {(i, j) for j, n in shared.items() if n / (len(s) + len(sets[j]) - n) >= 0.8}
    ids = [d for d, _ in docs]
    return sorted(i for i, c in zip(ids, brute.smallest(ids, pairs), strict=True) if i == c)


def test_kept_ids_equal_an_exact_join(spark):
    rows = brute.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    docs = [tuple(r) for r in rows.collect()]
    assert sorted(r.doc_id for r in similar.keep_one(rows).collect()) == exact_kept(docs)


def test_short_sets_are_linked_exactly(spark):
    rng, docs = np.random.default_rng(3), []
    for k in range(200):
        base = [f"s{k}x{i}" for i in range(int(rng.integers(5, 13)))]
        near = base[:-1] if k % 2 else [*base, "more"]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    got = sorted(r.doc_id for r in similar.keep_one(spark.createDataFrame(docs, brute.SCHEMA)).collect())
    assert got == exact_kept(docs) and len(got) < 400


@pytest.mark.parametrize("chunk", [32, 4096])
def test_buckets_and_pieces_find_the_same_groups(spark, chunk):
    """Small chunks cut tables into buckets by bits, with visitors, and the large group into pieces."""
    rng = np.random.default_rng(8)
    docs = [(i, " ".join(f"a{x}" for x in rng.integers(0, 4000, 60))) for i in range(150)]
    hub = [f"h{i}" for i in range(120)]
    for i in range(150):
        words = hub.copy()
        words[int(rng.integers(0, 120))] = f"z{i}"
        docs.append((1000 + i, " ".join(words)))
    for i in range(0, 150, 5):
        docs.append((2000 + i, docs[i][1] + " and three more words"))
    got = sorted(r.doc_id for r in similar.keep_one(spark.createDataFrame(docs, brute.SCHEMA), chunk=chunk).collect())
    assert got == exact_kept(docs)


def test_contracted_links_connect_the_same_nodes(spark):
    rng = np.random.default_rng(12)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (260, 2))] + [(5, 5)] + [(1, x) for x in range(150, 200)] + [(2, x) for x in range(150, 200)]
    got = [tuple(r) for r in similar.contracted(spark.createDataFrame(pairs, "a long, b long")).collect()]
    assert brute.smallest(list(range(200)), got) == brute.smallest(list(range(200)), pairs) and len(got) < len(pairs)


def test_bucket_links_equal_all_pairs():
    rng = np.random.default_rng(9)
    n = 700
    fps = rng.integers(0, 2**63, (n, 3), dtype=np.uint64)
    for i in range(1, n):
        if i % 3:
            flips = rng.random((3, 64)) < rng.choice([0.01, 0.1, 0.2])
            fps[i] = fps[i - 1] ^ np.packbits(flips, axis=1).view(">u8").ravel().astype(np.uint64)
    home = np.arange(n) % 4 > 0
    bucket = similar.Bucket(np.arange(n), fps[:, 0], fps[:, 1:], home)
    bucket.connect()
    far = np.bitwise_count(fps[:, None] ^ fps[None])
    front = np.bitwise_count((fps[:, None, 0] ^ fps[None, :, 0]) >> np.uint64(48))
    ok = (far.sum(2) <= similar.LIMIT) & (far[..., 0] <= similar.RADIUS) & (front <= similar.LEAD)
    pairs = [(i, j) for i, j in zip(*np.nonzero(ok), strict=True) if i > j and (home[i] or home[j])]
    got = brute.smallest(list(range(n)), list(zip(*bucket.links(), strict=True)))
    assert got == brute.smallest(list(range(n)), pairs) and len(pairs) > 300


def test_clashing_columns_stay(spark):
    names = ["version", "_key", "_version", "node", "row", "label", "component"]
    rows = brute.odd_docs(spark).select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    kept = similar.keep_one(rows)
    assert kept.columns == rows.columns
    found = kept.collect()
    assert all([r[c] for c in names] == list(range(len(names))) for r in found)
    texts = sorted({(str(d), t) for d, t in brute.ODD_DOCS if d not in (2, 3, 4, 9, 8)})
    assert sorted((str(r.doc_id), r.text) for r in found if r.doc_id not in (2, 3, 4, 8)) == texts
    assert similar.keep_one(brute.empty_docs(spark)).count() == 0
