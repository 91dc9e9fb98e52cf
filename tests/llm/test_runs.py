"""Periodic runs against a plain scan of every period."""

import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridsieve.llm import runs
from gridsieve.llm.queries import QUERIES


def plain_runs(words, least_words=24, least_periods=3):
    """Every stretch per period, the smallest period of equal stretches."""
    found = {}
    s = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    for p in range(1, len(s) // least_periods + 1):
        same = np.r_[0, (s[p:] == s[:-p]).astype(int), 0]
        edges = np.flatnonzero(np.diff(same))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a + p >= max(least_words, least_periods * p):
                found.setdefault((int(a), int(b - a + p)), p)
    return sorted((a, n, p) for (a, n), p in found.items())


def plain_row(doc_id, words):
    found = plain_runs(words)
    best = None
    for r in sorted(found, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{a},{n},{p}\n" for a, n, p in sorted(found, key=lambda r: (r[0], r[2])))
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, brute.sha(listed.encode()), brute.sha(kept.encode()))


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def planted(doc_id, words):
    h = zlib.crc32((str(doc_id) if doc_id is not None else "").encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


FEW = st.lists(st.sampled_from("aab"), max_size=90)
CYCLES = st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=12), st.integers(1, 9)), max_size=8).map(
    lambda parts: [w for cycle, times in parts for w in cycle * times]
)


@given(st.lists(FEW | CYCLES, max_size=5), st.sampled_from([(24, 3), (4, 2), (6, 4), (1, 3)]))
@settings(max_examples=200, deadline=None)
def test_runs_equal_a_plain_scan(texts, least):
    assert [[tuple(r) for r in found.tolist()] for found in runs.find_runs(texts, *least)] == [
        sorted(plain_runs(t, *least), key=lambda r: (r[0], r[2])) for t in texts
    ]


@given(st.lists(st.sampled_from("ab"), min_size=50, max_size=400), st.data())
@settings(max_examples=60, deadline=None)
def test_common_extensions(word, data):
    s = np.r_[np.array([ord(c) for c in word]), 1, np.arange(-40, 0)]
    n = len(word)
    oracle = runs.Oracle(s, np.array([[0, n + 1]]))
    oracle.build(np.array([0]))
    i = np.array(data.draw(st.lists(st.integers(0, n - 2), min_size=1, max_size=20)))
    j = np.minimum(i + np.array(data.draw(st.lists(st.integers(1, n), min_size=len(i), max_size=len(i)))), n - 1)
    got = oracle.rest(i, j, *oracle.few(i, j))
    for a, b, m in zip(i, j, got, strict=True):
        assert (s[a : a + m] == s[b : b + m]).all() and s[a + m] != s[b + m]


@pytest.mark.parametrize("grid", [64, 1 << 20])
def test_long_periods_and_bounded_grids(grid, monkeypatch):
    monkeypatch.setattr(runs, "GRID", grid)
    rng = np.random.default_rng(1)
    texts = [[f"w{x}" for x in rng.integers(0, 50, 211)] * 4 + ["end"], ["x"] * 500, [f"w{x}" for x in rng.integers(0, 3, 900)], []]
    texts += [texts[0]] * 2
    assert [list(map(tuple, f.tolist())) for f in runs.find_runs(texts)] == [plain_runs(t) for t in texts]


def test_query(spark, sf_dir):
    got = QUERIES["op11_periodic_runs"](spark, sf_dir).collect()
    docs = brute.read(spark, sf_dir, "documents").select("doc_id", "text").collect()
    want = [plain_row(r.doc_id, planted(r.doc_id, split(r.text))) for r in docs]
    assert sorted(map(tuple, got)) == sorted(want) and sum(r.n_runs > 0 for r in got) > 10


def test_odd_rows_and_empty_table(spark):
    got = runs.digests(runs.collapse_runs(brute.odd_docs(spark))).collect()
    want = [plain_row(d, split(t)) for d, t in brute.ODD_DOCS]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert runs.digests(runs.collapse_runs(brute.empty_docs(spark))).count() == 0
    text = runs.collapse_runs(brute.odd_docs(spark)).where("doc_id = 11").first()
    assert text.collapsed == "ab" and [tuple(r) for r in text.runs] == [(0, 9000, 1)]
