"""Personal data: base patterns as written, the field's sums against all segmentations, held-out accuracy."""

import itertools
import math
import random
import re

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridsieve.llm import pii
from gridsieve.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def check_digit(digits):
    total = 0
    for k, c in enumerate(map(int, reversed(digits))):
        total += sum(map(int, str(2 * c))) if k % 2 else c
    return total % 10 == 0


def plain_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and check_digit(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


LOOK = st.lists(st.sampled_from(
    ["a", "b.c", "@", ".", "-", "_", "%", "+", "1", "25", "255", "256", "4532015112830366", " ", "(", ")", "+1 (913) 555-3797", "x@y.z", "1.2.3.4", "é", "\n"]
), max_size=25).map("".join)


@given(LOOK)
@settings(max_examples=500, deadline=None)
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)
    if plain_base(text):
        assert pii.TRIGGER.search(text)


@given(st.lists(st.tuples(st.integers(0, 8), st.integers(1, 5)), min_size=1, max_size=7, unique=True), st.randoms(use_true_random=False))
@settings(max_examples=150, deadline=None)
def test_sums_and_best_equal_all_segmentations(raw, rng):
    spans = sorted({(a, a + n) for a, n in raw}, key=lambda s: (s[1], s[0]))
    scores = np.array([[rng.uniform(-3, 3) for _ in spans] for _ in pii.KINDS])
    weight, total, best = np.zeros_like(scores), 0.0, (-math.inf, None)
    for labels in itertools.product(range(-1, 2), repeat=len(spans)):  # two of the kinds suffice
        chosen = [(k, c) for c, k in enumerate(labels) if k >= 0]
        if any(spans[c][0] < spans[d][1] and spans[d][0] < spans[c][1] for (_, c), (_, d) in itertools.combinations(chosen, 2)):
            continue
        value = sum(scores[k, c] for k, c in chosen)
        best = max(best, (value, tuple(chosen)))
        total += math.exp(value)
        for k, c in chosen:
            weight[k, c] += math.exp(value)
    two = np.where(np.arange(4)[:, None] < 2, scores, -1e9)
    assert np.allclose(pii.marginals(spans, two), weight / total)
    got = pii.best_segments(spans, two)
    assert math.isclose(sum(scores[k, c] for k, c in got), best[0], abs_tol=1e-9)


def test_candidates_leave_fixed_spans_alone():
    text = "call 913-555-3797 or 1.2.3.4 or jane at mail dot com now"
    free = pii.candidates(text).spans
    assert (5, 17) in free and (32, 51) not in free and text.index("jane") in {a for a, _ in free}
    fixed = pii.candidates(text, [(21, 28)]).spans
    assert all(b <= 21 or a >= 28 for a, b in fixed) and (5, 17) in fixed


@pytest.fixture(scope="module")
def learned(spark):
    docs = brute.read(spark, "/root/testdata/sf0.01", "documents")
    found = pii.staged(pii.find_base(docs), "t-pii")
    return found, pii.fit_field(found)


def test_held_out_accuracy(learned):
    """Rewritten data inside prose that the fit has not seen are found, spoilt ones and plain prose are not."""
    _, field = learned
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(["lantern", "of", "river", "at", "gone", "is", "the", "seven", "house"]) for _ in range(n))
    digit = lambda c: next(c + str(k) for k in range(10) if check_digit(c + str(k)))
    card = lambda: digit(f"4{rng.randrange(10**14):014d}")
    make = [
        lambda: f"{rng.choice(['ann', 'bo.li', 'kim'])}{rng.randrange(99)}@{rng.choice(['site', 'post4'])}.example.{rng.choice(['com', 'org'])}",
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), card,
        lambda: f"+{rng.randrange(1, 99)} ({rng.randrange(100, 1000)}) 555-{rng.randrange(10**4):04d}",
    ]
    for kind in range(4):
        hit = wrong = 0
        for _ in range(100):
            left = words(6) + " "
            span = pii.rewritten(kind, make[kind](), rng)
            text = left + span + " " + words(5)
            got = [(k, a, b) for k, a, b, _ in field.find(text)]
            hit += (kind, len(left), len(left) + len(span)) in got or bool(plain_base(span))
            bad = left + pii.spoilt(kind, make[kind](), rng) + " " + words(5)
            wrong += bool(field.find(bad))
        assert hit >= 85 and wrong <= 8, (pii.KINDS[kind], hit, wrong)


def test_clean_documents_are_left_alone(spark, learned):
    found, field = learned
    rows = pii.add_spans(found, field).collect()
    clean = [r for r in rows if not r.base]
    assert len(clean) > 500 and sum(bool(r.added) for r in clean) <= 0.005 * len(clean)


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op13_personal_data"](spark, sf_dir).collect()}
    docs = brute.read(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        r, base = got[d.doc_id], plain_base(d.text or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in range(4)]
        named = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == brute.sha(",".join(named).encode())
        spans = r.spans.split(",") if r.spans else []
        assert set(named) <= set(spans) and len(spans) == len(named) + r.n_added
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)


def test_rewritten_rows_repeats_and_odd_rows(spark, learned):
    _, field = learned
    rows = [*brute.ODD_DOCS, (30, "write to jane.doe at mail dot example dot com today"), (31, "+1 (913) 555-3797 " * 300), (32, "9" * 20_000), (33, "1 " * 9_000)]
    docs = spark.createDataFrame(rows, brute.SCHEMA + "").withColumn("spans", pii.F.lit(3)).withColumn("base", pii.F.lit("x"))
    got = pii.digests(pii.add_spans(pii.find_base(docs), field)).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[30].spans == "email:9:45" and by_id[31].n_phone == 300 and by_id[32].n_card == 0
    assert by_id[2].spans == "" and by_id[2].base_sha256 == brute.sha(b"")


def test_no_base_spans_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "nothing here 12 at all dot com")], brute.SCHEMA)
    assert [tuple(r)[-2:] for r in pii.digests(pii.find_personal_data(docs)).collect()] == [("", 0)]
    assert pii.digests(pii.find_personal_data(brute.empty_docs(spark))).count() == 0
