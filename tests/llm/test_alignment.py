"""Aligned tokens against a plain version without units, caches or blocks."""

from collections import Counter, defaultdict

import brute
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gridsieve.llm import alignment
from gridsieve.llm.common import staged
from gridsieve.llm.queries import PIECE_BPE, QUERIES

B_PATH = public_tokenizers.path(PIECE_BPE)
A = Tokenizer.from_file(brute.JSON)
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=B_PATH)
BYTE = alignment.byte_of_char()


def tokens(text):
    """(id, first byte, byte behind) of both sides, whole texts at once; empty if the bytes differ."""
    if not text:
        return [], []
    whole = (" " + text).encode()
    a_ids, b_ids = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    of_b = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    sides = []
    for ids, data in ((a_ids, [bytes(BYTE[c] for c in A.id_to_token(i)) for i in a_ids]), (b_ids, [of_b(B.id_to_piece(i)) for i in b_ids])):
        if b"".join(data) != whole:
            return [], []
        at, side = 0, []
        for i, d in zip(ids, data, strict=True):
            side.append((i, at, at + len(d)))
            at += len(d)
        sides.append(side)
    return tuple(sides)


def plain(docs):
    per_doc, count = [], Counter()
    for _, text in docs:
        a, b = tokens(text)
        j, links = 0, []
        for i, x, y in a:
            while j and b[j - 1][2] > x:
                j -= 1
            while j < len(b) and b[j][2] <= x:
                j += 1
            while j < len(b) and b[j][1] < y:
                links.append((i, b[j][0]))
                j += 1
        ends = sorted({t[2] for t in a} & {t[2] for t in b})
        at, parts = 0, []
        for e in ends:
            parts.append("|".join(",".join(str(i) for i, x, y in side if at <= x and y <= e) for side in (a, b)) if len(a) < 500 else None)
            at = e
        per_doc.append((len(a), len(b), len(ends), links, ";".join(parts) if None not in parts else None))
        count.update(set(links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [
        (d, na, nb, ng, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), groups)
        for (d, _), (na, nb, ng, links, groups) in zip(docs, per_doc, strict=True)
    ]


def check(got, docs):
    want = plain(docs)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:7] == w[:7]
        assert w[7] is None or g[7] == (brute.sha(w[7].encode()) if w[7] else "")


PIECES = st.lists(st.sampled_from(
    ["the", " ", "  ", "\n", "\t", "a", "'s", "é", "日本", "😀", "Ꙁ", "▁", "<0x41>", "<s>", "<|endoftext|>", "1", "ing", "　", "\xa0", "\x00", "ﬁ", "."]
), min_size=1, max_size=30).map("".join)


@given(PIECES)
@settings(max_examples=300, deadline=None)
def test_units_align_as_whole_texts(text):
    tool = alignment.aligner(brute.JSON, B_PATH)
    units = tool.documents([text])
    counts, _, link = alignment._flat(tool, units)
    a, b = tokens(text)
    assert counts[0, :2].tolist() == [len(a), len(b)]
    links = [(i, j) for i, x, y in a for j, v, w in b if max(x, v) < min(y, w)]
    assert [(p >> 32, p & 0xFFFFFFFF) for p in link.tolist()] == links
    assert counts[0, 2] == len({t[2] for t in a} & {t[2] for t in b})


def test_no_piece_crosses_a_space():
    for i in range(B.vocab_size()):
        assert "▁" not in B.id_to_piece(i).lstrip("▁")


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in brute.read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    check(QUERIES["op12_token_alignment"](spark, sf_dir).collect(), docs)


@pytest.mark.parametrize("block", [200, 1_000_000])
def test_odd_rows_and_blocks(spark, block, monkeypatch):
    rows = brute.odd_docs(spark).select("*", F.lit(1).alias("block"), F.lit(2).alias("n_best"))
    more = [(20, "a▁b and more"), (21, "one unit▁"), (22, "dup dup"), (22, "dup dup"), (23, " lead  and trail  ")]
    rows = rows.select("doc_id", "text").unionAll(spark.createDataFrame(more, brute.SCHEMA)).repartition(3)
    aligned = alignment.align_documents(rows, brute.JSON, B_PATH)
    named = aligned.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    scored = alignment.score_links(staged(named, "t-aligned"))
    check(scored.collect(), brute.ODD_DOCS + more)
    assert "groups" in scored.columns


def test_clashing_columns_and_empty_table(spark):
    rows = brute.odd_docs(spark).select("doc_id", "text", *[F.lit(7).alias(c) for c in ("block", "n_best", "links", "a")])
    assert alignment.align_documents(rows, brute.JSON, B_PATH).where("a IS NULL").count() == len(brute.ODD_DOCS)
    empty = staged(alignment.align_documents(brute.empty_docs(spark), brute.JSON, B_PATH), "t-none")
    assert alignment.score_links(empty).count() == 0
