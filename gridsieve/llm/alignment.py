"""Alignment of two tokenizers' tokens over the bytes of the same text.

A (a tokenizers file, byte-level) encodes a space and the text; B (a sentencepiece model with byte fallback)
encodes the text and adds that space itself. Coarse cuts come from the libraries: A's character offsets and
the byte spans of B's span records. Where a character is spread over several tokens, or B falls back to
bytes, the libraries give all of them the same span; there the bytes that the tokens decode to refine the cut.

Tokens of neither vocabulary reach from a non-space character over the next space, so a text is cut there
into units (spaces and what follows them); each distinct unit is aligned once and kept in a
bounded cache, and new ones are encoded many at a time. Offsets at which tokens of A and of B both end cut the tokens into groups, and every unit
border is such an offset. A unit whose tokens do not decode to its bytes makes its whole text be encoded
uncut; if that fails too, the text has no tokens.

Counts over the corpus. One pass over the texts gives a row per document and, per block of about a megabyte of
text, a row with the block's distinct linked id pairs and the number of documents that hold each. These
are summed per pair, the greatest sum of each A id is found, and both go back to the blocks that asked; a
block's documents then look their links up. What is shuffled is pairs per block, not links per document, and
a pair found everywhere weighs one row per block.

Defined cases: a null or empty text, or one whose tokens do not decode to it, has no tokens: all counts zero and
no groups; repeated rows count as documents of their own; null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.common import column, documents, slices, staged

#: A space after a character that is no white space, and not the last one, starts a unit.
CUT = re.compile(r"(?<=\S)(?= [\s\S])")
#: New units that are encoded as one text, and units after which the cache starts anew.
JOINED, CACHED_UNITS = 4096, 900_000
SEPARATORS = np.array([",", "|", ";"], object)
#: Bytes of text of one block.
BLOCK = 1_000_000


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters are
    themselves, the others are numbered from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Aligned units by number. ``counts`` has tokens of A, of B and groups of each unit, ``starts`` and ``links`` its linked
    pairs of ids (A's in the upper half), ``groups`` its groups as text."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = SentencePieceProcessor(model_file=b_path)
        byte = byte_of_char()
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(map(byte.__getitem__, n)) if n and set(n) <= byte.keys() else b"" for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(d) for d in side]) for side in (self.a_bytes, self.b_bytes))
        self.decimal = np.array([str(i) for i in range(max(len(names), len(pieces)))], object)
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.counts, self.starts = np.zeros((0, 3), np.int64), np.zeros(1, np.int64)
        self.links, self.groups = np.zeros(0, np.int64), []

    def _ends(self, sizes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Byte at which each token ends. A span that goes beyond all before it and stops where the next one starts is a
        coarse cut; between two cuts the sizes of the decoded bytes decide."""
        before = np.r_[0, np.maximum.accumulate(stops)[:-1]]
        cut = (stops > before) & (stops <= np.r_[starts[1:], stops[-1]])
        last = np.maximum.accumulate(np.where(cut, np.arange(len(cut)), -1))
        upto = np.cumsum(sizes)
        return np.where(last >= 0, stops[last] - upto[last], 0) + upto

    def _spans(self, texts: list[str]) -> list[tuple[np.ndarray, ...] | None]:
        """Per text, which starts with a space: (A's ids, ends, B's ids, ends), or None if its tokens do not decode to it."""
        out: list[tuple[np.ndarray, ...] | None] = []
        encoded = self.a.encode_batch(texts, add_special_tokens=False)
        spans = self.b.encode([t[1:] for t in texts], return_type="proto", num_threads=1)
        for text, of_a, of_b in zip(texts, encoded, spans, strict=True):
            whole = text.encode()
            a_ids = of_a.ids
            pieces = np.array([(p.id, p.begin, p.end) for p in of_b.pieces], np.int64).reshape(-1, 3)
            b_ids = pieces[:, 0].tolist()
            if b"".join(map(self.a_bytes.__getitem__, a_ids)) != whole or b"".join(map(self.b_bytes.__getitem__, b_ids)) != whole:
                out.append(None)
                continue
            chars = np.fromiter(chain.from_iterable(of_a.offsets), np.int64, 2 * len(a_ids)).reshape(-1, 2)
            if len(whole) != len(text):  # A's offsets count characters
                first = np.flatnonzero((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80)
                chars = np.r_[first, len(whole)][chars]
            a, b = np.array(a_ids, np.int64), pieces[:, 0]
            # B's spans are those of the text without the space before it
            b_ends = self._ends(self.b_sizes[b], pieces[:, 1] + 1, pieces[:, 2] + 1)
            out.append((a, self._ends(self.a_sizes[a], chars[:, 0], chars[:, 1]), b, b_ends))
        return out

    def _add(self, spans: tuple[np.ndarray, ...], stops: np.ndarray) -> None:
        """Appends the units of a text that end at the bytes ``stops``."""
        a, a_ends, b, b_ends = spans
        # every stretch between neighbouring ends lies in one token of A and one of B, and every link has one
        every = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        twice = np.r_[every[1:] == every[:-1], False]
        ends, both = every[~twice], every[twice]
        links = a[np.searchsorted(a_ends, ends)] << 32 | b[np.searchsorted(b_ends, ends)]
        per = [np.bincount(np.searchsorted(stops, x), minlength=len(stops)) for x in (a_ends, b_ends, both, ends)]
        self.counts = np.concatenate([self.counts, np.column_stack(per[:3])])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(per[3])])
        self.links = np.concatenate([self.links, links])
        # the ids of a group's tokens of A, then of B, each followed by its separator
        group = np.concatenate([2 * np.searchsorted(both, a_ends), 2 * np.searchsorted(both, b_ends) + 1])
        order = np.argsort(group, kind="stable")
        group = group[order]
        last = np.r_[group[1:] != group[:-1], True]
        parts = np.empty(2 * len(order), object)
        parts[::2] = self.decimal[np.concatenate([a, b])[order]]
        parts[1::2] = SEPARATORS[np.where(last, 1 + group % 2, 0)]
        cuts = np.r_[0, np.cumsum(2 * (per[0] + per[1]))].tolist()
        parts = parts.tolist()
        self.groups += ["".join(parts[x : y - 1]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def _whole(self, text: str) -> int:
        """Number of a text aligned by itself, -1 if its tokens do not decode to it."""
        spans = self._spans([text])[0]
        if spans is None:
            return -1
        self._add(spans, np.array([len(text.encode())]))
        return len(self.groups) - 1

    def _learn(self, new: list[str]) -> None:
        """Units that end in no white space may follow each other, so many are encoded as one text."""
        plain = [u for u in new if not u[-1].isspace()]
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            spans = self._spans(["".join(some)])[0]
            stops = np.cumsum([len(u.encode()) for u in some])
            if spans is None or not (np.isin(stops, spans[1]).all() and np.isin(stops, spans[3]).all()):
                self.index.update((u, self._whole(u)) for u in some)
                continue
            self._add(spans, stops)
            self.index.update(zip(some, range(len(self.groups) - len(some), len(self.groups)), strict=True))
        self.index.update((u, self._whole(u)) for u in new if u[-1].isspace())

    def documents(self, texts: list[str | None]) -> list[list[int]]:
        """Numbers of the aligned units of each text; none if it has no tokens."""
        if len(self.index) > CACHED_UNITS:
            self._reset()
        cut = [CUT.split(" " + t) if t else [] for t in texts]
        self._learn(sorted(set().union(*cut).difference(self.index)))
        out = []
        for text, own in zip(texts, cut, strict=True):
            found = list(map(self.index.__getitem__, own))
            if -1 in found:
                found = [k for k in [self._whole(" " + text)] if k >= 0]
            out.append(found)
        return out


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


FIELDS = {
    "block": "long", "doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string",
    "links": "binary", "a": "array<int>", "b": "array<int>", "n_docs": "array<int>",
}
SCHEMA = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups", pa.string()), ("links", pa.binary()),
    ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n_docs", pa.list_(pa.int32())),
])


def _flat(tool: Aligner, docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts per document (A, B, groups, links), and the document and the pair of every link."""
    unit = np.fromiter(chain.from_iterable(docs), np.int64, sum(map(len, docs)))
    doc = np.repeat(np.arange(len(docs)), [len(own) for own in docs])
    n = tool.starts[unit + 1] - tool.starts[unit]
    counts = np.zeros((len(docs), 4), np.int64)
    for k, values in enumerate([*tool.counts[unit].T, n]):
        counts[:, k] = np.bincount(doc, values, len(docs))
    at = np.arange(int(n.sum())) + np.repeat(tool.starts[unit] - np.cumsum(n) + n, n)
    return counts, np.repeat(doc, n), tool.links[at]


def _links(n: int, doc: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Distinct pairs; per document the numbers of its pairs and how often it holds each; documents per pair."""
    pairs, local = np.unique(link, return_inverse=True)
    code, times = np.unique(doc * len(pairs) + local, return_counts=True)
    pair, times = (code % max(len(pairs), 1)).astype("<u4"), times.astype("<u4")
    cuts = np.searchsorted(code, np.arange(n + 1) * len(pairs))
    per_doc = [pair[x:y].tobytes() + times[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return pairs, per_doc, np.bincount(pair, minlength=len(pairs))


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and a row per block of documents; map-only.

    Document rows: block, doc_id, n_a, n_b, n_groups, n_links, groups ('a1,a2|b1;a3|b2,b3', ids in order, '' without tokens)
    and links (numbers of the pairs that it holds within its block, then how often it holds each; little-endian unsigned
    32-bit integers). Block rows: ``a``, ``b`` and ``n_docs`` of the block's distinct pairs, the other columns null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, budget=BLOCK):
            texts = column(batch, "text").to_pylist()
            aligned = tool.documents(texts)
            n, groups = len(texts), tool.groups
            counts, doc, link = _flat(tool, aligned)
            pairs, links, n_docs = _links(n, doc, link)
            one, ids = lambda values, kind: pa.array([values], pa.list_(kind)), pa.int32()
            columns = [
                pa.array([block] * n), column(batch, "doc_id"), *[pa.array(counts[:, k]) for k in range(4)],
                pa.array([";".join(map(groups.__getitem__, own)) for own in aligned], pa.string()),
                pa.array(links, pa.binary()), *[pa.nulls(n, pa.list_(ids))] * 3,
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=SCHEMA)
            if len(pairs):
                of_pairs = [one(pairs >> 32, ids), one(pairs & 0xFFFFFFFF, ids), one(n_docs, ids)]
                none = [pa.nulls(1, f.type) for f in list(SCHEMA)[1:8]]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *none, *of_pairs], schema=SCHEMA)
            block += 1

    return documents(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in FIELDS.items()))


def score_links(aligned: DataFrame) -> DataFrame:
    """The document rows of ``aligned`` (written; other columns of document rows are handed through) without block and
    links, with n_best (links whose pair is in as many documents as any pair of its A id, ties included) and
    count_sum (the number of documents that hold a link's pair, summed over the links)."""
    blocks = aligned.where("a IS NOT NULL")
    held = blocks.select(F.col("block").alias("asker"), F.posexplode(F.arrays_zip("a", "b", "n_docs")).alias("k", "p")).select("asker", "k", "p.*")
    pairs = held.groupBy("a", "b").agg(F.sum("n_docs").alias("n"))
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    known = staged(pairs.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")
    asked = held.select("asker", "k", "a", "b").join(known, ["a", "b"]).select("asker", "k", "n", "best")
    rows = aligned.where("a IS NULL").drop("a", "b", "n_docs")
    extra = [f for f in rows.schema.fields if f.name not in ("block", "links")]
    names = [f.name for f in extra]

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        at = right.column("k").to_numpy()
        n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy()
        n_best, total = [], []
        for links in left.column("links").to_pylist():
            pair, times = np.frombuffer(links, "<u4").astype(np.int64).reshape(2, -1)
            n_best.append(int(times[best[pair]].sum()))
            total.append(int((times * n[pair]).sum()))
        table = left.select(names)
        return table.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)
    return rows.groupBy("block").cogroup(asked.groupBy("asker")).applyInArrow(look_up, f"{kinds}, n_best long, count_sum long")
