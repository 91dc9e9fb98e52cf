"""Byte-level BPE by longest matches and memoised compatibility of adjacent tokens.

Bytes are mapped to Latin-1 so that one pyahocorasick automaton over the vocabulary finds the longest
token at each position. Encoding walks forward with the longest token, falls back to the next shorter
prefix, and steps back over positions that cannot be continued; a position is tried once, so the work
is linear in the length. Two tokens may stand next to each other only if merging the text across their
border never happens earlier than the merges inside them; that test depends on the pair alone and is
memoised. The unique sequence in which all neighbours are compatible is the one that the merges give.

Defined cases: a null or empty text has no ids and decodes to nothing; a piece that is itself a token
is that token; repeated rows and null ids are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridsieve.llm.common import column, documents, slices
from gridsieve.llm.tokens import UNIT, forget

MEMO_PAIRS = 400_000
END = 1 << 60


class Bpe:
    """Encoder and decoder for a rank file (one base64 token and its rank per line) and a split pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.bytes_of}
        self.halves: dict[int, tuple[int, int] | None] = {}  # the last merge that makes a token; None: a single byte
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = None
            elif (pair := self._last_merge(token, rank)) is not None:
                self.halves[rank] = pair
                self.merged[pair] = rank
        self.automaton = ahocorasick.Automaton()
        for rank in self.halves:
            token = self.bytes_of[rank]
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.shorter = {rank: self._prefix(self.bytes_of[rank]) for rank in self.halves}
        self.memo: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that the merges below ``rank`` leave of ``token``; None if they never meet."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        left, right = self.ranks[parts[0]], self.ranks[parts[1]]
        return (left, right) if max(left, right) < rank else None

    def _prefix(self, token: bytes) -> int | None:
        for n in range(len(token) - 1, 0, -1):
            rank = self.ranks.get(token[:n])
            if rank is not None and rank in self.halves:
                return rank
        return None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side."""
        key = (left, right)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MEMO_PAIRS:
                self.memo.clear()
            known = self.memo[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the merges on both sides of the border, latest first. A merge across the border that
        # comes before the one just undone would have happened instead.
        before = END
        while True:
            if self.merged.get((left, right), END) < before:
                return False
            of_left, of_right = self.halves[left], self.halves[right]
            if of_left is not None and (left > right or of_right is None):
                before, left = left, of_left[1]
            elif of_right is not None:
                before, right = right + 1, of_right[0]  # of two equal merges the left one happens first
            else:
                return True

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        longest: list[int] = [0] * len(data)
        for stop, (rank, length) in self.automaton.iter(data.decode("latin-1")):
            longest[stop - length + 1] = rank  # stops ascend, so the longest comes last
        dead = bytearray(len(data) + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = ids[-1] if ids else None
            while token is not None:
                stop = at + len(self.bytes_of[token])
                if not dead[stop] and (last is None or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token is None:
                dead[at] = 1
                ids.pop()
                at -= len(self.bytes_of[last])
                token = self.shorter[last]
                continue
            ids.append(token)
            at = stop
            if at == len(data):
                return ids
            token = longest[at]

    def encode(self, text: str) -> list[int]:
        cache, units = self.cache, UNIT.findall(text)
        new = list(set(units).difference(cache))
        for unit in new:
            cache[unit] = tuple(chain.from_iterable(self.piece(m.encode()) for m in self.pattern.findall(unit)))
        ids = list(chain.from_iterable(map(cache.__getitem__, units)))
        forget(cache, new)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: every whole text by the rank file at ``path``, which each executor can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in slices(batches):
            ids = [coder.encode(text or "") for text in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data binary: the bytes that ``ids`` stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in batches:
            data = [coder.decode(ids or []) for ids in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.mapInArrow(run, "doc_id long, data binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in slices(batches):
            counts, of_ids, of_bytes = [], [], []
            for text in column(batch, "text").to_pylist():
                ids = coder.encode(text or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            columns = [column(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
