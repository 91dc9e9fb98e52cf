"""Periodic runs of words: stretches that repeat a short cycle of words three times or more.

The words of a slice of documents become one array of numbers with a separator of its own after every
document, so no comparison crosses a border. Two positions are compared by an oracle of longest common
extensions: a difference cover D of the residues mod SPAN has, for any two positions, a shift below SPAN
that takes both into D; the words before it are compared directly, and behind it the ranks of the two
sampled suffixes give the rest as a minimum over neighbouring common prefixes (a sparse table). Only the
sampled suffixes are sorted, and only those of documents in which a comparison reaches them.

A run of period p and length m covers a point i and i + p for some multiple i of any step up to m - p. So
for each period the points of a grid of step max(least_words - p, (least_periods - 1) p) suffice, n/p points
for period p and n log n in all; each is extended to both sides, and equal stretches keep the smallest
period. Grids are cut into pieces of GRID points, so memory follows the slice, not the number of points.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; repeated rows and
null ids are rows like any other; columns of the input other than the two named are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.common import column, documents, slices

#: A perfect difference set, every residue mod 31 is the difference of two of its members.
SPAN, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Words that are compared before a synchronised sample is looked up.
FEW = 8
#: Grid points examined at once.
GRID = 1 << 20

RUN = "struct<start:long,length:long,period:long>"


def _shifts() -> np.ndarray:
    """[a, b]: smallest shift d >= FEW with both a + d and b + d in the cover (mod SPAN)."""
    member = np.isin(np.arange(SPAN), COVER)
    out = np.full((SPAN, SPAN), -1, np.int16)
    a, b = np.meshgrid(np.arange(SPAN), np.arange(SPAN), indexing="ij")
    for d in reversed(range(FEW, FEW + SPAN)):
        out[member[(a + d) % SPAN] & member[(b + d) % SPAN]] = d
    return out


SHIFTS = _shifts()


def few_words(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common words of s[i:] and s[j:] up to the synchronising shift, and whether they reach it.

    ``s`` ends in padding that equals nothing before it.
    """
    limit = SHIFTS[i % SPAN, j % SPAN].astype(np.int64)
    same = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    for d in range(FEW + SPAN):
        live = live[limit[live] > d]
        live = live[s[i[live] + d] == s[j[live] + d]]
        if not len(live):
            break
        same[live] = d + 1
    return same, same == limit


class Extensions:
    """Longest common extensions of positions of ``s`` whose sampled suffixes lie in ``spans``.

    ``spans`` are disjoint ascending [start, stop) stretches that end in a separator of their own.
    """

    def __init__(self, s: np.ndarray, spans: np.ndarray):
        at = np.concatenate([np.arange(a, b) for a, b in spans]) if len(spans) else np.zeros(0, np.int64)
        self.s, self.samples = s, at[np.isin(at % SPAN, COVER)]
        n = len(self.samples)
        self.index = np.full(len(s) + 1, n, np.int64)  # everything not sampled: the suffix behind the end
        self.index[self.samples] = np.arange(n)
        blocks = s[np.minimum(self.samples[:, None] + np.arange(SPAN), len(s) - 1)]
        order = np.lexsort([blocks[:, k] for k in reversed(range(SPAN))]) if n else np.zeros(0, np.int64)
        new = np.r_[True, (blocks[order[1:]] != blocks[order[:-1]]).any(1)] if n else np.zeros(0, bool)
        del blocks
        rank = np.zeros(n + 1, np.int64)
        rank[order] = np.cumsum(new)  # ranks from 1; 0 for the suffix behind the end
        levels, width = [rank], SPAN
        while n and rank[order[-1]] < n:
            then = rank[self.index[np.minimum(self.samples + width, len(s))]]
            order = np.lexsort((then, rank[:n]))
            a, b = order[:-1], order[1:]
            new = np.r_[True, (rank[a] != rank[b]) | (then[a] != then[b])]
            rank = np.zeros(n + 1, np.int64)
            rank[order] = np.cumsum(new)
            levels.append(rank)
            width *= 2
        self.rank = rank
        self.table = self._sparse(self._neighbours(order, levels))

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common words of each sorted sampled suffix and the one before it."""
        a, b = self.samples[order[:-1]].copy(), self.samples[order[1:]].copy()
        start = a.copy()
        for k in reversed(range(len(levels))):
            x, y = self.index[np.minimum(a, len(self.s))], self.index[np.minimum(b, len(self.s))]
            step = np.where((x != y) & (levels[k][x] == levels[k][y]) & (levels[k][x] > 0), SPAN << k, 0)
            a += step
            b += step
        live = np.arange(len(a))
        last = len(self.s) - 1
        while len(live):
            live = live[self.s[np.minimum(a[live], last)] == self.s[np.minimum(b[live], last)]]
            a[live] += 1
            b[live] += 1
        return a - start

    @staticmethod
    def _sparse(values: np.ndarray) -> list[np.ndarray]:
        table, width = [values], 1
        while 2 * width <= len(values):
            last = table[-1]
            table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        return table

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words of s[i:] and s[j:], both in the cover, i <> j."""
        x, y = self.rank[self.index[i]] - 1, self.rank[self.index[j]] - 1
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            t = self.table[k]
            out[at] = np.minimum(t[low[at]], t[high[at] - (1 << int(k))])
        return out


class Oracle:
    """Common extensions in one direction; the sampled suffixes are sorted when first needed."""

    def __init__(self, s: np.ndarray, spans: np.ndarray):
        self.s, self.spans = s, spans
        self.built: Extensions | None = None

    def few(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return few_words(self.s, i, j)

    def build(self, docs: np.ndarray) -> None:
        self.built = Extensions(self.s, self.spans[docs])

    def rest(self, i: np.ndarray, j: np.ndarray, same: np.ndarray, reached: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(reached)
        out = same.copy()
        if len(at):
            out[at] += self.built.common(i[at] + same[at], j[at] + same[at])
        return out


def _grid(lengths: np.ndarray, least_words: int, least_periods: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of (document, point, period): the points whose extensions hold every run."""
    longest = lengths // least_periods
    longest[lengths < least_words] = 0
    doc = np.repeat(np.arange(len(lengths)), longest)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    step = np.maximum(least_words - period, (least_periods - 1) * period)
    points = -(-(lengths[doc] - period) // step)
    upto = np.cumsum(points)
    at = 0
    while at < len(doc):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + GRID, "right")))
        n = points[at:stop]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(doc[at:stop], n), k * np.repeat(step[at:stop], n), np.repeat(period[at:stop], n)
        at = stop


def find_runs(words: list[list], least_words: int = 24, least_periods: int = 3) -> list[np.ndarray]:
    """Runs of each list of words as rows (start, length, period), by start, then period.

    A run is a stretch in which words p apart are identical, p its smallest period, that neither neighbouring
    word extends, of max(least_words, least_periods p) words or more; least_periods is 2 or more.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    if not (lengths >= least_words).any():
        return [np.zeros((0, 3), np.int64) for _ in words]
    # a separator before the first document and after each one
    s = np.zeros(int(lengths.sum()) + len(words) + 1, np.int64)
    start = np.cumsum(lengths + 1) - lengths
    number = defaultdict(count(len(words) + 3).__next__)
    for at, own in zip(start.tolist(), words, strict=True):
        s[at : at + len(own)] = list(map(number.__getitem__, own))
    s[0], s[start + lengths] = 1, np.arange(2, len(words) + 2)
    n = len(s)
    pad = FEW + SPAN + 1
    forward = Oracle(np.r_[s, np.arange(-pad, 0)], np.column_stack([start, start + lengths + 1]))
    backward = Oracle(np.r_[s[::-1], np.arange(-pad, 0)], np.column_stack([n - start - lengths, n - start + 1]))
    waiting: list = []
    known: list = []

    def settle() -> None:
        need = np.unique(np.concatenate([w[0] for w in waiting])) if waiting else []
        if len(need):
            forward.build(need)
            backward.build(need[::-1])
        for doc, i, period, ahead, more, behind, less in waiting:
            ahead = forward.rest(i, i + period, ahead, more)
            behind = backward.rest(n - i, n - i - period, behind, less)
            good = ahead + behind + period >= np.maximum(least_words, least_periods * period)
            known.append(np.unique(np.column_stack([doc, i - behind, ahead + behind + period, period])[good], axis=0))
        waiting.clear()

    for doc, point, period in _grid(lengths, least_words, least_periods):
        i = start[doc] + point
        hit = np.flatnonzero(s[i] == s[i + period])
        if not len(hit):
            continue
        doc, i, period = doc[hit], i[hit], period[hit]
        ahead, more = forward.few(i, i + period)
        behind, less = backward.few(n - i, n - i - period)
        open_ = more | less
        good = ~open_ & (ahead + behind + period >= np.maximum(least_words, least_periods * period))
        known.append(np.column_stack([doc, i - behind, ahead + behind + period, period])[good])
        waiting.append([x[open_] for x in (doc, i, period, ahead, more, behind, less)])
        if sum(len(w[0]) for w in waiting) > GRID:
            settle()
    settle()
    found = np.concatenate(known) if known else np.zeros((0, 4), np.int64)
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    first = np.r_[True, (found[1:, :3] != found[:-1, :3]).any(1)] if len(found) else np.zeros(0, bool)
    found = found[first]
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    found[:, 1] -= start[found[:, 0]]
    cuts = np.searchsorted(found[:, 0], np.arange(len(words) + 1))
    return [found[a:b, 1:] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def collapse(words: list, runs: np.ndarray) -> list:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


def collapse_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 24, least_periods: int = 3,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """doc_id, n_words, runs array<struct<start,length,period>> (by start, then period) and collapsed, the text
    whose words beyond the first period of a run are dropped, its words joined by one space.

    Words are maximal stretches without ASCII white space. ``rewrite`` may change the words of a document
    before they are searched. Map-only: one pass over the texts, a bounded slice of them at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = column(batch, "doc_id").to_pylist()
            words = [(t or "").encode().split() for t in column(batch, "text").to_pylist()]
            if rewrite is not None:
                words = [rewrite(d, w) for d, w in zip(ids, words, strict=True)]
            runs = find_runs(words, least_words, least_periods)
            listed = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(runs)[:, k], pa.int64()) for k in range(3)], ["start", "length", "period"]
            )
            stops = pa.array(np.r_[0, np.cumsum([len(r) for r in runs])], pa.int32())
            kept = [b" ".join(collapse(w, r)).decode() for w, r in zip(words, runs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([len(w) for w in words], pa.int64()),
                 pa.ListArray.from_arrays(stops, listed), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return documents(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def strongest(runs: str = "runs") -> Column:
    """The run of greatest length / period, compared exactly; ties: smallest start, then period. Null without runs."""
    better = "(x.length * a.period > a.length * x.period)"  # the array is sorted, so a tie keeps the earlier one
    return F.expr(f"aggregate({runs}, CAST(NULL AS {RUN}), (a, x) -> CASE WHEN a IS NULL OR {better} THEN x ELSE a END)")


def digests(collapsed: DataFrame) -> DataFrame:
    """Per document: number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))))
    best = collapsed.withColumn("best", strongest())
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
