"""Repeated passages: removes every byte of a 100-byte string that also starts earlier.

All 100-byte strings of all texts are decided, in order of (doc_id, start), by a distributed merge sort:

1. Every string belongs to the one of its 24-byte pieces with the smallest hash (the leftmost of equal ones),
   which depends on the string alone; neighbouring strings share their piece. Strings that are equal share it
   too, so where a piece's hash occurs once, nothing repeats. The rest are candidates: ranges of starts, each
   the suffix of its text at the first start, long enough for the strings of the range.
2. Tasks sort their candidates, front-code the sorted runs and exchange them by key range; loser trees merge
   them without comparing known common prefixes again. In the merged order, equal neighbours are repeats,
   of which the earliest stays.
3. A candidate that stays may still share a part with a different one (at the edges of a passage). If its
   piece occurs elsewhere, sorted runs of such candidates are exchanged by piece and merged; those that share a piece
   are laid upon each other there and compared, or, if they are many, their 100-byte strings are sorted. For a piece
   that very many share, the strings are exchanged by range and merged one by one.

Equal strings are combined inside each run first, so a passage held by a third of all texts reaches a merge
once per run. Pieces that are very frequent inside one task are not counted but taken as repeated. Texts are
shuffled once, by document; both joins that need them use that exchange.

Defined cases: a null text is empty; a null id stays null and comes first; rows equal in id and text are one
document, and each gets its result; rows that share an id but not the text follow each other by a hash of
the text; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.common import NULL_ID, column, default_partitions, documents, slices
from gridsieve.llm.suffixes import common, decoded, front_code, merge_runs, part_of

LENGTH = 100
PIECE = 24
#: A piece that occurs more often in what one task holds is not counted.
FREQUENT = 64
HELD = 600_000  # candidates a task collects before it sends them on
RUN = 60_000  # strings of one sorted run
GROUP = 20_000  # candidates with one piece that may meet in one place
#: Bytes of text of a key range or bucket, and texts per range that show where to cut, 400 at least.
PART_BYTES, SAMPLED = 64 << 20, 16
U64 = np.uint64
POSITION = 20
MASK = U64((1 << POSITION) - 1)
STEP = 1 << 15  # starts whose pieces are found at once
ALL_PAIRS = 40  # candidates of one piece that are compared pair by pair
MERGED = 20_000  # strings of a merge that are decided at once


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes at each position."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    n = len(data) - PIECE + 1
    h = words[:n] * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    h += words[8 : n + 8]
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    h += words[16 : n + 16]
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def candidates(data: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """For each start the hash of its piece, above the piece's place behind the returned position, in pieces of ``data``.

    ``data`` may join several texts; ranges that cross a border are the caller's to cut (see ranges_of).
    """
    for at in range(0, len(data) - LENGTH + 1, STEP):
        h = piece_hashes(data[at : at + STEP + LENGTH - 1])
        h &= ~MASK
        h |= np.arange(len(h), dtype=U64)
        wide, n = h, 1
        width = LENGTH - PIECE + 1
        while 2 * n <= width:
            wide = np.minimum(wide[:-n], wide[n:])
            n *= 2
        if width > n:
            wide = np.minimum(wide[: len(wide) - (width - n)], wide[width - n :])
        yield wide, at


def ranges_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """hash, text index, first start, last start and start of the piece of every candidate range of some texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = []
    if len(data) >= LENGTH:
        for wide, at in candidates(data):
            change = np.empty(len(wide), bool)
            change[0] = True
            np.not_equal(wide[1:], wide[:-1], out=change[1:])
            borders = ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + len(wide))] - at
            change[borders] = True
            first = np.flatnonzero(change)
            owner = np.searchsorted(ends, at + first, side="right")
            # borders cut off the tail of a range, never its middle
            last = np.minimum(np.r_[first[1:], len(wide)] - 1, ends[owner] - LENGTH - at)
            keep = last >= first
            first, last, owner = first[keep], last[keep], owner[keep]
            begin, piece = at - (ends - lengths)[owner], wide[first]
            found.append((piece >> U64(POSITION), owner, first + begin, last + begin, (piece & MASK).astype(np.int64) + begin))
    if not found:
        return tuple(np.zeros(0, t) for t in (U64, *[np.int64] * 4))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


# Candidates of one task in one bucket: parallel arrays over documents and over ranges.
_BUCKETS = "bucket int, counted boolean, docs array<long>, tags array<long>, ranges binary"
_BUCKET_NAMES = [c.split()[0] for c in _BUCKETS.split(", ")]
_LONGS = pa.list_(pa.int64())
_BUCKET_TYPES = [pa.int32(), pa.bool_(), _LONGS, _LONGS, pa.binary()]


def _row(names, types, values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)


def _packed_ranges(h: np.ndarray, owner: np.ndarray, first: np.ndarray, span: np.ndarray) -> bytes:
    """Hashes (44 bits), owners (-1: a marker, last), first starts and spans of ranges in the order of their texts."""
    steps = np.diff(first, prepend=0)
    parts = ((h & U64(0xFFFFFFFF)).astype("<u4"), (h >> U64(32)).astype("<u2"), np.diff(owner, prepend=0).astype("<i4"), steps.astype("<i4"))
    return zstandard.compress(b"".join(len(x).to_bytes(4, "little") + x.T.tobytes() for x in (*map(_planes, parts), _planes(span.astype(np.uint8)))), 1)


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of an array of numbers, first bytes together, then second ones: like compresses with like."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)


def _unpacked_ranges(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, out, at = zstandard.decompress(data), [], 0
    for t in ("<u4", "<u2", "<i4", "<i4", "u1"):
        n, size = int.from_bytes(data[at : at + 4], "little"), np.dtype(t).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at + 4).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(t).ravel())
        at += 4 + n * size
    low, high, owner, first, span = out
    return low.astype(U64) | high.astype(U64) << U64(32), np.cumsum(owner.astype(np.int64)), np.cumsum(first.astype(np.int64)), span.astype(np.int64)


def _bucketed(buckets: int):
    """Candidate ranges by bucket of their hash; one marker stands for a piece that is frequent in the task."""

    def send(docs: list, tags: list, parts: list) -> Iterator[pa.RecordBatch]:
        h, owner, first, last = (np.concatenate(c) for c in zip(*parts, strict=True))
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        frequent = counts[inverse] > FREQUENT
        marker = np.unique(h[frequent])

        def rows(number: int, counted: bool, some: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
            used, own = np.unique(owner[some], return_inverse=True)
            return _row(_BUCKET_NAMES, _BUCKET_TYPES, [
                number, counted, [docs[i] for i in used], [tags[i] for i in used],
                _packed_ranges(
                    np.concatenate([h[some], marks]), np.concatenate([own, np.full(len(marks), -1)]), first[some], (last - first)[some]
                ),
            ])

        # sorted by bucket once, so that the work does not grow with their number
        rare = np.flatnonzero(~frequent)
        of, of_mark = (h[rare] % U64(buckets)).astype(np.int64), (marker % U64(buckets)).astype(np.int64)
        rare, marker = rare[np.argsort(of, kind="stable")], marker[np.argsort(of_mark, kind="stable")]
        ends, mark_ends = (np.cumsum(np.bincount(x, minlength=buckets)) for x in (of, of_mark))
        for number in range(buckets):
            some = rare[ends[number - 1] if number else 0 : ends[number]]
            marks = marker[mark_ends[number - 1] if number else 0 : mark_ends[number]]
            if len(some) or len(marks):
                yield rows(number, True, some, marks)
        some = np.flatnonzero(frequent)
        if len(some):
            yield rows(TaskContext.get().partitionId() % buckets, False, some, np.zeros(0, U64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, tags, parts, held = [], [], [], 0
        for batch in slices(batches):
            texts = [t.encode() if t else b"" for t in column(batch, "text").to_pylist()]
            h, owner, first, last, _ = ranges_of(texts)
            parts.append((h, owner + len(docs), first, last))
            docs += column(batch, "key").to_pylist()
            tags += column(batch, "tag").to_pylist()
            held += len(h)
            if held >= HELD:
                yield from send(docs, tags, parts)
                docs, tags, parts, held = [], [], [], 0
        if held:
            yield from send(docs, tags, parts)

    return run


_REPEATED = "key long, tag long, first array<int>, span array<int>, times array<int>"


def _repeated(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Of a bucket's candidates those whose piece occurs again, by document; times: its occurrences, -1 unknown."""
    docs, tags, h, owner, first, span, times = [], [], [], [], [], [], []
    at = 0
    for r in rows.to_pylist():
        hashes, own, starts, spans = _unpacked_ranges(r["ranges"])
        real = own >= 0
        pad = np.zeros(len(own) - int(real.sum()), np.int64)
        docs.append(np.array(r["docs"], np.int64))
        tags.append(np.array(r["tags"], np.int64))
        h.append(hashes)
        owner.append(np.where(real, own + at, -1))
        first.append(np.concatenate([starts, pad]))
        span.append(np.concatenate([spans, pad]))
        times.append(np.full(len(own), 0 if r["counted"] else -1))
        at += len(docs[-1])
    docs, tags, h, owner, first, span, times = (np.concatenate(x) for x in (docs, tags, h, owner, first, span, times))
    open_ = times == 0
    _, inverse, counts = np.unique(h[open_], return_inverse=True, return_counts=True)
    marked = np.zeros(len(counts), bool)
    marked[inverse[owner[open_] < 0]] = True
    times[open_] = np.where(marked, -1, counts)[inverse]
    keep = (owner >= 0) & (times != 1)
    owner, first, span, times = owner[keep], first[keep], span[keep], times[keep]
    order = np.lexsort((tags[owner], docs[owner]))
    owner, first, span, times = owner[order], first[order], span[order], times[order]
    d, t = docs[owner], tags[owner]
    starts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])]) if len(d) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[starts, len(d)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (first, span, times)]
    return pa.table([pa.array(d[starts]), pa.array(t[starts]), *lists], names=["key", "tag", "first", "span", "times"])


# What the merges exchange: sorted runs (part set), and repeats that are decided already (part spread).
_EXCHANGE = (
    "part int, key long, tag long, start int, stop int, shared binary, lengths binary, tails binary, places binary"
)
_X_NAMES = [c.split()[0] for c in _EXCHANGE.split(", ")]
_X_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]


_PLACES = ((1, "<i8"), (2, "<i8"), (3, "<i4"), (4, "<i4"), (5, "<i4"))  # key, tag, start, count, times of a record


def _united(new: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of spans sorted by text and start, new where a text begins: the first of each unbroken run, and where that ends."""
    # the furthest stop so far; texts are set apart by more than any length
    apart = np.cumsum(new) << 32
    reached = np.maximum.accumulate(stop + apart)
    first = np.flatnonzero(np.r_[True, (start + apart)[1:] > reached[:-1]][: len(new)])
    return first, (reached - apart)[np.r_[first[1:], len(new)] - 1] if len(new) else stop


class Runs:
    """Collects strings with their places and gives sorted, combined, front-coded runs and decided repeats.

    A record is (string, key, tag, start, count, times). ``place`` gives the part of each of some sorted strings.
    """

    def __init__(self, place: Callable[[list[bytes]], np.ndarray], parts: int, seed: int):
        self.place, self.parts, self.spread, self.records = place, parts, seed, []
        self.repeats: list[tuple[int, int, int, int]] = []
        self.decided: list[np.ndarray] = []  # repeats as arrays of four columns

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if len(self.records) >= RUN or (last and self.records):
            yield self._run()
        held = len(self.repeats) + sum(map(len, self.decided))
        if held >= RUN or (last and held):
            yield self._decided()

    def _decided(self) -> pa.RecordBatch:
        """Repeats as rows, neighbouring ones joined."""
        spans = np.concatenate([*self.decided, np.array(self.repeats, np.int64).reshape(-1, 4)])
        key, tag, start, stop = spans[np.lexsort(spans.T[3::-1])].T
        first, until = _united(np.r_[True, (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])], start, stop)
        self.repeats, self.decided = [], []
        self.spread += 1
        columns = [(self.spread + np.arange(len(first))) % self.parts, key[first], tag[first], start[first], until]
        arrays = [pa.array(c, pa.int64()).cast(t) for c, t in zip(columns, _X_TYPES[:5], strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, *[pa.nulls(len(first), pa.binary())] * 4], _X_NAMES)

    def _run(self) -> pa.RecordBatch:
        self.records.sort()
        kept = []
        for record in self.records:
            if kept and kept[-1][0] == record[0]:
                s, key, tag, start, count, times = kept[-1]
                kept[-1] = (s, key, tag, start, count + record[4], times)
                if record[1:4] != (key, tag, start):
                    self.repeats.append((*record[1:4], record[3] + len(s)))
            else:
                kept.append(record)
        self.records = []
        parts = self.place([r[0] for r in kept])
        order = np.argsort(parts, kind="stable")
        rows = []
        for some in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1):
            own = [kept[i] for i in some]
            places = b"".join(_planes(np.array([r[i] for r in own], t)).T.tobytes() for i, t in _PLACES)
            coded = map(zstandard.compress, (*front_code([r[0] for r in own]), places))
            rows.append((int(parts[some[0]]), None, None, None, None, *coded))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _X_TYPES, strict=True)], _X_NAMES)


def _by_range(splitters: list[bytes]) -> Callable[[list[bytes]], np.ndarray]:
    return lambda strings: part_of(strings, splitters)


def _by_piece(parts: int) -> Callable[[list[bytes]], np.ndarray]:
    """Parts of strings that begin with the hash of their piece; they follow the ranges."""
    return lambda strings: parts + np.array([int.from_bytes(s[:8], "big") % parts for s in strings])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """The elements of all lists, and the row of each."""
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return row, lists.values.slice(lists.offsets[0].as_py(), len(row)) if len(lists) else lists.values


def _suffix_runs(splitters: list[bytes], parts: int):
    """Sorted runs of candidate suffixes from whole texts joined with their candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(_by_range(splitters), parts, TaskContext.get().partitionId())
        for batch in slices(batches):
            keys, tags = (column(batch, c).to_numpy() for c in ("key", "tag"))
            row, found = _flat(column(batch, "found"))
            places, texts = found.field("first"), column(batch, "text").cast(pa.binary())
            ends, first, span, times = places.offsets.to_numpy(), places.values, found.field("span").values, found.field("times").values
            first, times, stop = first.to_numpy(), times.to_numpy(), first.to_numpy() + span.to_numpy() + LENGTH
            for i in np.flatnonzero(found.field("tag").to_numpy() == tags[row]).tolist():
                some, at = slice(ends[i], ends[i + 1]), row[i]
                data, key, tag = texts[at].as_py(), int(keys[at]), int(tags[at])
                places = zip(first[some].tolist(), stop[some].tolist(), times[some].tolist(), strict=True)
                runs.records += [(data[a:b], key, tag, a, 1, n) for a, b, n in places]
                yield from runs.batches()
        yield from runs.batches(last=True)
        yield from runs.batches(last=True)

    return run


class Merged:
    """Some merged strings of a key range, groups of equal ones whole."""

    def __init__(self, strings: list[bytes], equal: np.ndarray, places: list[np.ndarray]):
        self.strings, (self.key, self.tag, self.start, self.count, self.times) = strings, places
        self.group = np.cumsum(~equal) - 1  # equal: to the string before

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """The earliest of each group, and the others' repeats."""
        order = np.lexsort((self.start, self.tag, self.key, self.group))
        first = order[np.r_[True, np.diff(self.group[order]) > 0]]
        lead = first[self.group]
        same = (self.key == self.key[lead]) & (self.tag == self.tag[lead]) & (self.start == self.start[lead])
        lengths = np.fromiter(map(len, self.strings), np.int64, len(self.strings))
        return first, np.stack([self.key, self.tag, self.start, self.start + lengths], 1)[~same]

    def record(self, i: int) -> tuple:
        return self.strings[i], *(int(c[i]) for c in (self.key, self.tag, self.start, self.count, self.times))


def _merged(rows: pa.Table) -> Iterator[Merged]:
    """The strings of a key range in order, with their places."""
    runs, places, sizes = [], [], []
    for r in rows.filter(rows.column("shared").is_valid()).select(["shared", "lengths", "tails", "places"]).to_pylist():
        shared, lengths, tails, packed = (zstandard.decompress(r[c]) for c in ("shared", "lengths", "tails", "places"))
        runs.append(decoded(shared, lengths, tails))
        columns, at = [], 0
        for _, t in _PLACES:
            size = np.dtype(t).itemsize
            planes = np.frombuffer(packed, np.uint8, len(shared) * size, at).reshape(size, len(shared))
            columns.append(np.ascontiguousarray(planes.T).view(t).ravel().astype(np.int64))
            at += len(shared) * size
        places.append(columns)
        sizes.append(len(shared))
    columns = [np.concatenate(c) for c in zip(*places, strict=True)]
    numbers = [iter(range(end - n, end)) for n, end in zip(sizes, np.cumsum(sizes).tolist(), strict=True)]
    strings: list[bytes] = []
    order: list[int] = []
    equal: list[bool] = []
    before = -1
    for run, string, shared in merge_runs(runs):
        same = shared == before == len(string)
        if len(strings) >= MERGED and not same:
            yield Merged(strings, np.array(equal), [c[order] for c in columns])
            strings, order, equal = [], [], []
        strings.append(string)
        order.append(next(numbers[run]))
        equal.append(same)
        before = len(string)
    if strings:
        yield Merged(strings, np.array(equal), [c[order] for c in columns])


def _passed(rows: pa.Table) -> np.ndarray:
    some = rows.filter(rows.column("key").is_valid())
    return np.stack([some.column(c).to_numpy().astype(np.int64) for c in ("key", "tag", "start", "stop")], 1)


def _merge_suffixes(splitters: list[bytes], parts: int):
    """Decides equal candidates and sends on those that may repeat in part.

    They meet the others with their piece, as whole candidates; if there are more than GROUP of these, as single
    strings by range, so that no group is held whole.
    """

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        single, whole = Runs(_by_range(splitters), parts, part), Runs(_by_piece(parts), parts, part)
        single.decided = [_passed(rows)]
        out, doubtful = [], []

        def send() -> None:
            # the strings of a candidate have one piece
            h, owner, _, _, piece = ranges_of([r[0] for r in doubtful])
            first = np.unique(owner, return_index=True)[1]
            for hash_, at, record in zip(h[first].tolist(), piece[first].tolist(), doubtful, strict=True):
                whole.records.append((hash_.to_bytes(8, "big") + bytes([at]) + record[0], *record[1:]))
            doubtful.clear()
            out.extend(whole.batches())

        for some in _merged(rows):
            first, repeats = some.settle()
            single.decided.append(repeats)
            times, met = some.times[first], np.bincount(some.group, some.count)
            for i in first[(times < 0) | (times > GROUP)].tolist():
                string, key_, tag, start, _, _ = some.record(i)
                single.records += [(string[i : i + LENGTH], key_, tag, start + i, 1, 0) for i in range(len(string) - LENGTH + 1)]
                out.extend(single.batches())
            doubtful += [some.record(i) for i in first[(times >= 0) & (times <= GROUP) & (met < times)].tolist()]
            if len(doubtful) >= RUN:
                send()
            out.extend(single.batches())
        send()
        for runs in (whole, single, single):
            out.extend(runs.batches(last=True))
        return pa.Table.from_batches(out, schema=pa.schema(list(zip(_X_NAMES, _X_TYPES, strict=True))))

    return merge


_SPANS = "key long, tag long, start int, stop int"


def _settle_piece(group: list[tuple]) -> np.ndarray:
    """Repeats among candidates that share a piece: records whose strings begin with its hash and place.

    Two candidates are laid upon each other at their pieces; what is equal from there to both sides holds their equal
    strings. Where many share a piece, their strings are sorted, those of one distance to the piece together.
    """
    repeats, head = [], 9
    order = sorted((k, t, at + s[8], at, s[head:], s[8]) for s, k, t, at, *_ in group)
    if len(order) <= ALL_PAIRS:
        halves: list[tuple] = []
        for key, tag, middle, _, s, place in order:
            left, right = s[:place][::-1], s[place:]
            for k, t, m, other_left, other_right in halves:
                if (k, t, m) == (key, tag, middle):
                    continue
                behind = common(right, other_right, 0)
                ahead = common(left, other_left, 0)
                if ahead + behind >= LENGTH:
                    repeats.append((key, tag, middle - ahead, middle + behind))
                    if ahead + behind == len(s):
                        break
            halves.append((key, tag, middle, left, right))
        return np.array(repeats, np.int64).reshape(-1, 4)
    width = LENGTH - PIECE
    laid = np.frombuffer(b"".join((b"\0" * (width - r[5]) + r[4]).ljust(width + LENGTH, b"\0") for r in order), np.uint8).reshape(len(order), -1)
    where = np.array([r[:3] for r in order], np.int64)
    before = np.array([r[5] for r in order])
    behind = np.array([len(r[4]) for r in order]) - before
    for distance in range(width + 1):
        some = np.flatnonzero((before >= distance) & (behind + distance >= LENGTH))
        strings = np.ascontiguousarray(laid[some, width - distance : width - distance + LENGTH]).view(f"S{LENGTH}").ravel()
        _, first, which = np.unique(strings, return_index=True, return_inverse=True)
        again = some[(where[some] != where[some][first[which]]).any(1)]
        start = where[again, 2] - distance
        repeats.append(np.stack([where[again, 0], where[again, 1], start, start + LENGTH], 1))
    return np.concatenate(repeats)


def _merge_strings(parts: int):
    """Decides single strings, by equality, and candidates that share a piece, by their equal parts."""

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        runs = Runs(_by_range([]), 1, 0)
        runs.decided = [_passed(rows)]
        group: list[tuple] = []
        for some in _merged(rows):
            if key[0].as_py() < parts:
                runs.decided.append(some.settle()[1])
                continue
            for i in range(len(some.strings)):
                if group and group[0][0][:8] != some.strings[i][:8]:
                    if len(group) > 1:
                        runs.decided.append(_settle_piece(group))
                    group = []
                group.append(some.record(i))
        runs.decided.append(_settle_piece(group))
        if any(map(len, runs.decided)):
            return pa.Table.from_batches([runs._decided()]).select(["key", "tag", "start", "stop"])
        return pa.table([pa.array([], t) for t in _X_TYPES[1:5]], names=["key", "tag", "start", "stop"])

    return merge


def _splitters(docs: DataFrame, parts: int) -> list[bytes]:
    """Key ranges from the candidates of a bounded sample of texts; they only balance the work."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.encode()[: 1 << 14] if t else b"" for t in column(batch, "text").to_pylist()]
            _, owner, first, _, _ = ranges_of(texts)
            strings = [texts[o][f : f + 32] for o, f in zip(owner[::3], first[::3], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(strings, pa.binary())], ["s"])

    sample = docs.orderBy(F.xxhash64("key", F.lit(13)), "key").limit(max(400, SAMPLED * parts)).mapInArrow(some, "s binary")
    strings = sorted({bytes(r.s) for r in sample.collect()})
    return [strings[i * len(strings) // parts] for i in range(1, parts)] if len(strings) >= parts else strings[1:]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """key, tag, text, rest and spans (tag, start and stop in bytes, may overlap) to remove from each row.

    ``docs``: doc_id, text and rest, which is handed through.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"), "rest"
    ).withColumn("tag", F.xxhash64("text"))
    # ranges and buckets are groups held in a task, so their number follows the texts
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(default_partitions(docs.sparkSession), -(-size // PART_BYTES))
    splitters = _splitters(rows.drop("rest"), parts)
    buckets = rows.select("key", "tag", "text").mapInArrow(_bucketed(parts), _BUCKETS)
    found = buckets.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_repeated, _REPEATED)
    found = found.groupBy("key", "tag").agg(F.collect_list(F.struct("tag", "first", "span", "times")).alias("found"))
    # the same exchange of the texts serves this join and the last one; texts of one id, or of none, are dealt by their tags
    placed = rows.repartition(parts, "key", "tag")
    suffixes = placed.join(found, ["key", "tag"], "left").select(*placed.columns, "found").mapInArrow(_suffix_runs(splitters, parts), _EXCHANGE)
    # as many tasks as parts, which are not of one size
    strings = suffixes.repartition(parts, "part").groupBy("part").applyInArrow(_merge_suffixes(splitters, parts), _EXCHANGE)
    spans = strings.repartition(parts, "part").groupBy("part").applyInArrow(_merge_strings(parts), _SPANS)
    spans = spans.groupBy("key", "tag").agg(F.collect_list(F.struct("tag", "start", "stop")).alias("spans"))
    return placed.join(spans, ["key", "tag"], "left").select("key", "tag", "text", "rest", "spans")


def _joined(batch: pa.RecordBatch) -> list[list[list[int]]]:
    """Maximal removed runs of each text."""
    row, spans = _flat(column(batch, "spans"))
    own = spans.field("tag").to_numpy() == column(batch, "tag").to_numpy()[row]
    row, start, stop = row[own], *(spans.field(c).to_numpy()[own].astype(np.int64) for c in ("start", "stop"))
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    first, until = _united(np.r_[True, row[1:] != row[:-1]][: len(row)], start, stop)
    out: list[list[list[int]]] = [[] for _ in range(batch.num_rows)]
    for i, *span in zip(row[first].tolist(), start[first].tolist(), until.tolist(), strict=True):
        out[i].append(span)
    return out


def _kept(data: bytes, spans: list[list[int]]) -> bytes:
    kept, at = [], 0
    for start, stop in spans:
        kept.append(data[at:start])
        at = stop
    return b"".join([*kept, data[at:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, spans (start and stop of each maximal removed run, in bytes) and kept (the remaining bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = _joined(batch)
            kept = [_kept(text, some) for text, some in zip(column(batch, "text").cast(pa.binary()).to_pylist(), spans, strict=True)]
            key = column(batch, "key")
            key = pa.compute.if_else(pa.compute.equal(key, NULL_ID), pa.scalar(None, pa.int64()), key)
            arrays = [key, pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "spans", "kept"])

    return repeated_spans(documents(docs).withColumn("rest", F.lit(0))).mapInArrow(run, "doc_id long, spans array<array<long>>, kept binary")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the sha256 of what is kept."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    kept = F.octet_length("kept").cast("long")
    return rows.select(
        "doc_id", (kept + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def clean_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with what remains of their texts; a character that is cut goes with the cut.

    Every row stays, also with an empty text; a null text stays null.
    """
    others = [c for c in docs.columns if c != text_col]
    rest = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col(text_col).isNull().alias("none"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), rest.alias("rest"))
    found = repeated_spans(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = column(batch, "text").to_pylist()
            for i, spans in enumerate(_joined(batch)):
                if spans:
                    texts[i] = _kept(texts[i].encode(), spans).decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), column(batch, "rest")], ["text", "rest"])

    cleaned = found.mapInArrow(run, found.select("text", "rest").schema)
    back = [F.when(~F.col("rest.none"), F.col("text")).alias(c) if c == text_col else F.col(f"rest.c{others.index(c)}").alias(c) for c in docs.columns]
    return cleaned.select(*back)
