"""Front-coded sorted runs of byte strings and their common-prefix-aware merge."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Strings of a run that are front-coded at once.
CODED = 8_192
#: A string's number in a merge: LONGEST less its known prefix, above so many bytes that follow; ENDED is above all numbers.
AHEAD, LONGEST = 7, 255
ENDED = 1 << 8 * (AHEAD + 1)


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree on the first ``at`` bytes."""
    n = min(len(a), len(b))
    step = 8
    while at < n:
        if a[at : at + step] == b[at : at + step]:
            at = min(n, at + step)
            step *= 2
        elif step == 1:
            return at
        else:
            step //= 2 if step <= 8 else step // 8
    return n


def front_code(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """For a sorted run: shared prefix with the string before, length (one byte each), and the rest of each."""
    if not strings:
        return b"", b"", b""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    width = int(lengths.max())
    shared, tails = np.zeros(len(strings), np.int64), []
    last = np.zeros((1, width + 1), np.uint8)
    for at in range(0, len(strings), CODED):
        some = strings[at : at + CODED]
        # a last column in which neighbours always differ
        rows = np.frombuffer(b"".join(s.ljust(width + 1, b"\0") for s in some), np.uint8).reshape(len(some), width + 1).copy()
        rows[:, width] = 1 + np.arange(at, at + len(some)) % 2
        n = (rows != np.concatenate([last, rows[:-1]])).argmax(1)
        own = lengths[at : at + len(some)]
        n = np.minimum(n, np.minimum(own, np.r_[lengths[at - 1] if at else 0, own[:-1]]))
        shared[at : at + len(some)], last = n, rows[-1:]
        places = np.arange(width + 1)
        tails.append(rows[(places >= n[:, None]) & (places < own[:, None])].tobytes())
    return shared.astype(np.uint8).tobytes(), lengths.astype(np.uint8).tobytes(), b"".join(tails)


def decoded(shared: bytes, lengths: bytes, tails: bytes) -> Iterator[tuple[bytes, int]]:
    """The strings of a run, each with its shared prefix."""
    last, at = b"", 0
    for n, length in zip(shared, lengths, strict=True):
        last = last[:n] + tails[at : at + length - n]
        at += length - n
        yield last, n


def merge_runs(runs: list[Iterable[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """(run, string, prefix shared with the string before) in order, by a loser tree.

    Each string carries the length of its prefix shared with the last winner and the bytes that follow it, as one number: the
    longer such prefix is smaller, whatever follows; at equal lengths the following bytes decide. Only strings whose
    numbers are equal are compared, and only behind these bytes. Equal strings come out in the order of their runs.
    """
    sources = [iter(r) for r in runs]
    k = len(sources)
    if not k:
        return
    size = 1
    while size < k:
        size *= 2
    text: list[bytes | None] = [None] * size
    code = [ENDED] * size

    def coded(s: bytes, n: int) -> int:
        some = s[n : n + AHEAD]
        return (LONGEST - n << 8 * AHEAD) + (int.from_bytes(some, "big") << 8 * (AHEAD - len(some)))

    for i, source in enumerate(sources):
        first = next(source, None)
        if first is not None:
            text[i], code[i] = first[0], coded(first[0], 0)

    def loses(i: int, j: int) -> bool:
        """Whether run i's string comes after run j's; the loser's number is then that after the winner."""
        a, b = code[i], code[j]
        behind = a ^ b
        if behind >> 8 * AHEAD - 8 or a >= ENDED:
            # other prefixes, or other bytes right behind them: the loser shares with the winner what it shared before
            return a > b
        x, y = text[i], text[j]
        n = LONGEST - (a >> 8 * AHEAD)
        if behind:
            after, n = a > b, min(n + AHEAD - (behind.bit_length() + 7) // 8, len(x), len(y))
        else:
            n = common(x, y, min(n + AHEAD, len(x), len(y)))
            after = i > j if n == len(x) == len(y) else n < len(x) and (n == len(y) or x[n] > y[n])
        if after:
            code[i] = coded(x, n)
        else:
            code[j] = coded(y, n)
        return after

    losers = [0] * size

    def play(node: int) -> int:
        if node >= size:
            return node - size
        left, right = play(2 * node), play(2 * node + 1)
        if loses(left, right):
            left, right = right, left
        losers[node] = right
        return left

    winner = play(1) if size > 1 else 0
    far = 8 * AHEAD - 8
    while (own := code[winner]) < ENDED:
        yield winner, text[winner], LONGEST - (own >> 8 * AHEAD)
        following = next(sources[winner], None)
        # the next string of this run shares with the last winner what it shares with its predecessor
        if following is None:
            text[winner], code[winner] = None, ENDED
        else:
            s, n = following
            some = s[n : n + AHEAD]
            text[winner], code[winner] = s, (LONGEST - n << 8 * AHEAD) + (int.from_bytes(some, "big") << 8 * (AHEAD - len(some)))
        node = (size + winner) >> 1
        while node:
            other = losers[node]
            a, b = code[winner], code[other]
            # most are decided by their numbers alone
            if (a > b) if (a ^ b) >> far else loses(winner, other):
                losers[node], winner = winner, other
            node >>= 1


def part_of(strings: list[bytes], splitters: list[bytes]) -> np.ndarray:
    """Range of each string of a sorted list, where range i begins at the i-th splitter."""
    from bisect import bisect_left

    bounds = [bisect_left(strings, s) for s in splitters]
    return np.searchsorted(np.array(bounds), np.arange(len(strings)), side="right")
