"""Personal data: fixed patterns, and a semi-Markov conditional random field for what is written otherwise.

Base spans are those of four patterns (mail address, IP address, card number, phone number). The field adds spans
written in other ways ('name at host dot com', grouped or dotted numbers, phones without a plus). It scores whole
candidate segments: every stretch of at most MAX_TOKENS tokens and MAX_CHARS characters on one line, between borders
of words, with a trigger in it and enough digits or an at sign. A candidate has features of the whole span (shape,
sizes of its digit groups, check digit, range of its parts, separators, neighbours) and a weight per kind and
feature; everything outside has score zero. The best segmentation is found by dynamic programming over the
candidates' borders, jointly for borders and kinds, and a span is added if its marginal probability is LEAST or more.
Base spans are fixed: candidates that touch one do not compete.

The texts are read once. Regions (CONTEXT characters around each trigger, merged) are kept per document; the field
learns from regions around at most SAMPLE documents with base spans, taken by hash, in which the base span is
rewritten in other ways or spoilt (wrong check digit, part above 255, and so on) by fixed rules; at most SAMPLE regions
without base spans join as negatives in a second fit, but for spans of which the first fit is sure, which stay
unlabelled. Both fits run on the driver over that bounded sample; regions of all documents are then decoded where they lie.

Defined cases: a null or empty text has no spans; repeated rows and null ids are rows like any other; without base
spans in the sample nothing is added; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.common import NULL_ID, column, documents, slices, staged

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
MAX_CHARS = 100
CONTEXT = 120
SAMPLE = 1000
#: Regions of a sampled document, and characters of each, that take part in the fit.
REGIONS = 4
SHOWN = 2400
#: Rewritten or spoilt examples of each kind, and the most made of one base span.
EXAMPLES, MOST = 1500, 60
BINS = 1 << 15
EPOCHS = 12
#: A span joins from this marginal probability on.
LEAST = 0.7

# The patterns are fixed by the definition of base spans; possessive forms and lookbehinds only save retries that cannot match.
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

TRIGGER = re.compile(r"[0-9@]+|(?i:\bdot\b|[\[({]\s?(?:at|dot)\s?[\])}]|\bat\s+[a-z0-9-]+\.[a-z])")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\S\n]+|[\s\S]")

SPAN = "struct<kind:int,start:long,stop:long>"
ROW = f"doc_id long, base array<{SPAN}>, regions array<struct<start:long,text:string,open:boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _mails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _HOST.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, stop) in code points, by kind, then start."""
    if not text:
        return []
    out = [(0, a, b) for a, b in _mails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def regions(text: str | None, base: list[tuple[int, int, int]]) -> list[tuple[int, str, bool]]:
    """(start, text, whether some trigger lies outside the base spans) of the stretches around triggers."""
    if not text:
        return []
    out: list[list] = []
    taken = sorted((a, b) for _, a, b in base)
    k = 0
    for m in TRIGGER.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        free = not (k < len(taken) and taken[k][0] <= m.start() and m.end() <= taken[k][1])
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1][1] = b
            out[-1][2] |= free
        else:
            out.append([a, b, free])
    return [(a, text[a:b], free) for a, b, free in out]


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans, and the regions that hold a trigger; one map-only pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = column(batch, "text").to_pylist()
            base = [base_spans(t) if t and TRIGGER.search(t) else [] for t in texts]
            found = [regions(t, b) for t, b in zip(texts, base, strict=True)]
            spans = [[{"kind": k, "start": a, "stop": b} for k, a, b in own] for own in base]
            parts = [[{"start": a, "text": t, "open": o} for a, t, o in own] for own in found]
            of_span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
            of_part = pa.struct([("start", pa.int64()), ("text", pa.string()), ("open", pa.bool_())])
            columns = [column(batch, "doc_id"), pa.array(spans, pa.list_(of_span)), pa.array(parts, pa.list_(of_part))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "regions"])

    return documents(docs, id_col, text_col).mapInArrow(run, ROW)


@dataclass
class Segments:
    """Candidate segments of a region as (start, stop) in characters, by stop, with their feature numbers."""

    spans: list[tuple[int, int]]
    features: list[np.ndarray]


def _sizes(n: int) -> str:
    return str(n) if n < 5 else "5-8" if n < 9 else "9-12" if n < 13 else "13-19" if n < 20 else "20+"


def _shape(token: str) -> str:
    first = token[0]
    if first in "0123456789":
        return f"d{_sizes(len(token))}"
    if first.isalpha():
        low = token.lower()
        return {"at": "AT", "dot": "DOT"}.get(low, "a")
    return " " if first.isspace() else token


def _numbers(names: list[str]) -> np.ndarray:
    return np.unique(np.array([zlib.crc32(n.encode()) % BINS for n in names], np.int64))


def _features(text: str, tokens: list[str], shapes: list[str], i: int, j: int, left: str, right: str, word: str) -> np.ndarray:
    """Features of the whole span of tokens i..j-1 between the shapes ``left`` and ``right``."""
    own, kinds = tokens[i:j], shapes[i:j]
    groups = [t for t, s in zip(own, kinds, strict=True) if s[0] == "d"]
    digits = "".join(groups)
    coarse = ["d" if s[0] == "d" else s for s in kinds]
    seps = "".join(sorted({s for s in coarse if s not in ("a", "d")}))
    names = [
        "bias", f"shape={''.join(kinds)}", f"coarse={''.join(coarse)}", f"sizes={'.'.join(str(len(g)) for g in groups)}",
        f"digits={min(len(digits), 20)}", f"groups={min(len(groups), 7)}", f"seps={seps}", f"first={coarse[0]}", f"last={coarse[-1]}",
        f"left={left}", f"right={right}", f"edges={left}{coarse[0]}_{coarse[-1]}{right}", f"word={word}", f"zeros={digits[:2] == '00'}",
    ]
    if 13 <= len(digits) <= 19:
        names += [f"luhn={luhn(digits)}", f"luhn={luhn(digits)},{seps}", f"luhn={luhn(digits)},{left}{right}"]
    if len(groups) == 4:
        names.append(f"quad={all(len(g) <= 3 and int(g) <= 255 for g in groups)},{seps}")
    at = next((k for k, s in enumerate(coarse) if s in ("AT", "@")), None)
    if at is None:
        names.append("plain")
        names.append(f"separators={'same' if len({s for s in coarse[1:-1] if s != 'd'}) < 2 else 'mixed'},{len(groups)}")
    else:
        local, host = coarse[:at], coarse[at + 1 :]
        names += [
            f"local={''.join(local)}", f"host={''.join(host)}", f"words={sum(s in ('a', 'd') for s in local)}", f"end={own[-1].lower()}",
            f"endsize={min(len(own[-1]), 7)}", f"sign={''.join(local[-2:])}{coarse[at]}{''.join(host[:2])}",
            f"labels={sum(s in ('.', 'DOT') for s in host)}", f"signs={sum(s in ('AT', '@') for s in coarse)}",
            f"bare={any(x in ('a', 'd') and y == ' ' and z in ('a', 'd') for x, y, z in zip(coarse, coarse[1:], coarse[2:], strict=False))}",
        ]
    return _numbers(names)


def candidates(text: str, blocked: list[tuple[int, int]] = ()) -> Segments:
    """Segments that may be personal data and do not touch ``blocked``."""
    marks = list(TOKEN.finditer(text))
    tokens = [m.group() for m in marks]
    shapes = [_shape(t) for t in tokens]
    starts = [m.start() for m in marks] + [len(text)]
    solid = [s[0] == "d" or s in ("a", "AT", "DOT") for s in shapes]
    barred = [False] * len(tokens)
    k = 0
    for a, b in sorted(blocked):
        while k and starts[k] > a:
            k -= 1
        while k < len(tokens) and starts[k] < b:
            if starts[k + 1] > a:
                barred[k] = True
            k += 1
    found: list[tuple[int, int, np.ndarray]] = []
    for i in range(len(tokens)):
        if barred[i] or not (solid[i] or tokens[i] in "+(") or (i and (solid[i - 1] or tokens[i - 1] in "_+")):
            continue
        digits = letters = groups = signs = dots = 0
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            if barred[j] or tokens[j] == "\n" or len(tokens[j]) > MAX_CHARS or starts[j + 1] - starts[i] > MAX_CHARS:
                break
            s = shapes[j]
            if s[0] == "d":
                digits += len(tokens[j])
                groups += 1
            elif s == "a":
                letters += 1
            elif s in ("AT", "@"):
                signs += 1
            elif s in (".", "DOT"):
                dots += signs > 0
            if not solid[j] or (j + 1 < len(tokens) and (solid[j + 1] or tokens[j + 1] == "_")):
                continue
            number = not letters and not signs and (digits >= 7 or (groups >= 4 and digits >= 4))
            mail = signs == 1 and dots > 0 and letters + groups > 2 and s in ("a", "AT") or (s[0] == "d" and signs == 1 and dots > 0)
            if number or mail:
                left = "" if not i else ("a" if shapes[i - 1][0] == "d" else shapes[i - 1])
                right = shapes[j + 1] if j + 1 < len(tokens) else ""
                k = i - 1
                while k >= 0 and not solid[k] and i - k < 4:
                    k -= 1
                word = tokens[k].lower() if k >= 0 and solid[k] else ""
                found.append((j + 1, i, _features(text, tokens, shapes, i, j + 1, left, right, word)))
    found.sort(key=lambda c: (c[0], c[1]))
    return Segments([(starts[i], starts[j]) for j, i, _ in found], [f for _, _, f in found])


def _add(x: float, y: float) -> float:
    if x == -math.inf:
        return y
    high, low = (x, y) if x > y else (y, x)
    return high + math.log1p(math.exp(low - high))


def marginals(spans: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """Probability of each (kind, candidate): sums over all sets of candidates that do not overlap."""
    whole = [float(np.logaddexp.reduce(scores[:, c])) for c in range(len(spans))]
    borders = sorted({b for s in spans for b in s})
    at = {b: k for k, b in enumerate(borders)}
    ending, starting = [[] for _ in borders], [[] for _ in borders]
    for c, (a, b) in enumerate(spans):
        ending[at[b]].append((at[a], c))
        starting[at[a]].append((at[b], c))
    ahead, behind = [0.0] * len(borders), [0.0] * len(borders)
    for k in range(len(borders)):
        total = ahead[k - 1] if k else 0.0
        for a, c in ending[k]:
            total = _add(total, ahead[a] + whole[c])
        ahead[k] = total
    for k in reversed(range(len(borders))):
        total = behind[k + 1] if k + 1 < len(borders) else 0.0
        for b, c in starting[k]:
            total = _add(total, whole[c] + behind[b])
        behind[k] = total
    outside = np.array([ahead[at[a]] + behind[at[b]] - ahead[-1] for a, b in spans])
    return np.exp(scores + outside)


def best_segments(spans: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int]]:
    """(kind, candidate) of the segmentation of greatest score."""
    kind, value = scores.argmax(0), scores.max(0)
    borders = sorted({b for s in spans for b in s})
    at = {b: k for k, b in enumerate(borders)}
    best, taken = [0.0] * len(borders), [-1] * len(borders)
    by_end: list[list[int]] = [[] for _ in borders]
    for c, (_, b) in enumerate(spans):
        by_end[at[b]].append(c)
    for k in range(len(borders)):
        best[k] = best[k - 1] if k else 0.0
        for c in by_end[k]:
            total = best[at[spans[c][0]]] + value[c]
            if total > best[k]:
                best[k], taken[k] = total, c
    out, k = [], len(borders) - 1
    while k >= 0:
        if taken[k] < 0:
            k -= 1
        else:
            out.append((int(kind[taken[k]]), taken[k]))
            k = at[spans[taken[k]][0]]
    return out[::-1]


@dataclass
class Field:
    """Weights per kind and feature."""

    weights: np.ndarray

    def scores(self, segments: Segments) -> np.ndarray:
        return np.array([self.weights[:, f].sum(1) for f in segments.features]).reshape(-1, len(KINDS)).T

    def find(self, text: str, blocked: list[tuple[int, int]] = (), least: float = LEAST) -> list[tuple[int, int, int, float]]:
        """(kind, start, stop, probability) of the best segmentation's spans that reach ``least``."""
        segments = candidates(text, blocked)
        if not segments.spans:
            return []
        scores = self.scores(segments)
        chosen = best_segments(segments.spans, scores)
        if not chosen:
            return []
        p = marginals(segments.spans, scores)
        return [(k, *segments.spans[c], float(p[k, c])) for k, c in chosen if p[k, c] >= least]

    @classmethod
    def fit(cls, examples: list[tuple[Segments, set[tuple[int, int, int]]]], epochs: int = EPOCHS, rate: float = 0.3) -> Field:
        """Gradient steps (Adagrad) on the log-likelihood of the labelled segmentations, one region at a time."""
        w, seen = np.zeros((len(KINDS), BINS)), np.full((len(KINDS), BINS), 1e-6)
        ready = []
        for segments, gold in examples:
            used, at = np.unique(np.concatenate(segments.features), return_inverse=True)
            holds = np.zeros((len(segments.spans), len(used)))  # candidates by features
            holds[np.repeat(np.arange(len(segments.features)), [len(f) for f in segments.features]), at] = 1
            truth = np.array([[(k, *span) in gold for span in segments.spans] for k in range(len(KINDS))], np.float64)
            ready.append((segments.spans, used, holds, truth))
        order = list(range(len(ready)))
        for epoch in range(epochs):
            random.Random(epoch).shuffle(order)
            for e in order:
                spans, used, holds, truth = ready[e]
                own = w[:, used]
                g = truth - marginals(spans, own @ holds.T)
                if np.abs(g).max() < 1e-3:
                    continue
                g = g @ holds
                total = seen[:, used] + g * g
                seen[:, used] = total
                w[:, used] = own + rate * g / np.sqrt(total) - 1e-4 * own
        return cls(w)


def _pick(rng: random.Random, values: list[str]) -> str:
    return values[rng.randrange(len(values))]


def rewritten(kind: int, span: str, rng: random.Random) -> str:
    """The same data written in another way, or as it is."""
    if rng.random() < 0.15:
        return span
    digits = "".join(c for c in span if c in "0123456789")
    if kind == 0:
        at = _pick(rng, [" at ", " at ", "(at)", " (at) ", "[at]", " [at] ", "{at}", " AT ", " @ ", "@"])
        dot = _pick(rng, [".", " dot ", " dot ", "(dot)", "[dot]", " [dot] ", " DOT ", " (dot) ", "[.]"])
        local, host = span.split("@", 1)
        words = [w for w in re.split(r"[^A-Za-z0-9]+", local) if w] or [local]
        half = max(1, len(words[0]) // 2)
        halves = f"{words[0][:half]}.{words[0][half:] or 'x'}"
        local = _pick(rng, [local, local, "".join(words), "_".join(words), "-".join(words), words[0], halves, halves + "".join(words[1:])])
        if host.count(".") > 1 and rng.random() < 0.3:
            host = host.split(".", 1)[1]
        if rng.random() < 0.3:
            host = re.sub("[0-9]", "", host)
        return (local if rng.random() < 0.5 else local.replace(".", dot)) + at + host.replace(".", dot)
    if kind == 1:
        return span.replace(".", _pick(rng, ["[.]", "(.)", " dot ", "[dot]", " . ", "(dot)", ". ", " [dot] "]))
    if kind == 2:
        size = _pick(rng, ["4", "4", "4", "6", "0"])
        sep = _pick(rng, [".", "/", "_", "  ", " - ", "\u2013", "\u00a0", ",", " / ", "*", "--"])
        n = int(size) or len(digits)
        return sep.join(digits[k : k + n] for k in range(0, len(digits), n))
    own, code = digits[-10:], digits[:-10] if rng.random() < 0.3 else str(rng.randrange(1, 1000 if rng.random() < 0.2 else 100))
    a, b, c = own[:-7], own[-7:-4], own[-4:]
    return _pick(rng, [
        f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{code} ({a}) {b}-{c}", f"00{code} {a} {b} {c}", f"00{code} ({a}) {b}-{c}",
        f"+{code}/{a}/{b}-{c}", f"+{code} {a} / {b} {c}", f"{a}/{b}-{c}", f"{code}-{a}-{b}-{c}", f"+{code}_{a}_{b}_{c}", f"({a}){b}-{c}",
        f"{a} {b} {c}", f"+{code}\u00a0{a}\u00a0{b}\u00a0{c}", f"+ {code} {a} {b} {c}", f"{code}.{a}.{b}.{c}",
    ])


def spoilt(kind: int, span: str, rng: random.Random) -> str:
    """Something of the same look that is no personal data."""
    digits = "".join(c for c in span if c in "0123456789") or "0"
    some = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == 0:
        local, host = span.split("@", 1)
        first = host.split(".")[0]
        return _pick(rng, [f"{local} at {first}", f"{first} at {rng.randrange(1, 99)}.{some(2)}", f"{first} dot {local}", f"at {first} dot", f"@{first}"])
    if kind == 1:
        parts = span.split(".")
        parts[rng.randrange(len(parts))] = str(rng.randrange(256, 1000))
        return _pick(rng, [
            ".".join(parts), "[.]".join(parts), " . ".join(parts), ".".join(parts[:3]), ".".join([*parts, some(2)]), f"{some(4)}-0{rng.randrange(1, 10)}-{some(2)} {some(2)}:{some(2)}:{some(2)}",
            ", ".join(some(2) for _ in range(5)), " ".join(some(3) for _ in range(4)), "/".join(parts),
        ])
    if kind == 2:
        k = rng.randrange(len(digits))
        wrong = digits[:k] + str((int(digits[k]) + rng.randrange(1, 10)) % 10) + digits[k + 1 :]
        sep = _pick(rng, ["", "", "", " ", "-", ".", "/", "_"])
        return sep.join(wrong[k : k + 4] for k in range(0, len(wrong), 4)) if rng.random() < 0.8 else some(rng.randrange(20, 40))
    return _pick(rng, [
        some(10), some(11), some(8), f"{some(5)}-{some(4)}", f"{some(1)},{some(3)},{some(3)},{some(3)}", f"{some(3)}-{some(1)}-{some(2)}-{some(6)}-{some(1)}",
        f"{some(4)}-{some(4)}", f"{some(4)} {some(4)} {some(4)}", f"{some(1)}.{some(9)}", f"{some(4)}-{some(2)}-{some(2)}", f"{some(4)}{some(4)}-{some(6)}",
        f"{some(3)} {some(2)} {some(4)} {some(2)}", f"#{some(9)}", f"{some(2)}:{some(2)}:{some(2)} {some(4)}",
    ])


def _noisy(text: str, rng: random.Random) -> str:
    """A word of the context becomes one that rewritten mail addresses use, now and then."""
    words = text.split(" ")
    if len(words) > 2 and rng.random() < 0.4:
        words[rng.randrange(1, len(words) - 1)] = _pick(rng, ["at", "dot", "at", "Dot"])
    return " ".join(words)


def _examples(rows: list) -> list[tuple[Segments, set]]:
    """Rewritten and spoilt base spans in their regions, about EXAMPLES of each kind; a region's other base spans stay."""
    places: list[list] = [[] for _ in KINDS]
    for row in rows:
        for region in row.regions:
            end = region.start + len(region.text)
            inside = [(s.kind, s.start - region.start, s.stop - region.start) for s in row.base if s.start >= region.start and s.stop <= end]
            for kind, a, b in inside:
                if not any((x, y) != (a, b) and x < b and a < y for _, x, y in inside):
                    places[kind].append((region.text, a, b, [(x, y) for _, x, y in inside if (x, y) != (a, b)]))
    out = []
    for kind, own in enumerate(places):
        rng = random.Random(kind)
        for text, a, b, others in own[:EXAMPLES]:
            for _ in range(min(MOST, -(-EXAMPLES // len(own)))):
                make, label = (rewritten, True) if rng.random() < 0.6 else (spoilt, False)
                new = make(kind, text[a:b], rng)
                left, right = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
                low, shift = a - len(left), len(new) - (b - a)
                near = [(x - low, y - low) if y <= a else (x - low + shift, y - low + shift) for x, y in others if y > low]
                if not near:  # fixed spans keep their places
                    left, right = _noisy(left, rng), _noisy(right, rng)
                span = (len(left), len(left) + len(new))
                segments = candidates(left + new + right, [(max(0, x), y) for x, y in near])
                if segments.spans and (not label or span in segments.spans):
                    out.append((segments, {(kind, *span)} if label else set()))
    return out


def fit_field(found: DataFrame, sample: int = SAMPLE) -> Field | None:
    """``found`` as find_base() gives it, written; None without base spans."""
    order = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)), F.to_json("base"), F.lit(11))
    # no more than REGIONS regions of SHOWN characters each of a document reach the driver
    part = lambda r: F.struct(r.start.alias("start"), F.substring(r.text, 1, SHOWN).alias("text"), r.open.alias("open"))
    few = lambda keep: F.transform(F.slice(F.filter("regions", keep), 1, REGIONS), part).alias("regions")
    spans = F.slice("base", 1, 8 * REGIONS).alias("base")
    held = lambda r: F.exists("base", lambda s: (s.start >= r.start) & (s.start < r.start + SHOWN))
    rows = found.where(F.size("base") > 0).orderBy(order, F.to_json("base")).limit(sample).select(spans, few(held)).collect()
    examples = _examples(rows)
    if not any(gold for _, gold in examples):
        return None
    first = Field.fit(examples)
    unlabelled = found.where(F.exists("regions", lambda r: r.open)).orderBy(order, F.to_json("base")).limit(sample)
    for row in unlabelled.select(spans, few(lambda r: r.open)).collect():
        for region in row.regions:
            taken = [(max(0, s.start - region.start), s.stop - region.start) for s in row.base if s.stop > region.start]
            segments = candidates(region.text, taken)
            if segments.spans and not first.find(region.text, taken):
                examples.append((segments, set()))
    return Field.fit(examples)


def add_spans(found: DataFrame, field: Field | None, least: float = LEAST) -> DataFrame:
    """doc_id, base and added (kind, start, stop, probability), spans by kind, then start; added touch no base span."""
    kinds = f"doc_id long, base array<{SPAN}>, added array<struct<kind:int,start:long,stop:long,probability:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_added = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64())])
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            out = []
            for base, parts in zip(column(batch, "base").to_pylist(), column(batch, "regions").to_pylist(), strict=True):
                own = []
                for r in parts if field else []:
                    if r["open"]:
                        at = r["start"]
                        taken = [(max(0, s["start"] - at), s["stop"] - at) for s in base if s["stop"] > at]
                        own += [(k, at + a, at + b, p) for k, a, b, p in field.find(r["text"], taken, least)]
                out.append([dict(zip(("kind", "start", "stop", "probability"), s, strict=True)) for s in sorted(own)])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "base"), pa.array(out, pa.list_(of_added))], ["doc_id", "base", "added"])

    return found.mapInArrow(run, kinds)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """doc_id, base and added spans of every whole text; kinds are positions in KINDS."""
    found = staged(find_base(docs, id_col, text_col), "pii-regions")
    return add_spans(found, fit_field(found, sample), least)


def listed(spans: Column | str) -> Column:
    """'kind:start:stop' of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.stop.cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def digests(found: DataFrame) -> DataFrame:
    """Per document: base spans of each kind, a digest of them, and all spans as text; n_added the number of added ones."""
    n = [F.expr(f"CAST(size(filter(base, s -> s.kind = {k})) AS BIGINT)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    same = F.transform("added", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.stop.alias("stop")))
    spans = F.array_sort(F.concat("base", same))
    return found.select(
        "doc_id", *n, F.sha2(listed("base"), 256).alias("base_sha256"), listed(spans).alias("spans"), F.size("added").cast("long").alias("n_added")
    )
