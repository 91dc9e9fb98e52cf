"""Language identification with a byte convolutional network, trained and applied in numpy.

Filters of several widths run over the bytes of fixed-length windows, each filter is max-pooled over the
window, and a softmax layer gives the window's language. A document's probabilities are the means over all
its windows, weighted by their bytes; its score is the largest. The filters act on one-hot bytes, so at
prediction time they are two tables over byte pairs.

The network learns from a bounded sample: about ``PER_LANGUAGE`` labelled documents of each language and
``WINDOWS_EACH`` windows of each, chosen by hashes of the id over the whole table.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when there
is nothing to learn from. Repeated rows are predicted once each, null ids are kept, an empty table gives
no rows. Columns other than id, text and (for learning) language are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.common import column, slices

UND = "und"
#: The class of what is no learned language, in models that are to reject it.
UNKNOWN = "unknown"
#: First code points of alphabets (fixed values) into which sample text is carried over as examples of UNKNOWN.
ALPHABETS = (0x391, 0x410, 0x531, 0x5D0, 0x627, 0x905, 0xE01, 0x10A0, 0x3042, 0x30A2, 0x4E00, 0xAC00)
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
PER_LANGUAGE = 600
WINDOWS_EACH = 4
STEPS = 700
BATCH = 64


class ByteCnn:
    """Multi-width byte filters, max pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = 42):
        self.languages, rng = languages, np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(n, np.float32)
        self.dense = rng.normal(0, 0.3, (n, len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), np.float32)

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 42) -> ByteCnn:
        """Adam on class-balanced batches; half of each batch is shortened, as short texts are."""
        rng, span = np.random.default_rng(seed), WINDOW - max(WIDTHS) + 1
        params = [*self.filters, self.bias, self.dense, self.offset]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        of = [np.flatnonzero(labels == c) for c in range(len(self.languages))]
        columns = np.arange(FILTERS)
        for step in range(1, steps + 1):
            y = rng.integers(0, len(of), BATCH)
            x = windows[[of[c][rng.integers(0, len(of[c]))] for c in y]].copy()
            cut = rng.integers(8, WINDOW, BATCH // 2)
            x[: BATCH // 2][np.arange(WINDOW)[None, :] >= cut[:, None]] = 0
            pooled, where = [], []
            for weights in self.filters:
                out = weights[0][x[:, :span]]
                for j in range(1, len(weights)):
                    out = out + weights[j][x[:, j : span + j]]
                best = out.argmax(1)
                where.append(best)
                pooled.append(np.take_along_axis(out, best[:, None, :], 1)[:, 0])
            raw = np.concatenate(pooled, 1) + self.bias
            hidden = np.maximum(raw, 0)
            logits = hidden @ self.dense + self.offset
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(BATCH), y] -= 1
            p /= BATCH
            back = (p @ self.dense.T) * (raw > 0)
            grads = []
            for k, weights in enumerate(self.filters):
                g = np.zeros_like(weights)
                for j in range(len(weights)):
                    seen = np.take_along_axis(x, where[k] + j, 1)
                    np.add.at(g[j], (seen, columns[None, :]), back[:, k * FILTERS : (k + 1) * FILTERS])
                grads.append(g)
            grads += [back.sum(0), hidden.T @ p + 1e-4 * self.dense, p.sum(0)]
            rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
            for i, g in enumerate(grads):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.01 * (g * g - second[i])
                params[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What a byte pair adds to every filter, at the front of the filter and two bytes further on."""
        front, rest = [], []
        for weights in self.filters:
            front.append(weights[0][:, None, :] + weights[1][None, :, :])
            later = np.zeros((256, 256, FILTERS), np.float32)
            if len(weights) > 2:
                later = later + weights[2][:, None, :]
            if len(weights) > 3:
                later = later + weights[3][None, :, :]
            rest.append(later)
        return tuple(np.ascontiguousarray(np.concatenate(t, 2).reshape(65536, -1)) for t in (front, rest))

    def predict(self, windows: np.ndarray, front: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        span, pooled = WINDOW - max(WIDTHS) + 1, []
        for i in range(0, len(windows), 64):
            x = windows[i : i + 64].astype(np.uint16)
            pairs = x[:, :-1] << 8 | x[:, 1:]
            out = front.take(pairs[:, :span], axis=0)
            out += rest.take(pairs[:, 2 : span + 2], axis=0)
            pooled.append(out.max(1))
        logits = np.maximum(np.concatenate(pooled) + self.bias, 0) @ self.dense + self.offset
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def cut_windows(data: bytes) -> np.ndarray:
    """All windows of a text, the last one filled up with zero bytes."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 4; remainder 2 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 4


def strange(window: bytes, k: int) -> bytes:
    """An example of no language made of a window: its bytes or letters shuffled, letters drawn at random, or the text
    carried over into another alphabet."""
    rng = np.random.default_rng(k)
    text = window.rstrip(b"\0").decode("utf-8", "ignore")
    letters = [c for c in text if c.isalpha()]
    kind = k % 5
    if kind == 0:
        return rng.permutation(np.frombuffer(window, np.uint8)).tobytes()
    if kind == 1:
        mixed = iter([letters[i] for i in rng.permutation(len(letters))])
        text = "".join(next(mixed) if c.isalpha() else c for c in text)
    elif kind == 2:
        text = "".join(chr(97 + int(rng.integers(26))) if c.isalpha() else c for c in text)
    else:
        first = ALPHABETS[k // 5 % len(ALPHABETS)]
        span = 26 if first < 0x3000 else 80 if first < 0x4E00 else 2000
        to: dict[str, str] = {}
        text = "".join(to.setdefault(c.lower(), chr(first + int(rng.integers(span)))) if c.isalpha() else c for c in text)
    return text.encode()[:WINDOW].ljust(WINDOW, b"\0")


def fit_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reject: bool = False
) -> ByteCnn | None:
    """Learns from rows outside the held-out fold whose language is known; None if there are none. With ``reject`` the
    class UNKNOWN is learned too, from as many strange() windows as an average language has."""
    known = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")
    ).where((fold() != 2) & F.col("lang").isNotNull())
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    rate = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, 1.2 * PER_LANGUAGE / counts[lang]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(F.col("text").isNotNull() & (draw < rate[F.col("lang")])).orderBy(
        F.xxhash64("doc_id", F.lit(4)), "doc_id", "text"
    )

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, chosen = [], []
            for key, text, lang in zip(*(column(batch, n).to_pylist() for n in ("doc_id", "text", "lang")), strict=True):
                data = text.encode()
                last = max(0, len(data) - WINDOW)
                starts = {zlib.crc32(f"{key}-{i}".encode()) % (last + 1) for i in range(WINDOWS_EACH)}
                if has_letter(text):
                    for start in sorted(starts):
                        langs.append(lang)
                        chosen.append(data[start : start + WINDOW].ljust(WINDOW, b"\0"))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(chosen, pa.binary())], ["lang", "window"])

    rows = sample.limit(2 * PER_LANGUAGE * len(languages)).mapInArrow(some, "lang string, window binary").collect()
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    windows = np.frombuffer(b"".join(r.window for r in rows), np.uint8).reshape(-1, WINDOW)
    labels = np.array([languages.index(r.lang) for r in rows])
    if reject:
        odd = [strange(rows[k].window, k) for k in range(0, len(rows), max(1, len(languages) // 2))]
        windows = np.concatenate([windows, np.frombuffer(b"".join(odd), np.uint8).reshape(-1, WINDOW)])
        labels = np.append(labels, np.full(len(odd), len(languages)))
        languages = [*languages, UNKNOWN]
    return ByteCnn(languages).fit(windows, labels)


def _predicted(texts: list[str | None], model: ByteCnn | None, tables) -> tuple[list[str], list[float]]:
    use = [i for i, t in enumerate(texts) if model and has_letter(t)]
    names, scores = [UND] * len(texts), [0.0] * len(texts)
    if use:
        data = [texts[i].encode() for i in use]
        windows = [cut_windows(d) for d in data]
        p = model.predict(np.concatenate(windows), *tables)
        weight = np.full(len(p), WINDOW, np.float64)
        ends = np.cumsum([len(w) for w in windows])
        weight[ends - 1] = [len(d) - WINDOW * (len(w) - 1) for d, w in zip(data, windows, strict=True)]
        sums = np.add.reduceat(p * weight[:, None], ends - [len(w) for w in windows], axis=0)
        mean = sums / sums.sum(1, keepdims=True)
        for i, row, best in zip(use, mean, mean.argmax(1), strict=True):
            names[i], scores[i] = model.languages[best], float(row[best])
    return names, scores


def predict_languages(docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred and score; columns of those names are replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*kept).schema
    rows = docs.select(*kept)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in slices(batches, text_col, 500_000):
            names, scores = _predicted(column(batch, text_col).to_pylist(), model, tables)
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score"])

    return rows.mapInArrow(predict, schema.add("lang_pred", "string").add("score", "double"))


def accept_languages(docs: DataFrame, model: ByteCnn | None, minimum: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents recognised as a learned language with at least ``minimum``; rows and columns unchanged.

    With a model that knows UNKNOWN, texts that look most like that are rejected. Without a model those with letters are.
    """

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in slices(batches, text_col, 500_000):
            names, scores = _predicted(column(batch, text_col).to_pylist(), model, tables)
            keep = [(n not in (UND, UNKNOWN) and s >= minimum) if model else n == UND for n, s in zip(names, scores, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(accept, docs.schema)
