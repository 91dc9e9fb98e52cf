"""Quality classification by co-training two views of a document.

The text view counts hashed byte trigrams of the whole text; the metadata view has the source, the
language and the magnitude of the length. A logistic model per view learns from a bounded sample of labelled
documents. In every round each model scores all documents, and the documents it is surest of (outside the
sample) become training rows of the other view's model. At the end each view is calibrated on the labelled
rows kept apart for that, and a logistic combination of the calibrated views scores every document.

Bounds, all parameters: LABELLED labelled documents, PSEUDO pseudo-labelled documents per round and class
(those with the smallest hashes among all that are sure), ROUNDS rounds. Features of all documents are
written once, and every round reads them whole.

Defined cases: null texts and null metadata are values like any other; a null quality is no label, and
several labels of a document are averaged; without labels of both classes every score is 0.5 and every
document is accepted. Repeated rows are scored once each, null ids are kept, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.common import NULL_ID, column, row_id, slices, staged

BINS = 1024
META = 128
LABELLED = 6000
PSEUDO = 1000
ROUNDS = 3
SURE = 0.98
#: A document is accepted from this calibrated score on.
ACCEPTED = 0.5
VIEWS = ("text", "meta")
META_NAME = "_metadata_view"


def text_features(texts: list[str | None]) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, in 255ths; one row of BINS bytes per text."""
    data = [(t or "").encode() for t in texts]
    out = np.zeros((len(data), BINS), np.float64)
    joined = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    if len(joined) > 2:
        codes = joined[:-2] * np.uint32(0x9E3779B1) + joined[1:-1] * np.uint32(0x85EBCA6B) + joined[2:] * np.uint32(0xC2B2AE35)
        codes = (codes ^ codes >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(22)
        at = 0
        for i, d in enumerate(data):
            if len(d) > 2:
                out[i] = np.bincount(codes[at : at + len(d) - 2], minlength=BINS) / (len(d) - 2)
            at += len(d)
    return np.minimum(255, np.rint(np.sqrt(out) * 255)).astype(np.uint8)


def _meta(docs: DataFrame) -> Column:
    """Indices of the hashed metadata values; columns that a table lacks count as empty."""
    have = set(docs.columns)
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    length = F.floor(2 * F.log2(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)) + 1.0)).cast("string")
    named = [F.xxhash64(F.lit(n), v) for n, v in (("source", value("source")), ("lang", value("lang")), ("length", length))]
    return F.array(*[F.pmod(h, F.lit(META)).cast("int") for h in named])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x_text and x_meta (indices of the metadata values that hold) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = text_features(column(batch, "text").to_pylist())
            columns = [column(batch, "doc_id"), pa.array([r.tobytes() for r in x], pa.binary()), column(batch, "x_meta")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "x_text", "x_meta"])

    rows = docs.select(row_id().alias("doc_id"), F.col("text").cast("string").alias("text"), _meta(docs).alias("x_meta"))
    return rows.mapInArrow(run, "doc_id long, x_text binary, x_meta array<int>")


def _matrix(view: str, values: list) -> np.ndarray:
    if view == "text":
        return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), BINS).astype(np.float32) / 255
    x = np.zeros((len(values), META), np.float32)
    for i, hits in enumerate(values):
        x[i, hits] = 1
    return x


@dataclass
class Logistic:
    weights: np.ndarray
    offset: float
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 250) -> Logistic:
        """Adam on all rows, classes weighted to equal shares."""
        mean, scale = x.mean(0), x.std(0) + 1e-3
        x = ((x - mean) / scale).astype(np.float32)
        weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
        w, b = np.zeros(x.shape[1], np.float32), 0.0
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for step in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
            r = weight * (p - y)
            g = np.append(x.T @ r.astype(np.float32) + penalty * w, r.sum())
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            move = 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w, b = w - move[:-1].astype(np.float32), b - move[-1]
        return cls(w, float(b), mean, scale)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.offset


def _platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression of y on the columns of z and a constant, by Newton's method."""
    z = np.column_stack([z, np.ones(len(z))])
    c = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(c))
        c -= np.linalg.solve(h, z.T @ (p - y) + 1e-2 * c)
    return c


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class CoTrained:
    """Calibrated models of both views and their combination."""

    models: dict[str, Logistic]
    calibration: dict[str, np.ndarray]
    combination: np.ndarray | None

    def view(self, name: str, values: list) -> np.ndarray:
        """Calibrated logits of one view."""
        a, b = self.calibration[name]
        return a * self.models[name].logits(_matrix(name, values)) + b

    def score(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = {v: self.view(v, column(batch, f"x_{v}").to_pylist()) for v in VIEWS}
        both = np.column_stack([z["text"], z["meta"], np.ones(len(z["text"]))]) @ self.combination
        return _sigmoid(z["text"]), _sigmoid(z["meta"]), _sigmoid(both)


def _rows(df: DataFrame, with_label: bool) -> tuple[dict[str, list], np.ndarray]:
    got = df.collect()
    return {v: [bytes(r.x_text) if v == "text" else r.x_meta for r in got] for v in VIEWS}, np.array(
        [r.y for r in got] if with_label else [], np.float64
    )


def co_train(feats: DataFrame, labels: DataFrame) -> CoTrained | None:
    """``feats`` as features() gives them, written; ``labels`` has doc_id and quality."""
    known = labels.select(row_id().alias("doc_id"), F.col("quality").cast("double").alias("q")).where("q IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.avg("q").alias("q")).select("doc_id", (F.col("q") >= 0.5).cast("double").alias("y"))
    # a bounded sample, so it may be broadcast
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(LABELLED)
    labelled = feats.join(F.broadcast(chosen), "doc_id")
    apart = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(3)) == 0
    order = (F.xxhash64("doc_id", F.lit(5)), "doc_id", "x_text")
    train, y = _rows(labelled.where(~apart).orderBy(*order).limit(LABELLED), True)
    held, y_held = _rows(labelled.where(apart).orderBy(*order).limit(LABELLED), True)
    if min(len(np.unique(y)), len(np.unique(y_held))) < 2:
        return None
    own = {v: (_matrix(v, train[v]), y) for v in VIEWS}
    models = {v: Logistic.fit(*own[v]) for v in VIEWS}
    rest = feats.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")

    def calibrated(v: str) -> np.ndarray:
        return _platt(models[v].logits(_matrix(v, held[v]))[:, None], y_held)

    for _ in range(ROUNDS):
        state = CoTrained(models, {v: calibrated(v) for v in VIEWS}, None)

        def judge(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "x_text"):
                names, columns = ["doc_id", "x_text", "x_meta"], list(batch.columns)
                for v in VIEWS:
                    columns.append(pa.array(_sigmoid(state.view(v, column(batch, f"x_{v}").to_pylist())), pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, [*names, "p_text", "p_meta"])

        judged = rest.select("doc_id", "x_text", "x_meta").mapInArrow(
            judge, "doc_id long, x_text binary, x_meta array<int>, p_text double, p_meta double"
        )
        side = lambda v: F.when(F.col(f"p_{v}") >= SURE, 1).when(F.col(f"p_{v}") <= 1 - SURE, 0)
        sure = judged.select("doc_id", "x_text", "x_meta", side("text").alias("s_text"), side("meta").alias("s_meta"))
        more = {}
        for giver, taker in (VIEWS, VIEWS[::-1]):
            parts = [
                sure.where(F.col(f"s_{giver}") == c).select("doc_id", "x_text", "x_meta", F.lit(float(c)).alias("y")).orderBy(*order).limit(PSEUDO)
                for c in (0, 1)
            ]
            got, gy = _rows(parts[0].unionAll(parts[1]), True)
            more[taker] = (_matrix(taker, got[taker]), gy) if len(gy) else (own[taker][0][:0], y[:0])
        for v in VIEWS:
            x, t = own[v]
            models = models | {v: Logistic.fit(np.concatenate([x, more[v][0]]), np.concatenate([t, more[v][1]]))}
    calibration = {v: calibrated(v) for v in VIEWS}
    final = CoTrained(models, calibration, None)
    return CoTrained(models, calibration, _platt(np.column_stack([final.view(v, held[v]) for v in VIEWS]), y_held))


def _scores(model: CoTrained | None, x: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return model.score(x) if model else tuple(np.full(x.num_rows, 0.5) for _ in range(3))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_score, meta_score, score (of the combination) and accepted (score of ACCEPTED or more)."""
    feats = staged(features(docs), "quality-features")
    model = co_train(feats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x_text"):
            columns = [column(batch, "doc_id"), *[pa.array(s, pa.float64()) for s in _scores(model, batch)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_score", "meta_score", "score"])

    scored = feats.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")
    ids = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id")
    return scored.select(ids, "text_score", "meta_score", "score", (F.col("score") >= ACCEPTED).alias("accepted"))


def accept_quality(docs: DataFrame, labels: DataFrame, minimum: float = ACCEPTED) -> DataFrame:
    """The documents that score at least ``minimum``, their columns unchanged; nothing is shuffled for it."""
    model = co_train(staged(features(docs), "quality-features"), labels)
    names, schema = docs.columns, docs.schema
    meta = META_NAME
    while meta in names:
        meta += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [pa.array([r.tobytes() for r in text_features(column(batch, "text").to_pylist())], pa.binary()), batch.column(batch.num_columns - 1)]
            score = _scores(model, pa.RecordBatch.from_arrays(x, ["x_text", "x_meta"]))[2]
            kept = pa.RecordBatch.from_arrays(batch.columns[:-1], names)
            yield kept.filter(pa.array(score >= minimum))

    return docs.select("*", _meta(docs).alias(meta)).mapInArrow(run, schema)
