"""Chat snapshots against SQL, the language network on held-out rows, co-training on labelled rows."""

import brute
import duckdb
import numpy as np
import pytest

from gridsieve.llm import chat, cotrain, langid
from gridsieve.llm.queries import ORACLES, QUERIES

CHATS = [
    # 1 is a prefix of 2 and of 3; 4 equals 2; 5 shares the first turn only
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 5, "user", "more"), (3, 9, None, None),
    (4, 0, "user", "hi"), (4, 1, "assistant", "hello"), (4, 2, "user", "bye"),
    (5, 0, "user", "hi"), (5, 1, "assistant", "HELLO"),
    (6, None, "system", "no turn"), (6, 0, "user", "<|im_end|> break"),
    (7, 0, "user", None), (7, 0, "user", None), (7, 1, "user", ""),
    (None, 0, "user", "a conversation without id"),
    (8, 0, "user", "x" * 50_000),
]


def chats(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, position int")


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_chats_against_sql(spark, sf_dir):
    columns = "conv_id, n_turns, n_copies, text"
    for rows in (CHATS, []):
        con = duckdb.connect()
        con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        if rows:
            con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        want = con.execute(f"SELECT {columns} FROM ({chat.SQL})").fetchall()
        got = chat.format_chats(chats(spark, rows)).collect()
        assert sorted_rows(got) == sorted_rows(want) and bool(got) == bool(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.execute(f"SELECT {columns} FROM ({ORACLES['op2_chat_format']})").fetchall()
    assert sorted_rows(QUERIES["op2_chat_format"](spark, sf_dir).collect()) == sorted_rows(want)


def test_chat_snapshots(spark):
    got = {r.conv_id: r for r in chat.format_chats(chats(spark, CHATS)).collect()}
    assert set(got) == {2, 3, 5, 6, 7, 8, None}
    assert got[2].n_copies == 2 and got[3].n_turns == 4
    assert got[6].text == "<|im_start|>system\nno turn<|im_end|>\n<|im_start|>user\n< |im_end|> break<|im_end|>\n"
    assert got[7].n_turns == 2


def test_chat_plan_is_native(spark):
    plan = chat.format_chats(chats(spark, CHATS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_languages_held_out(spark, sf_dir):
    got = QUERIES["op3_language_id"](spark, sf_dir).toPandas().set_index("doc_id")
    docs = brute.read(spark, sf_dir, "documents").toPandas().set_index("doc_id")
    import zlib

    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]
    held = got[got.held_out]
    assert (held.lang_pred == docs.lang.loc[held.index]).mean() >= 0.95
    assert got.score.between(0, 1).all() and len(got) == len(docs)


def test_languages_of_odd_rows(spark, sf_dir):
    model = langid.fit_languages(brute.read(spark, sf_dir, "documents"))
    odd = brute.odd_docs(spark)
    got = langid.predict_languages(odd, model)
    assert got.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"]
    found = {r.doc_id: r for r in got.collect()}
    for key in (2, 3, 4, 5):
        assert found[key].lang_pred == "und" and found[key].score == 0
    assert found[10].lang_pred in model.languages and found[None].lang_pred in model.languages
    assert got.count() == len(brute.ODD_DOCS)
    assert langid.fit_languages(brute.empty_docs(spark)) is None
    assert {r.lang_pred for r in langid.predict_languages(odd, None).collect()} == {"und"}
    assert langid.predict_languages(brute.empty_docs(spark), model).count() == 0
    # labels are never an input
    other = langid.predict_languages(odd.withColumnRenamed("lang", "tongue"), model).select("doc_id", "lang_pred").collect()
    assert sorted(map(str, other)) == sorted(map(str, got.select("doc_id", "lang_pred").collect()))


def test_long_texts_are_read_whole(spark, sf_dir):
    docs = brute.read(spark, sf_dir, "documents")
    model = langid.fit_languages(docs)
    by = docs.toPandas().groupby("lang").text.apply(lambda t: " ".join(t)[:20_000])
    mixed = by["de"][:3_000] + " " + by["fr"]
    row = langid.predict_languages(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert row.lang_pred == "fr" and row.score < 0.95


def test_quality_on_labels(spark, sf_dir):
    got = QUERIES["op6_quality"](spark, sf_dir).toPandas()
    labels = brute.read(spark, sf_dir, "labels").toPandas()
    both = got.merge(labels, on="doc_id")
    assert (both.accepted == (both.quality == 1)).mean() >= 0.9
    good, bad = both[both.quality == 1].score.values, both[both.quality == 0].score.values
    assert (good[:, None] > bad[None, :]).mean() >= 0.95
    assert len(got) == brute.read(spark, sf_dir, "documents").count()


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (6, 1), (99, 0)], "doc_id long, quality int")
    got = cotrain.score_quality(brute.odd_docs(spark), labels)
    assert got.count() == len(brute.ODD_DOCS)
    assert got.where("score NOT BETWEEN 0 AND 1").count() == 0
    none = cotrain.score_quality(brute.odd_docs(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and all(r.accepted for r in none)
    assert sum(r.doc_id is None for r in none) == 1
    assert cotrain.score_quality(brute.empty_docs(spark), labels).count() == 0
    kept = cotrain.accept_quality(brute.odd_docs(spark), labels.limit(0))
    assert kept.columns == brute.odd_docs(spark).columns and kept.count() == len(brute.ODD_DOCS)


def test_platt_is_monotone():
    z = np.linspace(-3, 3, 200)
    a, b = cotrain._platt(z[:, None], (z > 0.5).astype(float))
    assert a > 0 and -b / a > 0


def test_network_equals_a_plain_forward_pass(spark, sf_dir):
    """Convolution window by window and filter by filter, on every document."""
    docs = brute.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit_languages(docs)
    span = langid.WINDOW - max(langid.WIDTHS) + 1

    def forward(window):
        pooled = []
        for weights in model.filters:
            out = np.zeros((span, langid.FILTERS))
            for at in range(span):
                out[at] = sum(weights[j][window[at + j]].astype(np.float64) for j in range(len(weights)))
            pooled += [max(out[:, f]) for f in range(langid.FILTERS)]
        hidden = [max(0.0, p + b) for p, b in zip(pooled, model.bias, strict=True)]
        logits = np.array([sum(h * w for h, w in zip(hidden, column, strict=True)) for column in model.dense.T]) + model.offset
        e = np.exp(logits - logits.max())
        return e / e.sum()

    rows = langid.predict_languages(docs, model).collect()
    seen = 0
    for r in rows:
        data = (r.text or "").encode()
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = np.zeros(len(model.languages))
        for at in range(0, len(data), langid.WINDOW):
            piece = data[at : at + langid.WINDOW]
            total += len(piece) * forward(piece.ljust(langid.WINDOW, b"\0"))
        total /= total.sum()
        seen += 1
        assert r.score == pytest.approx(total.max(), abs=1e-4)
        assert r.lang_pred == model.languages[int(total.argmax())] or np.sort(total)[-2] > total.max() - 1e-4
    assert seen > 0.9 * len(rows)


def test_quality_equals_a_plain_forward_pass(spark, sf_dir):
    """Hashed trigrams counted one by one, both logistic views and their combination, on every document."""
    docs, labels = brute.read(spark, sf_dir, "documents"), brute.read(spark, sf_dir, "labels")
    feats = cotrain.staged(cotrain.features(docs), "t-features")
    model = cotrain.co_train(feats, labels)
    hits = {r.doc_id: list(r.x_meta) for r in feats.select("doc_id", "x_meta").collect()}
    got = {r.doc_id: r for r in cotrain.score_quality(docs, labels).collect()}
    mask = 0xFFFFFFFF

    def trigrams(text):
        data, counts = (text or "").encode(), [0] * cotrain.BINS
        for a, b, c in zip(data, data[1:], data[2:], strict=False):
            h = (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & mask
            counts[((h ^ h >> 15) * 0x2C1B3C6D & mask) >> 22] += 1
        n = max(1, len(data) - 2)
        return [min(255, round((c / n) ** 0.5 * 255)) / 255 for c in counts]

    def logit(view, x):
        m, (a, b) = model.models[view], model.calibration[view]
        z = sum((v - u) / s * w for v, u, s, w in zip(x, m.mean, m.scale, m.weights, strict=True)) + m.offset
        return a * z + b

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for r in docs.select("doc_id", "text").collect():
        t = logit("text", trigrams(r.text))
        m = logit("meta", [1.0 if i in hits[r.doc_id] else 0.0 for i in range(cotrain.META)])
        both = model.combination @ np.array([t, m, 1.0])
        row = got[r.doc_id]
        assert (row.text_score, row.meta_score, row.score) == pytest.approx((sigmoid(t), sigmoid(m), sigmoid(both)), abs=2e-3)
        assert row.accepted == (row.score >= cotrain.ACCEPTED)
