"""The pipeline's stages on the given tables and on awkward rows."""

import brute
import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from gridsieve.llm import cotrain
from gridsieve.llm.common import staged


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_stages(spark, sf_dir):
    docs = brute.read(spark, sf_dir, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r for r in brute.read(spark, sf_dir, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before) and docs.count() == len(after)
        gone = set(before) - set(after)
        if name == "language_id":
            lettered = [d for d in gone if any(map(str.isalpha, before[d].text or ""))]
            assert len(lettered) <= 0.01 * len(before)
            assert all(any(map(str.isalpha, r.text or "")) for r in after.values())
        if name == "quality_classifier":
            good = [d for d in labels if d in before and labels[d].quality == 1]
            bad = [d for d in labels if d in before and labels[d].quality == 0]
            assert np.mean([d in gone for d in good]) <= 0.03 and np.mean([d in gone for d in bad]) >= 0.7
        if name == "simhash_near_dedup":
            sets = {d: shingle_set(r.text) for d, r in before.items()}
            like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            keys = sorted(after)
            left = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if like(a, b) >= 0.8]
            assert len(left) == 0
            assert all(max(like(d, o) for o in before if o != d) >= 0.8 for d in gone)
        if name == "suffix_array_dedup":
            keys = sorted(before)
            want = brute.repeats([before[d].text for d in keys])
            for d, (n_bytes, removed, _, _) in zip(keys, want, strict=True):
                assert n_bytes - removed - 3 * 100 <= len(after[d].text.encode()) <= n_bytes - removed
                assert after[d].n_chars == len(after[d].text) and (removed or after[d].text == before[d].text)
            assert not gone
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p.doc_id for p in pieces} == set(before)
    assert all(len(p.ids) == 4 * p.length for p in pieces)


STRANGE = {
    1: "Привет, это обычный русский текст о погоде и о том, как мы живём в большом городе. " * 3,
    2: "これは日本語の文章です。今日は天気がいいですね。散歩に行きましょう。" * 4,
    3: "Ελληνικό κείμενο για τη δοκιμή της γλώσσας και τίποτα άλλο σήμερα. " * 3,
    4: "这是一个中文文本，用于测试语言识别。今天天气很好。" * 4,
    5: "qzx wvkp jjrtl xkcd bvnm zzqw plkj hgfd qwrt zxcv mnbv lkjh " * 4,
}


def test_language_stage_rejects_what_it_has_not_learned(spark, sf_dir):
    docs = brute.read(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(-k, t, None, "web", len(t)) for k, t in STRANGE.items()], docs.schema)
    kept = corpus_pipeline.identify_language(spark, docs.unionAll(odd), sf_dir).where("doc_id < 0").collect()
    assert kept == []


def test_odd_rows_and_empty_tables(spark, sf_dir):
    names = ["score", "lang_pred", "_key", "_version", "_metadata_view", "node", "row", "version"]
    docs = brute.odd_docs(spark)
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names) if c != "score"])
    learned = brute.read(spark, sf_dir, "documents").select("doc_id", "text", "lang").limit(60)
    more = learned.select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", F.lit("web").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs = staged(docs.unionByName(more, allowMissingColumns=True), "t-odd")
    whole = {(r.doc_id, r.text): r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        assert docs.columns == next(iter(whole.values())).__fields__
        rows = docs.collect()
        if name == "suffix_array_dedup":
            assert {r.doc_id for r in rows} == {d for d, _ in whole}
        else:
            assert all(whole[r.doc_id, r.text] == r for r in rows)
        if name == "language_id":
            assert not {r.doc_id for r in rows} & {2, 3, 4, 5} and len(rows) >= 50
        if name == "simhash_near_dedup":
            assert sum(r.doc_id == 9 for r in rows) <= 1
        whole = {(r.doc_id, r.text): r for r in rows}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p.doc_id for p in pieces} == {d for d, _ in whole}
    empty = brute.empty_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        empty = staged(stage(spark, empty, sf_dir), name)
        assert empty.count() == 0 and (name == "packing" or empty.columns == brute.empty_docs(spark).columns)


def test_run(spark, sf_dir):
    docs = brute.read(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    pieces = corpus_pipeline.run(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    ids = brute.encode([r.text for r in docs.select("doc_id", "text").orderBy("doc_id").collect()])
    want = dict(zip(sorted(r.doc_id for r in docs.select("doc_id").collect()), (len(i) + 1 for i in ids), strict=True))
    assert {r.doc_id: r.n for r in pieces} == want


def test_quality_stage_rejects_what_the_classifier_rejects(spark, tmp_path):
    """A third of the doubtful documents are good: they score between 0.25 and 0.5."""
    rng, docs, labels = np.random.default_rng(3), [], []
    for i in range(900):
        kind = ("good", "bad", "doubtful")[i % 3]
        words = rng.choice([f"{kind}{k}" for k in range(20)], 60)
        docs.append((i, " ".join(words), "en", kind))
        labels.append((i, float(kind == "good" or kind == "doubtful" and i % 9 == 2)))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame(labels, "doc_id long, quality double")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    scored = cotrain.score_quality(docs, labels).collect()
    assert sum(0.25 <= r.score < 0.5 for r in scored) > 100
    kept = {r.doc_id for r in corpus_pipeline.filter_quality(spark, docs, str(tmp_path)).collect()}
    assert kept == {r.doc_id for r in scored if r.accepted}
