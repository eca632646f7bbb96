import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlight.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.fit(docs.where(~langid.held_out_column()), docs_per_lang=150, max_words=12_000)


def test_gradients_match_differences():
    model = langid.ByteGRU.fresh(["a", "b", "c"], 5, seed=2)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 101, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    _, grads = model.gradients(x, y)
    for name, g in grads.items():
        place = (int(x[0, 1]), 2) if name[0] == "E" else tuple(int(rng.integers(0, n)) for n in g.shape)
        weights = model.weights[name]
        weights[place] += 1e-5
        high = model.gradients(x, y)[0]
        weights[place] -= 2e-5
        low = model.gradients(x, y)[0]
        weights[place] += 1e-5
        assert (high - low) / 2e-5 == pytest.approx(g[place], rel=1e-4, abs=1e-9)


def test_words_cover_every_byte_outside_white_space():
    text = "Ab é\x0bccc " + "x" * 100 + "\n\ty"
    assert b"".join(langid.words_of(text)) == re.sub(rb"[\x20\x09-\x0d]", b"", text.encode())
    assert max(map(len, langid.words_of(text))) <= langid.PIECE


def test_store_equals_the_network_byte_by_byte(model):
    text = "the thing is that and the and vielleicht " + "y" * 70
    total = np.zeros(len(model.langs))
    for word in langid.words_of(text):
        total += model.positions(np.frombuffer(word, np.uint8)[None, :])[:, 0].astype(float).sum(axis=0)
    total /= sum(map(len, langid.words_of(text)))
    lang, score = langid.WordScores(model).documents([text])[0]
    assert lang == model.langs[int(total.argmax())] and score == pytest.approx(total.max(), abs=1e-5)


def test_store_forgets_without_changing_scores(model, monkeypatch):
    texts = ["the of and that", "der die und das", "le la les des", "the of and that"]
    want = langid.WordScores(model).documents(texts)
    monkeypatch.setattr(langid, "WORDS", 2)
    store = langid.WordScores(model)
    assert [store.documents([t])[0][0] for t in texts] == [w[0] for w in want]


def test_spans_label_every_byte(model):
    text = "the thing und das à"
    spans = langid.label_spans(model, text)
    assert sum(b - a for a, b, _ in spans) == len(text.replace(" ", "").encode())


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(langid.held_out_column())
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, documents, odd_rows, model):
    rows = langid.identify(documents([*odd_rows, (8, "123 ###")], extra=("score", "lang_pred")), model).collect()
    assert len(rows) == len(odd_rows) + 1
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3, 8))
    assert all(r["lang_pred"] != "und" for r in rows if r["doc_id"] in (4, 5, 6, 7))
    assert langid.identify(documents([]), model).count() == 0


def test_letters():
    assert all(map(langid.has_letter, ("a", "12 é", "\u00aa", "漢")))
    assert not any(map(langid.has_letter, (None, "", "12 ##", "\u00b2 \u2167", "_")))


def test_nothing_to_learn_from(spark, documents):
    empty = documents([(1, "some text")]).withColumn("lang", F.lit(None).cast("string"))
    model = langid.fit(empty)
    assert [tuple(r) for r in langid.identify(empty, model).collect()] == [(1, "und", 0.0)]
    assert langid.keep_known(empty, model).count() == 0


def test_keep_known(spark, documents, model):
    docs = documents([(1, "the thing that is of the and in the was"), (2, "12 34"), (3, None)], extra=("x",))
    kept = langid.keep_known(docs.withColumn("lang", F.lit("zz")), model)
    assert kept.columns == docs.columns
    assert [(r["doc_id"], r["lang"]) for r in kept.collect()] == [(1, "en")]
