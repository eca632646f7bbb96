import numpy as np
import pytest

from martlight.llm import toxicity


def corpus(n, seed, langs=("en",)):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "ba de ki lo mu".split() for b in "ran sel tip vok wum zan".split()]
    bad = ["vilest", "rotten", "filthiest"]
    docs, labels, tongues = [], [], []
    for i in range(n):
        text = list(rng.choice(words, rng.integers(20, 120)))
        toxic = i % 3 == 0
        for w in rng.choice(bad, 3 if toxic else int(rng.random() < 0.2)):
            text.insert(int(rng.integers(0, len(text))), w)
        docs.append(" ".join(text))
        labels.append(int(toxic))
        tongues.append(langs[i % len(langs)])
    return docs, labels, tongues


@pytest.fixture(scope="module")
def model():
    docs, labels, tongues = corpus(600, 0)
    return toxicity.train([toxicity.word_codes(d) for d in docs], labels, tongues, seed=1)


def test_held_out_documents(model):
    docs, labels, _ = corpus(300, 9)
    found = model.scores([toxicity.word_codes(d) for d in docs]) >= toxicity.CUT
    assert (found == np.array(labels).astype(bool)).mean() >= 0.97


def test_pooling_takes_the_two_largest_of_each_document(model):
    docs = [toxicity.word_codes(t) for t in ("one", "two words", "", "some more words than two filters are wide")]
    together = model.pooled(docs)
    for i, doc in enumerate(docs):
        alone = model.pooled([doc])
        assert np.allclose(together[i], alone[0], atol=1e-6)
    x = np.concatenate([t[[c >> (toxicity.BITS * k) & toxicity.BUCKETS - 1 for c in docs[3]]] for k, t in enumerate(model.tables)], axis=1)
    first = np.sort(x @ model.filters[0], axis=0)[::-1]
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    assert np.allclose(together[3][: toxicity.FILTERS], first[0], atol=1e-5)
    assert np.allclose(together[3][n : n + toxicity.FILTERS], first[1], atol=1e-5)


def test_thresholds_lie_at_the_cut(model):
    model_limits = dict(model.limits)
    model.limits, before = {"en": 0.7}, model.limit
    p, lang = model.raw([toxicity.word_codes("baran vilest rotten desel")])
    score = model.scores([toxicity.word_codes("baran vilest rotten desel")])[0]
    assert (score >= toxicity.CUT) == (p[0] >= 0.7)
    model.limits, model.limit = model_limits, before


def test_best_limit_is_in_the_gap():
    p, y = np.array([0.9, 0.8, 0.4, 0.1]), np.array([1, 1, 0, 0])
    assert 0.4 < toxicity._best_limit(p, y) < 0.8


def test_odd_rows(spark, documents, odd_rows, model):
    rows = toxicity.score(documents(odd_rows, extra=("score", "toxic")), model).collect()
    assert len(rows) == len(odd_rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.score(documents([]), model).count() == 0


def test_fit_takes_repeated_and_missing_labels(spark, documents):
    docs, labels, _ = corpus(120, 4)
    table = documents([(i, d) for i, d in enumerate(docs)])
    marks = spark.createDataFrame([(i, v) for i, v in enumerate(labels)] + [(0, 0), (None, 1), (5, None), (10**6, 1)], "doc_id long, toxic int")
    model = toxicity.fit(table, marks, per_class=(60, 60))
    assert model.langs == ["en"]
    empty = toxicity.fit(table, marks.limit(0))
    assert toxicity.score(table, empty).count() == 120


def test_gradients_match_differences():
    docs, labels, tongues = corpus(24, 3, ("en", "fr"))
    codes = [toxicity.word_codes(d) for d in docs]
    y, tongue = np.array(labels, np.float32), np.array([{"en": 0, "fr": 1}[t] if i else -1 for i, t in enumerate(tongues)])
    model = toxicity.TextCNN.fresh(["en", "fr"], 5)
    grads, touched = toxicity.gradients(model, codes, y, tongue)
    assert np.isclose(grads["out_bias"], _difference(model, "out_bias", None, codes, y, tongue), rtol=0.02, atol=2e-4)
    weights = {"lang": model.lang_out, "out": model.out, "bias": model.bias}
    weights |= {f"filter{w}": f for w, f in zip(toxicity.WIDTHS, model.filters)}
    checked = [(weights[name], grad) for name, grad in grads.items() if name != "out_bias"]
    for table, (rows, grad) in zip(model.tables, touched):
        full = np.zeros_like(table)
        full[rows] = grad
        checked.append((table, full))
    for array, grad in checked:
        for flat in np.argsort(-np.abs(grad).ravel())[:4]:
            at = np.unravel_index(flat, grad.shape)
            assert np.isclose(grad[at], _difference(model, array, at, codes, y, tongue), rtol=0.05, atol=5e-4)


def _difference(model, where, at, codes, y, tongue, step=5e-4):
    def moved(by):
        if at is None:
            setattr(model, where, getattr(model, where) + by)
        else:
            where[at] += by

    values = []
    for by in (step, -2 * step):
        moved(by)
        values.append(toxicity.loss(model, codes, y, tongue))
    moved(step)
    return (values[0] - values[1]) / (2 * step)


def test_pieces_give_what_the_whole_text_gives(model, monkeypatch):
    docs = [toxicity.word_codes(d) for d in [*corpus(20, 8)[0], "", "one"]]
    whole = model.pooled(docs)
    for piece, block in ((7, 16), (1, 3), (64, 50)):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert np.allclose(model.pooled_whole(docs), whole, atol=1e-5)


def test_long_text_takes_bounded_memory(model):
    import tracemalloc

    text = "baran desel kitip " * 550_000  # ten million characters
    tracemalloc.start()
    model.scores([toxicity.word_codes(text)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_small_samples_find_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op9_cnn_toxicity(spark, sf).where("held_out").join(marks, "doc_id").collect()
    toxic, clean = [r["predicted"] for r in rows if r["toxic"]], [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(toxic) >= 0.5 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_thresholds_without_documents_are_one_half():
    model = toxicity.TextCNN.fresh(["en"])
    toxicity._calibrate(model, [], np.zeros(0))
    assert model.limit == 0.5
    toxicity._calibrate(model, [toxicity.word_codes("one word")], np.zeros(1))
    assert model.limit == 0.5 and model.limits == {"en": 0.5}


def test_all_labelled_documents_are_learnt(spark, documents, monkeypatch):
    learnt = []
    monkeypatch.setattr(toxicity, "train", lambda docs, y, lang: learnt.extend(zip(map(len, docs), y)) or toxicity.TextCNN.fresh(["en"]))
    table = spark.range(10_000).selectExpr("id as doc_id", "'some words' as text", "'en' as lang")
    table = table.unionByName(spark.sql("select 10000l as doc_id, repeat('one more ', 3000) as text, 'en' as lang"))
    toxicity.fit(table, table.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    assert len(learnt) == 10_001 and sum(y for _, y in learnt) == 5000 and (6000, 0) in learnt


def test_parts_learn_together(spark, documents, monkeypatch):
    docs, labels, tongues = corpus(900, 2, ("en", "fr"))
    table = spark.createDataFrame(list(zip(range(900), docs, tongues)), "doc_id long, text string, lang string").repartition(5)
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    for name, value in (("ALONE", 0), ("PART_CHARS", 1), ("PART_DOCS", 300), ("HELD_DOCS", 128), ("STEPS", 40)):
        monkeypatch.setattr(toxicity, name, value)
    seen = []
    monkeypatch.setattr(toxicity, "_train_parts", lambda coded, langs, parts, run=toxicity._train_parts: seen.append((coded.count(), parts)) or run(coded, langs, parts))
    model = toxicity.fit(table, marks)
    assert seen == [(900, 3)] and model.langs == ["en", "fr"]
    docs, labels, _ = corpus(300, 9)
    found = model.scores([toxicity.word_codes(d) for d in docs]) >= toxicity.CUT
    assert (found == np.array(labels).astype(bool)).mean() >= 0.95
