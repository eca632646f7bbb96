import random

from martlight.llm import nearcopies, simhash


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def planted(n_base, seed=1):
    """Texts, and copies of them with a few words replaced; ``(id, text)`` and the pairs at 0.8 or more."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for base in range(n_base):
        text = rng.choices(words, k=rng.randint(60, 900))
        rows.append((10 * base, " ".join(text)))
        for copy in range(1, 3):
            other = list(text)
            for at in rng.sample(range(len(text)), max(1, len(text) // 50)):
                other[at] = "changed"
            rows.append((10 * base + copy, " ".join(other)))
            a, b = plain_shingles(rows[-1][1]), plain_shingles(" ".join(text))
            if len(a & b) >= 0.8 * len(a | b):
                pairs.append((10 * base, 10 * base + copy))
    return rows, pairs


def test_planted_near_copies_are_found(spark, documents):
    rows, pairs = planted(60)
    assert len(pairs) > 60
    found = dict(nearcopies.near_copies(documents(rows)).collect())
    assert all(found[a] == found[b] for a, b in pairs)
    assert all(found[i] // 10 == i // 10 for i, _ in rows)
    kept = {r["doc_id"] for r in simhash.keep_one(documents(rows)).collect()}
    assert not kept & {b for _, b in pairs}


def test_no_copy_of_a_crowd_stays(spark, documents):
    """600 near copies of one text with 0, 2, 3 or 4 of 200 words changed are one class; one row stays."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(900)]
    base = rng.choices(words, k=200)
    rows = []
    for i in range(600):
        text = list(base)
        for at in rng.sample(range(200), rng.choice([0, 2, 3, 4])):
            text[at] = rng.choice(words)
        rows.append((i, " ".join(text)))
    assert [r["doc_id"] for r in simhash.keep_one(documents(rows, extra=("_row", "row", "order"))).collect()] == [0]


def test_similar_needs_four_fifths():
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    assert nearcopies.similar(" ".join(words), " ".join(words[:-20]))  # 80 of 100
    assert not nearcopies.similar(" ".join(words), " ".join(words[:-21]))
    assert nearcopies.similar(None, " \n") and not nearcopies.similar("", "x") and nearcopies.similar("A b", "a  B")


def test_every_pair_of_the_table_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [(r["doc_id"], plain_shingles(r["text"])) for r in docs.collect()]
    found = dict(nearcopies.near_copies(docs).collect())
    pairs = [(a, b) for i, (a, x) in enumerate(texts) for b, y in texts[:i] if len(x & y) >= 0.8 * len(x | y)]
    assert pairs and all(found[a] == found[b] for a, b in pairs)


def test_fingerprints_give_the_first_pairs_and_all_are_verified(spark, documents, monkeypatch):
    """The class of near copies whose fingerprints lie within two bits is linked by SimHash, and only where full sets agree."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(words[::-1]), ""]
    seen = []
    inner = simhash.fingerprint_pairs
    monkeypatch.setattr(simhash, "fingerprint_pairs", lambda rows: seen.append(inner(rows)) or seen[-1])
    kept = simhash.keep_one(documents(list(enumerate(texts))))
    assert {r["doc_id"] for r in kept.collect()} == {0, 2, 3}
    nodes = [r[0] for r in spark.createDataFrame([(t,) for t in texts[:2]], "t string").selectExpr("xxhash64(t)").collect()]
    assert {frozenset(r) for r in seen[0].collect()} == {frozenset(nodes)}
