import random

import pytest
from pyspark.sql import functions as F

from martlight.llm import chosenpath


def plain_set(text, size):
    words = (text or "").encode().lower().split()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(rows, size=2, least=80):
    """Component of every id by comparing all pairs."""
    sets = [(i, plain_set(t, size)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and 100 * len(a & b) >= least * len(a | b):
                root[find(x)] = find(y)
    best = {}
    for x, (i, _) in enumerate(sets):
        best[find(x)] = min(best.get(find(x), i), i)
    return {i: (len(s), best[find(x)]) for x, (i, s) in enumerate(sets)}


def edited(rng, words, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.6:
            out[at] = rng.choice(words)
        elif kind < 0.8:
            out.insert(at, rng.choice(words))
        elif len(out) > 1:
            del out[at]
    return out


def corpus(seed, bases, copies):
    """Texts and copies with edits around the limit."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(bases):
        text = rng.choices(words, k=rng.choice([1, 3, 8, 30, 120, 400]))
        rows.append(text)
        for _ in range(rng.randint(0, copies)):
            rows.append(edited(rng, words, text, rng.randint(0, 1 + len(text) // 8)))
    rng.shuffle(rows)
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


def found(docs, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in chosenpath.similar_sets(docs, **options).collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_like_brute_force(spark, documents, size):
    rows = corpus(size, 150, 3)
    assert found(documents(rows), size=size) == brute(rows, size)


def test_crowd_of_near_copies_is_one_component(spark, documents):
    """600 copies of one text of 200 words with 0, 2, 3 or 4 words changed, and some that are too far away."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(900)]
    base = rng.choices(words, k=200)

    def changed(count):
        out = list(base)
        for at in rng.sample(range(200), count):
            out[at] = rng.choice(words)
        return " ".join(out)

    rows = [(i, changed(rng.choice([0, 2, 3, 4]))) for i in range(600)] + [(600 + i, changed(rng.randint(5, 30))) for i in range(60)]
    want = brute(rows, 5)
    assert found(documents(rows), size=5) == want and len({c for _, c in want.values()}) > 10


def test_a_crowd_is_verified_with_few_leaders(spark, documents, monkeypatch):
    """Pairs grow with the crowd, not with the crowd times its nodes, and classes are carried on without old links."""
    pairs, verified = [], chosenpath._verified
    monkeypatch.setattr(chosenpath, "_verified", lambda p, *a: pairs.append(p.distinct().count()) or verified(p, *a))
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    base = rng.choices(words, k=200)
    rows = []
    for i in range(400):
        text = list(base)
        text[rng.randrange(200)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    got = found(documents(rows))
    assert {c for _, c in got.values()} == {0}
    assert 390 <= sum(pairs) <= 2 * 400


def test_unrelated_texts_that_share_passages_branch(spark, documents, monkeypatch):
    """Many documents around a common passage: nodes are too large to be compared and go down the tree."""
    depths = []
    branched = chosenpath._branched
    monkeypatch.setattr(chosenpath, "_branched", lambda *a: depths.append(1) or branched(*a))
    monkeypatch.setattr(chosenpath, "SMALL", 12)
    monkeypatch.setattr(chosenpath, "LISTED", 0)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=60)
    rows = []
    for _ in range(160):
        text = passage + rng.choices(words, k=rng.randint(25, 60))
        rows.append(text)
        if rng.random() < 0.2:
            rows.append(edited(rng, words, text, 3))
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    want, got = brute(rows), found(documents(rows))
    assert depths
    linked = [i for i, (_, c) in want.items() if c != i]
    assert sum(got[i] == want[i] for i in linked) >= 0.95 * len(linked) > 0
    assert all(got[i] == want[i] for i, (_, c) in want.items() if c == i)


def test_last_depth_is_exhaustive(spark, documents, monkeypatch):
    monkeypatch.setattr(chosenpath, "SMALL", 1)
    monkeypatch.setattr(chosenpath, "DEEPEST", chosenpath.DEPTH)
    rows = corpus(8, 60, 12)
    assert found(documents(rows)) == brute(rows)


def test_a_pair_at_the_limit_keeps_a_common_node():
    """Two sets at exactly 0.8: the share of pairs without a common first node is as small as the docstring says."""
    import numpy as np

    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(4000):
        x = np.unique(rng.integers(0, 1 << 63, 90, dtype=np.uint64))
        sets = [x[:80], np.concatenate([x[:72], x[80:88]]), x[:80]]
        least = np.stack([chosenpath._least(s, chosenpath._OFFSETS, chosenpath._FACTORS) for s in sets])
        paths = chosenpath._first_paths(least)
        missed += not set(paths[0]) & set(paths[1])
        assert set(paths[0]) == set(paths[2])
    assert missed <= 4  # 72 of 88 common; 4,000 pairs


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows, extra=("node", "key", "component_id", "n"))
    rows = chosenpath.similar_sets(docs).collect()
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in rows)
    sizes = {i: len(plain_set(t, 2)) for i, t in odd_rows if i}
    assert got == sorted(
        [(0, 0, 0), (0, sizes[5], 5), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, sizes[4], 4), (5, sizes[5], 5), (5, sizes[5], 5), (6, sizes[6], 5), (7, 1, 7)]
    )
    assert chosenpath.similar_sets(documents([])).count() == 0
    joined = found(documents([(1, None), (2, " "), (3, "x y z")]), link_empty=True)
    assert joined == {1: (0, 1), 2: (0, 1), 3: (2, 3)}


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in chosenpath.op13_chosen_path(spark, folder).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}
    assert docs.where(F.col("doc_id").isNull()).isEmpty()


def test_a_crowd_with_distant_ends_is_not_compared_pairwise(spark, documents, monkeypatch):
    """A crowd around one text whose outer members are linked through others only: few pairs are left for the last step."""
    left, exhaustive = [], chosenpath._exhaustive
    monkeypatch.setattr(chosenpath, "_exhaustive", lambda *a: left.append(exhaustive(*a).count()) or exhaustive(*a))
    rng = random.Random(7)
    words = [f"w{i}" for i in range(900)]
    base = rng.choices(words, k=120)
    rows = []
    for i in range(400):
        text = list(base)
        for _ in range(rng.choice([1, 3, 5, 6])):
            text[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    assert found(documents(rows)) == brute(rows)
    assert sum(left) <= 2000, left


def test_short_edge_lists_stay_in_one_partition(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)], "a long, b long").repartition(7)
    roots = chosenpath.components(edges)
    assert roots.rdd.getNumPartitions() == 1
    assert {(r["node"], r["root"]) for r in roots.collect()} == {(i, 0) for i in range(1, 201)}


def test_long_lists_of_texts_are_not_held_by_the_driver(spark):
    texts = spark.range(10).selectExpr("id AS node", "'x' AS text")
    few, many = (chosenpath._texts_of(texts, spark.range(n).toDF("node")) for n in (1000, 150_000))
    assert "strategy=broadcast" in few._jdf.queryExecution().logical().toString()
    assert "strategy=broadcast" not in many._jdf.queryExecution().logical().toString()
    assert few.count() == many.count() == 10
