"""Pairs, unseen items and recommendations against brute force, including a huge basket."""

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from martlight.operators import pairs as p
from martlight.plans import recommender as r

pytestmark = pytest.mark.usefixtures("many_ranges")


@pytest.fixture(scope="module")
def lines():
    """Small baskets, and one order with a third of all rows, half of them products sold only there."""
    rng = np.random.default_rng(5)
    rows = [(o, int(x)) for o in range(1, 80) for x in rng.integers(0, 60, rng.integers(1, 5))]
    hot = [(0, int(x)) for x in rng.permutation(60)[:40]] + [(0, 1000 + i) for i in range(40)]
    return sorted(set(rows)) + rows[:10] + hot


@pytest.fixture(scope="module")
def items(spark, lines):
    frame = pd.DataFrame(lines, columns=["order_id", "product_id"])
    return spark.createDataFrame(frame).repartition(3)


def brute(lines):
    baskets = {}
    for order, product in lines:
        baskets.setdefault(order, set()).add(product)
    both = Counter(pair for b in baskets.values() for pair in combinations(sorted(b), 2))
    single = Counter(x for b in baskets.values() for x in b)
    return baskets, both, single


@pytest.mark.parametrize("block", [3, 17, 1000])
def test_blocks_do_not_change_the_pairs(items, lines, block):
    got = p.co_purchase_pairs(p.baskets(items), block).collect()
    assert {(x[0], x[1]): x[2] for x in got} == brute(lines)[1]
    assert len(got) == len(brute(lines)[1])


@pytest.mark.parametrize("k", [5, 40, 300])
def test_class_trimming_keeps_the_top_pairs(items, lines, k):
    _, both, single = brute(lines)
    kept = p.rankable_baskets(p.baskets(items), k, block=20)
    assert kept.count() < p.baskets(items).count() or k == 300
    got = {(x[0], x[1]): x[2] for x in p.co_purchase_pairs(kept, 20).collect()}

    def top(counts, rank):
        return sorted(counts, key=lambda pair: (-rank(pair), pair))[:k]

    def jac(pair):
        return both[pair] / (single[pair[0]] + single[pair[1]] - both[pair])

    assert top(got, both.get) == top(both, both.get)
    assert top(got, jac) == top(both, jac)


@pytest.mark.parametrize("k", [3, 25, 400])
@pytest.mark.parametrize("block", [4, 20, 1000])
def test_top_pairs_equal_brute_force(items, lines, k, block):
    _, both, single = brute(lines)

    def jac(pair):
        return both[pair] / (single[pair[0]] + single[pair[1]] - both[pair])

    for by, rank in (("co_purchase_orders", both.get), ("similarity", jac)):
        got = [(x["product_a"], x["product_b"]) for x in p.top_pairs(p.baskets(items), k, by, block).collect()]
        assert got == sorted(both, key=lambda pair: (-rank(pair), pair))[:k]


@pytest.mark.parametrize("by", ["co_purchase_orders", "similarity"])
def test_huge_order_with_different_order_sets_is_not_paired_up(spark, by, monkeypatch):
    n = 600
    lines = [(0, x) for x in range(n)] + [(1 + x, x) for x in range(n) for _ in range(1)] + [(1 + n + x // 2, x) for x in range(40)]
    lines += [(5000 + x, x) for x in range(0, n, 3)]
    built = []
    original = p.fresh_pairs

    def counted(*args):
        out = original(*args)
        built.append(out.count())
        return out

    monkeypatch.setattr(p, "fresh_pairs", counted)
    basket = p.baskets(spark.createDataFrame(lines, "order_id long, product_id long"))
    got = [(x["product_a"], x["product_b"]) for x in p.top_pairs(basket, 30, by, 100).collect()]
    _, both, single = brute(lines)

    def rank(pair):
        return both[pair] if by == "co_purchase_orders" else both[pair] / (single[pair[0]] + single[pair[1]] - both[pair])

    assert got == sorted(both, key=lambda pair: (-rank(pair), pair))[:30]
    assert built[0] < n * n / 2 / 8


def test_nth_unseen(spark):
    rng = np.random.default_rng(8)
    order = list(rng.permutation(30))
    seen = {k: set(rng.choice(30, s, replace=False).tolist()) for k, s in enumerate([0, 1, 5, 12, 25])}
    seen[5] = set(order[:10])
    ranking = spark.createDataFrame([(int(x), i + 1) for i, x in enumerate(order)], "item long, place long")
    history = spark.createDataFrame([(k, int(x)) for k, s in seen.items() for x in s], "key long, item long")
    wanted = spark.createDataFrame([(k, s) for k in seen for s in range(1, 6)], "key long, slot long")
    got = {(x["key"], x["slot"]): x["item"] for x in p.nth_unseen(wanted, history, ranking, ["key"], "item").collect()}
    want = {}
    for k, s in seen.items():
        for slot, item in enumerate([x for x in order if x not in s][:5], 1):
            want[(k, slot)] = item
    assert got == want


@pytest.fixture(scope="module")
def train(spark, lines):
    rows = [(o % 23, o, x, 1.0) for o, x in lines]
    # two persons with the same purchases, and one who shares no basket with anyone
    rows += [(500, 900, 3, 1.0), (501, 901, 3, 1.0), (600, 902, 5000, 1.0)]
    schema = "customer_unique_id long, order_id long, product_id long, price double"
    return spark.createDataFrame(rows, schema), rows


@pytest.mark.parametrize("k", [3, 10, 50])
def test_recommendations_equal_brute_force(spark, train, k):
    df, rows = train
    _, both, single = brute([(o, x) for _, o, x, _ in rows])
    sim = {}
    for (a, b), n in both.items():
        sim.setdefault(a, {})[b] = sim.setdefault(b, {})[a] = round(n / (single[a] + single[b] - n) * 10**12)
    history = {}
    for c, _, x, _ in rows:
        history.setdefault(c, set()).add(x)
    persons = {x: len({c for c, _, y, _ in rows if y == x}) for x in single}
    popular = sorted(single, key=lambda x: (-single[x], -persons[x], x))
    want = {}
    for c, bought in history.items():
        scores = Counter()
        for h in bought:
            for other, s in sim.get(h, {}).items():
                if other not in bought:
                    scores[other] += s
        listed = sorted(scores, key=lambda x: (-scores[x], -single[x], x))[:k]
        want[c] = listed or [x for x in popular if x not in bought][:k]
    cold = spark.createDataFrame([(c,) for c in [*history, 777]], "customer_unique_id long")
    want[777] = popular[:k]
    model = r.fit_recommender(df)
    got = {}
    for x in r.recommend(model, k, cold).orderBy("customer_unique_id", "rank").collect():
        got.setdefault(x["customer_unique_id"], []).append(x["product_id"])
    assert got == want
    assert model.classes.count() < len(single)
    assert r.rec_metadata(model).head()["histories"] < len(history)


def test_lookups_and_limits(train):
    df, _ = train
    model = r.fit_recommender(df)
    assert {x["product_id"] for x in r.customer_history(model, "600").collect()} == {5000}
    recs = r.recommend(model, 4)
    assert [x["rank"] for x in r.saved_recs(recs, 500, 3).collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        r.recommend(model, 0)
    with pytest.raises(ValueError):
        r.saved_recs(recs, 500, 51)


def test_similarity_bounds_and_neighbours(train):
    df, _ = train
    similar = r.item_similarity(df)
    bounds = similar.agg(F.min("jaccard"), F.max("jaccard")).head()
    assert 0 < bounds[0] <= bounds[1] <= 1
    assert similar.where("src = dst").isEmpty()
    best = r.neighbour_lists(similar, 3).head()["neighbours"]
    assert len(best) <= 3 and best == sorted(best, key=lambda e: (-e["jaccard"], e["product_id"]))


def test_rows_of_a_task_do_not_grow_with_the_input(spark, items, lines, monkeypatch):
    """With 50 rows a task the pairs are cut finer than the session's four tasks, and stay the same."""
    want = {tuple(r) for r in p.co_purchase_pairs(p.baskets(items)).collect()}
    monkeypatch.setattr(p, "TASK_ROWS", 50)
    basket = p.baskets(items)
    parts = p.pair_parts(basket)
    pairs = p.co_purchase_pairs(basket)
    both = p.with_frequencies(pairs, p.product_frequency(basket), parts)
    assert parts > 4 and pairs.rdd.getNumPartitions() == parts and both.rdd.getNumPartitions() == parts
    assert {tuple(r) for r in pairs.collect()} == want
    assert {(r["product_a"], r["product_b"], r["co_purchase_orders"]) for r in both.collect()} == want


def test_a_column_of_the_product_comes_along(spark):
    rows = [(o, x, 10 * x) for o, xs in ((1, (1, 2, 3)), (2, (1, 2)), (3, (2, 4, 5, 6))) for x in xs]
    basket = spark.createDataFrame(rows, "order_id long, product_id long, orders long")
    got = {tuple(r) for r in p.co_purchase_pairs(basket, 2, carried="orders").collect()}
    plain = p.co_purchase_pairs(basket.drop("orders"), 2).collect()
    assert got == {(*r, 10 * r["product_a"], 10 * r["product_b"]) for r in plain} and (1, 2, 2, 10, 20) in got


def test_a_finished_step_leaves_no_shuffle_files(spark):
    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))

    import time

    from martlight.session import stable, tune

    tune(spark)
    before = held()
    kept = stable(spark.range(1000).groupBy((F.col("id") % 50).alias("k")).count())
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and kept.count() == 50
