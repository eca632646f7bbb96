import numpy as np
import pytest
from pyspark.sql import functions as F

import check
from martlight.llm import kdtree

SF = "/root/testdata/sf0.001"


def brute(rows, k):
    whole = {i: np.floor(64 * np.array(v, dtype=float)) for i, v in rows}
    out = []
    for q in (i for i in whole if i % 20 == 0):
        scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard", [16, 4096])
def test_ties_and_repeated_vectors(spark, shard):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 1, 6), 1)]) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 420)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = kdtree.top_k(df, F.col("vec_id") % 20 == 0, 5, shard=shard).collect()
    rows32 = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got)) == brute(rows32, 5)


def test_query_matches_statement(spark):
    same, note = check.compare(spark, check.connect(SF), "op5_kdtree_topk", SF)[1:]
    assert same and not note


def test_traversal_leaves_nodes_out():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 10, (16, 8))
    points = np.floor(np.concatenate([c + rng.normal(0, 0.3, (100, 8)) for c in centres]) * 8)
    root = kdtree.build(points, leaf=50)
    seen = []
    original = kdtree.Best.add
    kdtree.Best.add = lambda self, q, s, i: (seen.append(len(s)), original(self, q, s, i))[1]
    try:
        best = kdtree.search(root, points, np.arange(len(points)), points[:1], np.array([-1]), 5)
    finally:
        kdtree.Best.add = original
    assert sum(seen) < len(points) / 2
    order = np.lexsort((np.arange(len(points)), -(points @ points[0])))[:5]
    assert list(best.id) == list(order)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (6, []), (7, [1.0, 2.0]), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0))
    got = sorted(map(tuple, kdtree.top_k(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 7, 64 * 64 * 5), (0, 2, 7, 64 * 64 * 5), (0, 3, 5, 64 * 64), (0, 4, 6, 0)]
    assert kdtree.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert kdtree.top_k(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
