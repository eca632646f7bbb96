import math
import random

import numpy as np
import pytest

from martlight.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, components=4):
    """Per id and component what the operator promises, by plain eigenvectors."""
    valid = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in valid})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    centred = np.array([[x[d] - sums[d] / n for d in range(dims)] for x in fit])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in valid:
        deviation = sum((n * x[d] - sums[d]) ** 2 for d in range(dims))
        for c in range(min(components, dims)):
            score = (np.array(x) - np.array(sums) / n) @ vectors[:, c] / math.sqrt(values[c])
            out[i, c + 1] = (n, deviation, abs(score), values[c] / values.sum())
    return out


def check(spark, rows, schema=SCHEMA):
    got = whitening.whitened_components(spark.createDataFrame(rows, schema).repartition(3)).collect()
    want = brute(rows)
    assert {(r["vec_id"], r["component"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, deviation, score, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation if deviation < 1 << 63 else None)
        assert abs(r["whitened"]) == pytest.approx(score, rel=1e-7, abs=1e-7)
        assert r["explained"] == pytest.approx(share, rel=1e-9)
        assert r["identity_error"] < 1e-9
    return got


def test_random_vectors_and_repeats(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 9)) @ rng.normal(size=(9, 9)) * 3
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a vector with a large share counts once
    check(spark, rows)


def test_ill_scaled_and_far_from_the_origin(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 5)) * [1e5, 1e3, 10, 1, 0.5] + 1e6
    check(spark, [(i, v.tolist()) for i, v in enumerate(base)])


def test_odd_vectors_take_no_part(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [math.nan] * 4), (104, [math.inf, 0.0, 0.0, 0.0]), (105, [1.0] * 3)]
    got = whitening.whitened_components(spark.createDataFrame(rows + odd, SCHEMA)).collect()
    assert {r["vec_id"] for r in got} == set(range(60))
    same = check(spark, rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, same))  # sums are exact, so placement changes nothing


def test_fewer_dimensions_and_empty_tables(spark):
    assert whitening.whitened_components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whitened_components(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).count() == 0  # no variance
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]
    got = whitening.whitened_components(spark.createDataFrame(line, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)
    assert sum(r["whitened"] ** 2 for r in got) / 10 == pytest.approx(1)


def test_extra_columns_null_ids_and_entries_beyond_a_long(spark):
    rows = [(None, [1.0, 2.0], "a", 1), (5, [2.0, 1.0], None, 2), (5, [1e30, 4.0], "c", 3), (6, [-1e30, 4.0], "c", 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string, n int")
    got = whitening.whitened_components(df).collect()
    assert sorted({(r["vec_id"] or 0) for r in got}) == [0, 5, 6] and got[0]["n"] == 4
    assert all(r["deviation"] is None for r in got if r["vec_id"] == 6)
    assert all(math.isfinite(r["whitened"]) for r in got)


@pytest.mark.parametrize("size", [1, 2, 7, 32])
def test_factor_and_rotation(size):
    rng = np.random.default_rng(size)
    a = rng.normal(size=(3 * size, size)) * np.logspace(0, -6, size)
    v = a.T @ a
    b = whitening.pivoted_cholesky(v)
    assert np.allclose(b @ b.T, v, atol=1e-12 * v.max())
    values, directions = whitening.one_sided_jacobi(b)
    assert np.allclose(values, np.linalg.svd(a, compute_uv=False) ** 2, rtol=1e-9)
    assert np.allclose(directions.T @ directions, np.eye(len(values)), atol=1e-12)
    assert np.allclose(v @ directions, directions * values, atol=1e-12 * v.max())


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got, want = whitening.op11_jacobi_whitening(spark, folder).collect(), brute(rows)
    assert len(got) == len(want)
    for r in got:
        n, deviation, score, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation) and r["explained"] == pytest.approx(share, rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(score, abs=1e-8)
