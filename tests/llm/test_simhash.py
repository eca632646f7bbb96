import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from martlight.llm import simhash
from martlight.llm.components import components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    spans = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = [0] * 64
    for s in spans:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for bit in range(64):
            ones[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(spans))


def plain_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(ids))]


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in docs]
    roots = plain_components([r["doc_id"] for r in docs], prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash_dedup(spark, SF).collect()}
    assert got == {r["doc_id"]: (f"{p:016x}", c) for r, p, c in zip(docs, prints, roots)}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bucket", [128, 2])
def test_links_reach_every_pair_within_two_bits(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            x = centre
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    edges = simhash.links(fps).collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in edges)
    roots = dict(components(spark.createDataFrame(edges, "a long, b long")).collect()) if edges else {}
    want = plain_components([signed(v) for v in values], values)
    assert [roots.get(signed(v), signed(v)) for v in values] == want


def test_pairs_come_out_once(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = [base, base ^ 1, base ^ (1 << 40), base ^ 3, base ^ (1 << 33 | 1)]
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    pairs = [(r["a"], r["b"]) for r in simhash.links(fps).collect()]
    want = sum((a ^ b).bit_count() <= 2 for i, a in enumerate(values) for b in values[:i])
    assert len(pairs) == len(set(pairs)) == want


def test_long_chain_is_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = components(edges).collect()
    assert len(roots) == 200 and {r["root"] for r in roots} == {0}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, documents, odd_rows):
    out = simhash.near_duplicates(documents(odd_rows, extra=("fp", "component_id", "salt"))).collect()
    assert len(out) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert {by_id[i]["component_id"] for i in (1, 2, 3)} == {1} and by_id[1]["fp"] == 0
    assert by_id[6]["component_id"] == 5
    assert {r["component_id"] for r in out if r["doc_id"] is None} == {1, 5}
    assert simhash.near_duplicates(documents([])).count() == 0


def test_one_document_of_each_group_stays(spark, documents, odd_rows):
    kept = simhash.keep_one(documents(odd_rows, extra=("fp",)))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 7]
    assert kept.where("doc_id is null").count() == 2
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp"]


def test_fingerprint_of_hot_copies(spark, documents):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(500)]
    other = [(1000 + i, " ".join(rng.choice(words, 40))) for i in range(60)]
    rows = [(i, "One text that very many documents share word for word") for i in range(300)] + other
    out = simhash.near_duplicates(documents(rows)).collect()
    assert {r["component_id"] for r in out if r["doc_id"] < 1000} == {0}
    assert all(r["component_id"] == r["doc_id"] for r in out if r["doc_id"] >= 1000)
