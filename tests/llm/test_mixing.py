import math

import duckdb
import pytest

from martlight.llm import mixing

SF = "/root/testdata/sf0.001"


def test_rates_follow_target_shares(spark, documents):
    rows = [(i, "x" * 99, "big" if i % 10 else "small") for i in range(4000)]
    out = mixing.poisson_mix(documents(rows), weights={"big": 0.5, "small": 0.5})
    sizes = dict(out.groupBy("source").count().collect())
    assert sizes["big"] == pytest.approx(2000, abs=6 * math.sqrt(2000))
    assert sizes["small"] == pytest.approx(2000, abs=6 * math.sqrt(2000 * 5))


def test_counts_are_poisson_also_beyond_one_part(spark, documents):
    rows = [(i, "y" * 9, "rare" if i < 300 else "common") for i in range(30_300)]
    out = mixing.poisson_mix(documents(rows), weights={"rare": 1.0, "common": 0.0})
    counts = [r["count"] for r in out.groupBy("doc_id").count().collect()]
    mean = sum(counts) / 300
    assert mean == pytest.approx(101, abs=3)  # over PART_MEAN: several parts are added
    assert sum((c - mean) ** 2 for c in counts) / 300 == pytest.approx(101, rel=0.4)


def test_order_is_global_and_repeatable(spark, documents):
    docs = documents([(i, "text", f"s{i % 3}") for i in range(500)])
    first = mixing.poisson_mix(docs).select("doc_id", "copy", "shuffle_key").collect()
    second = mixing.poisson_mix(docs.repartition(7)).select("doc_id", "copy", "shuffle_key").collect()
    assert sorted(first) == sorted(second)
    assert len({r["shuffle_key"] for r in first}) == len(first)


def test_odd_rows_and_clashing_columns(spark, documents, odd_rows):
    out = mixing.poisson_mix(documents(odd_rows, extra=("copy", "shuffle_key", "key", "rate")))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "rate", "copy", "shuffle_key"]
    per_row = {}
    for r in out.collect():
        per_row[(r["doc_id"], r["text"])] = per_row.get((r["doc_id"], r["text"]), 0) + 1
    assert per_row.get((5, odd_rows[4][1]), 0) % 2 == 0  # both repeated rows have the same count
    assert mixing.poisson_mix(documents([])).count() == 0


def test_many_sources_take_the_salted_join(spark, documents, monkeypatch):
    docs = documents([(i, "text", None if i % 3 else f"s{i}") for i in range(300)])
    expected = sorted(map(str, mixing.poisson_mix(docs).collect()))
    monkeypatch.setattr("martlight.llm.base.BROADCAST_ROWS", 1)
    assert sorted(map(str, mixing.poisson_mix(docs).collect())) == expected


def test_matches_statement(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, copy, shuffle_key FROM ({mixing.SQL['op1_poisson_mixing']})").fetchall()
    got = mixing.op1_poisson_mixing(spark, SF).select("doc_id", "copy", "shuffle_key").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_rows_without_id_are_drawn_one_by_one(spark, documents):
    docs = documents([(None, f"text {i}") for i in range(2000)])
    out = mixing.poisson_mix(docs).collect()
    counts = [0] * 2000
    for r in out:
        counts[int(r["text"][5:])] += 1
    assert sum(counts) == pytest.approx(2000, abs=6 * math.sqrt(2000))
    assert counts.count(0) == pytest.approx(2000 / math.e, rel=0.2) and max(counts) > 2
    assert len({r["shuffle_key"] for r in out}) == len(out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.poisson_mix(docs.repartition(5)).collect()))


def test_columns_of_any_name_and_kind_come_back(spark, documents):
    names = ("_key", "_parts", "_steps", "_count", "_row", "_name", "_salt", "a.b")
    docs = documents([(i, f"text {i}", f"s{i % 3}") for i in range(60)] + [(None, "no id", "s1")] * 20, extra=names)
    docs = docs.selectExpr("*", "map('k', doc_id) AS marks")
    plain = documents([(i, f"text {i}", f"s{i % 3}") for i in range(60)])
    rows = mixing.poisson_mix(docs).collect()
    assert all(r[n] == "clash" for r in rows for n in names)
    assert all(r["marks"] == {"k": r["doc_id"]} for r in rows)
    # Equal rows without id are drawn alike.
    assert sum(r["doc_id"] is None for r in rows) % 20 == 0
    assert {r["doc_id"] for r in rows} >= {r["doc_id"] for r in rows if r["doc_id"] is not None}
    assert mixing.poisson_mix(plain).columns == [*plain.columns, "copy", "shuffle_key"]
