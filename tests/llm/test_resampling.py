import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import pytest

from martlight.llm import resampling

SF = "/root/testdata/sf0.001"


def features(text, longest):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, longest, buckets, percent=10, least=20):
    def count(texts):
        return Counter(crc32(f.encode()) % buckets for t in texts for f in features(t, longest)[1])

    corpus, goal = count(t for _, t in rows), count(target)
    s, t = sum(corpus.values()), sum(goal.values())
    out = []
    for i, text in rows:
        words, found = features(text, longest)
        gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((corpus[b] + 1) * (t + buckets)))) for b in (crc32(f.encode()) % buckets for f in found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: place for place, r in enumerate(able[: len(able) * percent // 100], 1)}
    return sorted((*r, rank.get(r[0])) for r in out)


def texts(count, seed=2):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma's", "δέλτα", "e5", "--", "дом", "zeta_eta", "THE", "of"]
    return [(i, rng.choice([" ", "\n", ", "]).join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(count)]


@pytest.mark.parametrize("longest", [1, 3])
def test_like_brute_force(spark, documents, longest):
    rows, target = texts(300), [t for _, t in texts(30, seed=9)] + [None, ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(documents(rows), goal, longest=longest, buckets=500).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == brute(rows, target, longest, 500)


def test_spans_overlap_and_keep_to_borders():
    words = resampling.collapse("  One,two--three\tÉ4 ")
    assert words == "one two three É4".encode()
    assert [words[a:b].decode() for a, b in resampling.spans(words, 3)] == [
        "one", "two", "three", "É4", "one two", "two three", "three É4", "one two three", "two three É4",
    ]
    assert not list(resampling.spans(resampling.collapse("?! \n"), 3)) and not list(resampling.spans(resampling.collapse(None), 2))


def test_odd_rows_repeats_and_clashing_columns(spark, documents, odd_rows):
    goal = spark.createDataFrame([("the same words",)], "text string")
    docs = documents(odd_rows, extra=("rank", "weight", "kept", "able", "position"))
    out = resampling.resample(docs, goal, percent=50, least_words=5, keep=("rank", "text", "kept", "position"))
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank", "kept_rank", "text", "kept", "position"]
    rows = out.collect()
    assert len(rows) == len(odd_rows) and {r["position"] for r in rows} == {"clash"}
    empty = [r for r in rows if not (r["text"] or "").strip()]
    assert all((r["n_features"], r["weight"], r["rank"]) == (0, 0, None) for r in empty)
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2]  # half of five rows with words enough
    assert resampling.resample(documents([]), goal).count() == 0
    assert resampling.resample(documents(odd_rows), goal.limit(0)).count() == len(odd_rows)


def test_matches_statement(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.execute(resampling.SQL["op12_regex_resampling"]).fetchall()
    got = [tuple(r) for r in resampling.op12_regex_resampling(spark, SF).collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    assert sum(r[4] is not None for r in got) == sum(r[1] >= 20 for r in got) // 10 > 0
