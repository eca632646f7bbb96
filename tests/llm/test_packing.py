import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from martlight.llm import packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encode():
    return packing.WordEncoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=("Cs",)), st.sampled_from("aZé ßİΣσς'\n\t ́\x1c\x85ﬁ9#"))))
def test_word_encoder_equals_the_library(text):
    tokenizer = Tokenizer.from_file(PATH)
    assert packing.encoder(PATH)(text) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["don't we'll IT'S", "a<|endoftext|>b", "Ontier erersh, lyor | haou!! 9807915762804490", "été Å ªº µ", ""])
def test_word_encoder_cases(encode, tokenizer, text):
    assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(1, 40))
def test_fill_is_the_closest_multiset(sizes, capacity):
    counts = Counter(sizes)
    chosen = packing.fill(dict(counts), capacity)
    assert all(n <= counts[s] for s, n in chosen.items())
    sums = {0}
    for s in sizes:
        sums |= {x + s for x in sums if x + s <= capacity}
    assert sum(s * n for s, n in chosen.items()) == max(sums)


def test_pack_uses_every_piece_with_little_slack():
    rng = random.Random(1)
    counts = Counter(min(2047, int(rng.expovariate(1 / 600)) + 1) for _ in range(5000))
    used, sequences, total = Counter(), 0, sum(s * n for s, n in counts.items())
    for chosen, times in packing.pack(dict(counts), 2048):
        assert sum(s * n for s, n in chosen.items()) <= 2048
        sequences += times
        for s, n in chosen.items():
            used[s] += n * times
    assert used == counts
    assert sequences * 2048 - total < 2048 * 2


def check(pieces, docs, tokenizer):
    ids = {d: [*(tokenizer.encode(t, add_special_tokens=False).ids if t else []), 1] for d, t in docs}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[doc])
            part = ids[doc][at : at + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[doc])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    return len(by_sequence)


def test_query_packs_every_token_once(spark, tokenizer):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    pieces = packing.op6_bin_slack_packing(spark, SF).collect()
    sequences = check(pieces, docs, tokenizer)
    tokens = sum(p["length"] for p in pieces)
    assert sequences * 2048 < 1.05 * tokens + 4 * 2048


def test_windows_give_back_what_leaves_slack(spark, documents, tokenizer):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 900)))) for i in range(400)]
    pieces = packing.pieces_of(documents(rows), lambda: packing.encoder(PATH))
    small = packing.pack_pieces(pieces, window=50).collect()
    sequences = check(small, rows, tokenizer)
    assert sequences * 2048 < 1.1 * sum(p["length"] for p in small) + 8 * 2048


def test_odd_rows(spark, documents, odd_rows):
    out = packing.pack_documents(documents(odd_rows, extra=("offset", "length", "row_no"))).collect()
    empty = [r for r in out if r["doc_tokens"] == 1]
    assert {r["doc_id"] for r in empty} == {1, 2, 3, None}
    assert sum(r["doc_id"] == 5 for r in out) == 2
    assert packing.pack_documents(documents([])).count() == 0


def test_memory_forgets_without_changing_ids(tokenizer):
    encode = packing.WordEncoder(PATH, words=7)
    rng = random.Random(3)
    for _ in range(50):
        text = rng.choice(" \n\t").join(rng.choice(("the", "don't", "Straße", "x9", "", "end.", "ÅB", "日本")) + "a" * rng.randrange(4) for _ in range(40))
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encode.words) <= 7 and len(encode.words.older) <= 7
