import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import bpe, queries

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
OWN = bpe.Bpe(RANKS, public_tokenizers.PATTERN)
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})

TEXTS = ["", " ", "Hello  world\n\n\t x", "naïve Straße 日本語 🤖🤖", "a" * 3000, "ab" * 700 + "!?" * 400, "don't I'LL we've", "   x", "x" * 50 + " " * 90, "<|endoftext|>", "\x00\x01"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_round_trip(text):
    ids = OWN.encode([text])[0]
    assert ids.tolist() == OTHER.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_texts(texts):
    for text, ids in zip(texts, OWN.encode(texts), strict=True):
        assert ids.tolist() == OTHER.encode_ordinary(text) and OWN.decode(ids) == text.encode()


def test_perfect_hash_is_minimal():
    assert sorted(OWN.whole.slot_key.tolist()) == list(range(len(RANKS)))
    assert [OWN.keys[k] for k in OWN.whole.find(OWN.keys[:500])] == OWN.keys[:500]


def test_frequent_words_are_merged_once(monkeypatch):
    """A word that keeps coming stays known while rare ones fill the cache many times over."""
    own, merged = bpe.Bpe(RANKS, public_tokenizers.PATTERN), []
    real = bpe.Bpe.merge
    monkeypatch.setattr(bpe.Bpe, "merge", lambda self, piece: merged.append(piece) or real(self, piece))
    own.cache = bpe.Cache(20)
    for k in range(50):
        rare = " ".join(f"qzx{chr(97 + k % 26)}{chr(97 + k // 26)}vjw{c}" for c in "abcdefghij")
        text = f" zqxjkvwpfb {rare}"
        assert own.encode([text])[0].tolist() == OTHER.encode_ordinary(text)
    assert merged.count(b" zqxjkvwpfb") == 1 and len(merged) > 200
    assert len(own.cache.young) <= 20 and len(own.cache.old) <= 20


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "Hello  world", 8), (3, "Hello  world", 8), (None, "x" * 5000, 9)], "doc_id long, text string, IDS_ int")
    own = spark.sparkContext.broadcast(OWN)
    rows = queries.digests(df, own).collect()
    assert len(rows) == 5
    for r in rows:
        if r.doc_id == 3:
            ids = OTHER.encode_ordinary("Hello  world")
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(b"Hello  world").hexdigest()
        if r.doc_id in (1, 2):
            assert r.n_tokens == 0 and r.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    # a column that is already called like the result is replaced, others stay
    again = bpe.encode(df.withColumn("ids", F.lit(1)), own)
    assert again.columns == ["doc_id", "text", "IDS_", "ids"] and dict(again.dtypes)["ids"] == "binary"
    assert queries.digests(df.limit(0), own).count() == 0
