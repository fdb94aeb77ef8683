import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from ledgerloom.llm.bpe import Encoder, decode, decode_ids, encode_texts, ids_sha256, read_ranks
from ledgerloom.llm.queries import bpe_vocabulary

RANKS, PATTERN = bpe_vocabulary()
VOCABULARY = read_ranks(RANKS)
KNOWN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=VOCABULARY, special_tokens={})
ENCODER = Encoder(VOCABULARY, PATTERN)


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), dtype=np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.lists(st.sampled_from(["a", "th", "ing", " ", "  ", "\n", "é", "漢", "\U0001f600", "1", ".", "'s", "<|endoftext|>"])).map("".join)))
def test_same_ids_as_the_public_encoder(text):
    ids = ids_of(ENCODER, text)
    assert ids == KNOWN.encode_ordinary(text)
    tokens = [KNOWN.decode_single_token_bytes(i) for i in range(len(VOCABULARY))]
    assert "".join(t for _, t in decode(ids, tokens, step=1)) == text


@pytest.mark.parametrize("piece", ["a" * 30_000, " " * 30_000 + "b", "ab" * 20_000, "漢" * 10_000, "".join(random.Random(7).choices("etaoinshr", k=50_000))])
def test_very_long_pieces(piece):
    assert ids_of(ENCODER, piece) == KNOWN.encode_ordinary(piece)


def test_small_tables_do_not_change_results(monkeypatch):
    from ledgerloom.llm import bpe

    monkeypatch.setattr(bpe, "MAX_MOVES", 5)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 3)
    monkeypatch.setattr(bpe, "MAX_PIECES", 2)
    own = Encoder(VOCABULARY, PATTERN)
    for text in ("the thing there is anblehw thonre", "x" * 200, "éèê ßü"):
        assert ids_of(own, text) == KNOWN.encode_ordinary(text)


def test_rows(spark):
    rows = [(1, "Hello wörld", "x"), (1, "Hello wörld", "x"), (None, None, None), (3, "", "y"), (4, "\U0001f600" * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = decode_ids(encode_texts(docs, RANKS, PATTERN), RANKS).withColumn("sum", ids_sha256()).collect()
    assert len(out) == 5
    for r in out:
        text = r["text"] or ""
        assert r["ids"] == KNOWN.encode_ordinary(text) and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == text and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["sum"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
    once = encode_texts(docs.withColumnRenamed("doc_id", "decoded_sha256"), RANKS, PATTERN, decoded=True).collect()
    assert sorted(r["decoded_sha256"] for r in once) == sorted(r["decoded_sha256"] for r in out)
    assert encode_texts(docs.limit(0), RANKS, PATTERN).count() == 0


def test_negative_ids_are_no_ids():
    with pytest.raises(ValueError):
        list(decode([5, -1], [b"x"] * 9))
