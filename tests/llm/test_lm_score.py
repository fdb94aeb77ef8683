import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lm_score
from ledgerloom.llm.lm_score import END, Lattice, Totals, piece_counts, piece_weights, score_texts
from ledgerloom.llm.queries import op5_lm_scoring, subword_model

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def ways(word, arcs, end):
    """Sum over all segmentations by listing them."""
    if not word:
        return math.exp(end)
    return sum(math.exp(arcs[word[:k]]) * ways(word[k:], arcs, end) for k in range(1, len(word) + 1) if word[:k] in arcs)


def test_forward_recursion_sums_all_segmentations():
    weights = {b"a": -2.0, b"b": -2.5, b"ab": -1.5, b"ba": -3.0, b"aba": -2.2, END: -1.0}
    lattice = Lattice({**{bytes([i]): -9.0 for i in range(256) if bytes([i]) != END}, **weights})
    for word in ("a", "ab", "abab", "bbaabab"):
        assert math.isclose(lattice.log_probability(word), math.log(ways(word, lattice.arcs, lattice.end)))
    assert math.isclose(lattice.log_probability("é"), -9.0 * 2 - 1.0)
    assert math.isfinite(lattice.log_probability("ab" * 20_000))


def test_no_arc_is_too_long():
    long = "ab" * 40
    lattice = Lattice({**{bytes([i]): -9.0 for i in range(256)}, long.encode(): -2.0})
    both = math.log(math.exp(-2.0) + math.exp(-9.0 * 80)) + lattice.end
    assert math.isclose(lattice.log_probability(long), both) and lattice.longest == 80


def test_pieces_weigh_as_often_as_their_words_occur(spark):
    words = spark.createDataFrame([(b"the", 5), (b"cat", 1), (b"zzz", 0)], "word binary, c long")
    counts = piece_counts(words, subword_model())
    assert counts[END] == 6 and counts[b"the"] == 5 and b"zzz" not in counts
    weights = piece_weights(subword_model(), counts)
    assert math.isclose(sum(map(math.exp, weights.values())), 1) and weights[b"the"] > weights[b"cat"]


@pytest.mark.parametrize("frequent", [1e-6, 0.01, 1.0])
def test_same_as_brute_force(spark, monkeypatch, frequent):
    """Whatever words are broadcast."""
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_lm_scoring(spark, SF).collect()
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    counts = Counter(w for d, t in docs.items() if not held[d] for w in [*tokens(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    words = spark.createDataFrame([(w.encode(), c) for w, c in counts.items() if w != "\n"], "word binary, c long")
    lattice = Lattice(piece_weights(subword_model(), piece_counts(words, subword_model())))
    totals = Totals(n, counts["\n"], v - 1)
    assert len(rows) == len(docs)
    for r in rows[::4]:
        own = [*tokens(docs[r["doc_id"]]), "\n"]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(own), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        want = sum(totals.word(lattice.log_probability(w)) for w in own[:-1]) + totals.log_end / math.log(10)
        assert math.isclose(r["score"], want, rel_tol=1e-9)
    out = [r for r in rows if r["held_out"]]
    plain = Lattice(piece_weights(subword_model(), {}))
    assert sum(r["score"] for r in out) > sum(plain.log_probability(w) / math.log(10) for r in out for w in tokens(docs[r["doc_id"]]))


def test_cases(spark):
    rows = [(1, "The cat", False, "x"), (1, "The cat", False, "x"), (2, None, False, None), (3, "", True, "x"), (None, "zzz CAT", True, "x"), (5, "w" * 30_000, True, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean, base string")
    out = score_texts(docs, "held", subword_model()).orderBy("n_tokens", "doc_id").collect()
    assert [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in out] == [(2, 1, 1, 7), (3, 1, 1, 7), (5, 2, 1, 7), (None, 3, 2, 7), (1, 3, 3, 7), (1, 3, 3, 7)]
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert score_texts(docs.limit(0), "held", subword_model()).count() == 0
    untrained = score_texts(docs.withColumn("held", F.lit(True)), "held", subword_model()).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and all(r["base_score"] == 0 and r["n_known"] == 0 for r in untrained)
