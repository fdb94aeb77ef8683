import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality
from ledgerloom.llm.queries import op11_quality_classifier

SF = "/root/testdata/sf0.01"


def number(gram: bytes, salt: int) -> int:
    code = salt
    for b in gram:
        code = (code * 0x01000193 + b + 1) % 2**32
    return ((code ^ (code >> 15)) * 2654435761 % 2**32) >> 14


def plain_features(text: str) -> set[int]:
    data = text.encode()
    classes = ["A" if 65 <= b <= 90 else "a" if 97 <= b <= 122 or b >= 128 else "0" if 48 <= b <= 57 else " " if b <= 32 else chr(b) for b in data]
    runs = bytes(ord(c) for i, c in enumerate(classes) if i == 0 or classes[i - 1] != c)
    words, run, best = data.split(), 0, 0
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 0
        best = max(best, run)
    streams = ((data, 4, 1), (runs, 6, 2), (b"=" * min(best, 8), 8, 3))
    return {number(s[i : i + n], salt) for s, longest, salt in streams for n in range(1, longest + 1) for i in range(len(s) - n + 1)}


@pytest.mark.parametrize("text", ["", "a", "Über die Berge!! 42", "Und Und Und Und, ja", "x | y | Z\n\n\x00", "ab " * 400])
def test_features_as_listed_one_by_one(text):
    assert set(quality.features(text).tolist()) == plain_features(text)


def test_features_of_pieces(monkeypatch):
    text = "".join(random.Random(1).choice("aB1 .é\n") for _ in range(900)) + " Ja Ja Ja Ja"
    monkeypatch.setattr(quality, "_PIECE", 64)
    assert set(quality.features(text).tolist()) == plain_features(text)


def test_held_out_accuracy(spark):
    rows = op11_quality_classifier(spark, SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.95
    good, bad = ([r["score"] for r in held if labels[r["doc_id"]] == c] for c in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.98


def test_ratios_count_all_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 7)  # the sample bounds the descent alone
    texts = [(f"{'OK fine' if i % 3 else 'BAD !!'} {i * i}", 1 if i % 3 else 0) for i in range(60)]
    model = quality.fit(spark.createDataFrame(texts, "text string, label int"))
    held = np.zeros((2, quality.BUCKETS))
    for t, label in texts:
        held[label, sorted(plain_features(t))] += 1
    p, q = held[1] + 1, held[0] + 1
    for i in np.flatnonzero(held.sum(0))[:200]:
        assert math.isclose(model.ratios[i], math.log((p[i] / p.sum()) / (q[i] / q.sum())), abs_tol=1e-9)
    assert model.score("OK fine 3") > model.score("BAD !! 3")


def test_descent_reaches_the_optimum():
    """The duality gap of the hinge loss closes."""
    r = np.random.default_rng(5)
    at = [np.unique(r.integers(0, 40, 9)) for _ in range(80)]
    signs = np.where(r.random(80) < 0.5, 1.0, -1.0)
    ratios = np.zeros(quality.BUCKETS)
    ratios[:40] = r.normal(size=40)
    weights, constant, duals = quality.descend(at, signs, ratios)
    margins = [constant + weights[a] @ ratios[a] / np.linalg.norm(ratios[a]) for a in at]
    size = (weights @ weights + constant**2) / 2
    primal, dual = size + quality.COST * sum(max(0, 1 - s * m) for s, m in zip(signs, margins, strict=True)), duals.sum() - size
    assert duals.min() >= 0 and duals.max() <= quality.COST
    assert dual <= primal + 1e-6 and primal - dual < 0.02 * primal


def test_cases(spark):
    """Nulls, empty and long texts, repeated rows, other labels, clashing names, empty tables."""
    train = spark.createDataFrame([("good words here", 1)] * 12 + [("BAD!! BAD!!", 0)] * 9 + [(None, 1), ("x", None), ("y", 7)], "text string, label int")
    model = quality.fit(train)
    docs = spark.createDataFrame([(1, "good words", 0.5), (2, None, 0.5), (3, "", 0.5), (4, "BAD!! " * 300_000, 0.5), (4, "BAD!! " * 300_000, 0.5)], "doc_id long, text string, score double")
    out = {r["doc_id"]: r for r in quality.judge(docs, model).collect()}
    assert quality.judge(docs, model).count() == 5 and out[2]["score"] == out[3]["score"]
    assert out[1]["score"] > out[4]["score"] and out[1].asDict().keys() == {"doc_id", "text", "score", "predicted"}
    assert quality.judge(docs.limit(0), model).count() == 0
    assert quality.fit(train.limit(0)).score("anything") == pytest.approx(0.5)
    assert quality.fit(train.where("label = 1")).score("anything") == pytest.approx(14 / 15)
    named = docs.withColumnRenamed("text", "body").withColumn("hash", F.lit(1)).withColumn("label", F.lit("z"))
    assert {r["doc_id"]: r["score"] for r in quality.judge(named, model, text="body").collect()} == {k: r["score"] for k, r in out.items()}
