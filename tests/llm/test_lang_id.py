import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lang_id
from ledgerloom.llm.queries import op10_language_id

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def result(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return docs, op10_language_id(spark, SF).collect()


def test_held_out_accuracy(result):
    docs, rows = result
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) <= 0.005 * len(rows)


def test_same_as_brute_force(result, spark):
    docs, rows = result
    frame = spark.read.parquet(f"{SF}/documents.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    model = lang_id.fit(frame)
    for r in rows[:60]:
        at, counts = lang_id.features(docs[r["doc_id"]]["text"])
        dense = np.zeros(lang_id.BUCKETS)
        dense[at] = (1 + np.log(counts)) * model.idf[at]
        cosines = [(dense @ model.centroids[:, c]) / np.linalg.norm(dense) for c in range(model.centroids.shape[1])]
        assert r["lang_pred"] == model.languages[int(np.argmax(cosines))] and abs(max(cosines) - r["score"]) < 1e-6


def test_copies_fill_one_place(spark):
    """A text with the smallest hash of its language, repeated more often than the sample is large."""
    texts = [(" ".join(f"{'abcdefgh'[(i * 7 + j) % 8]}{'mnopqrst'[(i + j * j) % 8]}{'uvwxyz'[(i * j) % 6]}" for j in range(12)), "xx") for i in range(60)]
    docs = spark.createDataFrame(texts, "text string, lang string").distinct()
    copied = docs.orderBy(F.xxhash64("text")).limit(1).select(F.explode(F.array_repeat("text", lang_id.SAMPLE + 100)).alias("text"), "lang")
    model = lang_id.fit(docs.union(copied))
    assert len(model.languages) == lang_id.CENTROIDS
    assert lang_id.predict(docs, model).where("rejected").count() == 0


def test_cases(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "fr"), ("le chat", None)], "text string, lang string")
    model = lang_id.fit(train)
    assert model.languages == ["de", "en"]
    rows = [(6, "½ ² Ⅷ ١٢", "x"), (1, "the dog", "x"), (1, "the dog", "x"), (2, None, "x"), (3, "", "x"), (4, "123 !!", "x"), (5, "und die katze " * 50_000, "x"), (6, "漢字漢字漢字", "x"), (None, "the cat", None)]
    out = lang_id.predict(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert [r["lang_pred"] for r in out] == ["und", "en", "en", "und", "und", "und", "de", out[7]["lang_pred"], "en"]
    assert [r["rejected"] for r in out] == [True, False, False, True, True, True, False, False, False]
    assert lang_id.predict(train.limit(0), model).count() == 0
    none = lang_id.fit(train.limit(0))
    assert lang_id.predict(train.select("text"), none).where("lang_pred = 'und'").count() == 4


def test_models_larger_than_a_block(spark, monkeypatch):
    train = spark.createDataFrame([(f"{w} {w}er und{i} {i}", w) for w in ("abc", "def", "ghi", "jkl", "mno") for i in range(4)], "text string, lang string")
    model = lang_id.fit(train)
    docs = train.select("text").unionByName(spark.createDataFrame([(None,), ("xyz",), ("abc def",)], "text string"))
    want = sorted((tuple(r) for r in lang_id.predict(docs, model).collect()), key=lambda r: r[0] or "")
    monkeypatch.setattr(lang_id, "LANGUAGES", 2)
    assert len(model.blocks()) == 3
    got = sorted((tuple(r) for r in lang_id.predict(docs, model).collect()), key=lambda r: r[0] or "")
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, want, strict=True))


def test_a_viral_text_leaves_its_language_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    copied = docs.where("lang = 'en'").limit(1).select(F.explode(F.array_repeat("text", 3000)).alias("text"), "lang")
    near = docs.where("lang = 'en'").limit(1).crossJoin(spark.range(3000)).select(F.concat("text", F.lit(" "), F.col("id").cast("string")).alias("text"), "lang")
    for more in (copied, near):
        model = lang_id.fit(docs.unionByName(more))
        assert lang_id.predict(docs, model).where("rejected").count() <= 0.005 * docs.count()
