import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm.bpe import read_ranks
from ledgerloom.llm.common import written
from ledgerloom.llm.queries import bpe_vocabulary
from tests.llm.test_jaccard_join import brute
from tests.llm.test_secrets_scan import brute as spans

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "123 456 !!", "en", "s", 10)]
    extra = docs.where("doc_id < 40")
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(extra)
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    steps = [written(docs, "start")]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], SF), "step"))
    start, spoken, single, clean, safe, ids = [[r.asDict() for r in s.collect()] for s in steps]
    assert all(s.columns == columns for s in steps[:5])

    assert {r["doc_id"] for r in start} - {r["doc_id"] for r in spoken} >= {-1, -2, -3}
    assert len(spoken) >= 0.99 * len(start)

    groups = brute([(r["doc_id"], r["text"]) for r in spoken], 5, 80)
    assert sorted(r["doc_id"] for r in single) == sorted({c for _, _, c in groups})

    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single if not any(t in r["text"] for t in items)}

    assert len(safe) == len(clean)
    for r in safe:
        text = before[r["doc_id"]]["text"]
        assert r["n_chars"] == len(r["text"])
        if not spans(text):
            assert r["text"] == text or "[secret]" in r["text"]
        else:
            assert not any(text[s:e] in r["text"] for s, _, e, _ in spans(text))

    ranks, pattern = bpe_vocabulary()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in safe}
    assert len(ids) == len(safe)
    for r in ids:
        assert r["round_trip"] and list(r["ids"]) == known.encode_ordinary(texts[r["doc_id"]])


def test_run_has_all_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() < 200 and out.where(~F.col("round_trip")).isEmpty()


def test_clashing_names_and_empty_tables(spark):
    names = ["score", "rejected", "lang_pred", "leaks", "found", "spans", "ids", "n_tokens", "_id", "_hash", "row", "column0", "k0", "decoded"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    docs = written(docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names)), "clash")
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), "step")
        assert out.count() > 0 and stage(spark, docs.limit(0), SF).count() == 0
        for n in names:
            if name != "byte-level BPE" or n not in ("ids", "n_tokens"):
                assert out.where(F.col(n) != F.concat(F.lit(n), F.col("doc_id").cast("string"))).isEmpty(), (name, n)
        if name != "byte-level BPE":
            assert out.columns == docs.columns
