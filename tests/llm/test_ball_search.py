import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ball_search
from ledgerloom.llm.ball_search import TERM, rank_documents, term_counts
from ledgerloom.llm.queries import op12_lexical_search

SF = "/root/testdata/sf0.01"


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(TERM, text or "")]


def by_hand(docs, items, top=50):
    """Every document scored for every item; ids by row."""
    held = [(d, Counter(terms_of(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, d is None, d, score))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, r + 1, d, s) for r, (_, _, d, s) in enumerate(scored[:top])]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_query_as_by_hand(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows(op12_lexical_search(spark, SF)) == by_hand(docs, items)


@pytest.mark.parametrize("blocks", [1, 3])
def test_ties_repeats_nulls_and_names(spark, monkeypatch, blocks):
    """Small trees, leaves and pieces; equal texts; several blocks of items."""
    r = random.Random(3)
    words = ["Öl", "ab", "B2", "cd", "e", "ff", "ΣΤ", "x1", "yy", "zz"]
    docs = [(i % 150 if i % 40 else None, r.choice([" ", "-", "\n"]).join(r.choices(words, weights=range(10, 0, -1), k=r.randrange(0, 12)))) for i in range(300)]
    docs += [(7, None), (8, ""), (9, "!?"), (10, "ab " * 3000), (10, "ab " * 3000)]
    items = [(1, "AB zz"), (1, "yy ab"), (2, "nothing here"), (3, None), (None, "e öl"), (5, "Öl Öl, B2"), (6, "ΣΤ x1 ff cd")]
    monkeypatch.setattr(ball_search, "TREE", 60)
    monkeypatch.setattr(ball_search, "LEAF", 3)
    if blocks > 1:
        monkeypatch.setattr(ball_search, "BLOCK_BYTES", 12)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("item_id", F.lit(0)).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("rank", F.lit("r"))
    assert rows(rank_documents(frame, asked, top=9)) == by_hand(docs, items, top=9)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert rank_documents(docs.limit(0), items).count() == 0
    assert rank_documents(docs, items.limit(0)).count() == 0
    assert rank_documents(docs.withColumn("text", F.lit("!!")), items).count() == 0
    assert rows(rank_documents(docs, items)) == by_hand([(1, "some words")], [(1, "words")])


def test_pieces_end_between_terms(monkeypatch):
    text = " ".join(f"w{i % 17}" for i in range(500)) + " " + "w" * 300
    known = {f"w{i}".encode(): i for i in range(17)} | {b"w" * 300: 17}
    whole = term_counts(text, known)
    monkeypatch.setattr(ball_search, "_PIECE", 41)
    assert term_counts(text, known) == whole and whole[0] == 501 and whole[2][17] == 1


def test_no_bound_is_too_low():
    """Whatever lies below a node scores no more than its bound."""
    r = np.random.default_rng(2)
    sizes = r.integers(1, 9, 200)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    terms = np.concatenate([np.sort(r.choice(30, n, replace=False)) for n in sizes])
    weights = r.integers(0, 9000, 30)
    values = weights[terms] * r.integers(1, 10**6, len(terms))
    tree = ball_search.Tree(starts, terms, values, weights)
    scores = np.zeros((200, 30), dtype=np.int64)
    scores[np.repeat(np.arange(200), sizes), terms] = values
    for _ in range(40):
        asked = np.sort(r.choice(30, 6, replace=False))
        bounds = tree.bounds(np.searchsorted(tree.used, asked))
        for node, bound in enumerate(bounds):
            assert scores[tree.order[tree.first[node] : tree.last[node]]][:, asked].sum(1).max() <= bound


def test_subtrees_are_pruned(spark):
    """Two languages: an item of one opens no leaf of the other."""
    r = random.Random(4)
    texts = [" ".join(r.choices([f"{'ab'[i % 2]}{k}" for k in range(40)], k=15)) for i in range(800)]
    known = {f"{x}{k}".encode(): 40 * (x == "b") + k for x in "ab" for k in range(40)}
    counted = [term_counts(t, known) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(c[1]) for c in counted])])
    at, tf = (np.concatenate([c[i] for c in counted]) for i in (1, 2))
    tree = ball_search.Tree(starts, at, ball_search.share(tf.astype(np.int64), 15, 800, 12_000) * 900, np.full(80, 900))
    best = ball_search.Best(10)
    best.ids = list(range(800))
    opened = tree.search(np.arange(5), best)
    assert 0 < opened <= sum(x < 0 for x in tree.left) / 2 + 1 and len(best.rows) == 10
