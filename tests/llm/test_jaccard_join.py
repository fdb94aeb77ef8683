import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard_join
from ledgerloom.llm.components import components
from ledgerloom.llm.jaccard_join import jaccard_components, tree_links


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < n else zip(*(words[i:] for i in range(n)), strict=False))


def brute(rows, n, percent):
    """doc_id, size and component of each row, all pairs compared."""
    sets = [shingle_set(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(i, j) for h in holders.values() if len(h) > 1 for k, i in enumerate(h) for j in h[k + 1 :]}
    for i, j in pairs:
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_documents_like_brute_force(spark, n, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert got(jaccard_components(docs, n, percent)) == brute(rows, n, percent)


@pytest.mark.parametrize("block", [4, 256])
def test_planted_groups(spark, monkeypatch, block):
    """Exact copies, chains of near copies around the threshold, shared passages, odd rows."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(100 + i, "Same  text\tof\nall these\x0bcopies") for i in range(20)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [(200 + i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(8))) for i in range(20)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "ONE two"), (305, "one two three"), (None, "one two"), (None, "alone here"), (303, "one two")]
    rows += [(400, "word " * 30_000), (401, "word " * 20_000), (402, "é x y z ä"), (403, "É x y z ä")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("size", F.lit(1))
    for n, percent in ((4, 85), (5, 80), (2, 60)):
        assert got(jaccard_components(docs.repartition(5), n, percent)) == brute(rows, n, percent)
    assert jaccard_components(docs.limit(0), 4, 85).count() == 0


def test_joined_by_shuffling(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert got(jaccard_components(docs, 4, 85)) == brute([tuple(r) for r in docs.collect()], 4, 85)


def test_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(3)
    for _ in range(40):
        pool = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(1, 40))) for _ in range(rng.integers(2, 30))]
        percent = int(rng.integers(30, 95))
        want, found = jaccard_join.Union(list(range(len(sets)))), jaccard_join.Union(list(range(len(sets))))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    want.up[want.find(i)] = want.find(j)
        for i, j in tree_links(sets, None, list(range(len(sets))), percent):
            found.up[found.find(i)] = found.find(j)
        same = [want.find(i) == want.find(j) for i in range(len(sets)) for j in range(i)]
        assert same == [found.find(i) == found.find(j) for i in range(len(sets)) for j in range(i)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1200)] + [(1, 1), (None, 3), (5, 5)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {(r["node"], r["component"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in up}


def test_words_of_pieces(monkeypatch):
    """Where a long text is cut does not change the hash of a word."""
    text = "Ab  cd\té " * 40 + "x" * 300 + " end"
    whole = jaccard_join.word_hashes(text)
    monkeypatch.setattr(jaccard_join, "PIECE", 37)
    assert (jaccard_join.word_hashes(text) == whole).all() and len(whole) == 122


def test_memory_of_a_long_text():
    """Hashing 20 MB takes a few bytes a byte of text, and keeps nothing."""
    text = "some words of a text " * 1_000_000
    tracemalloc.start()
    words = jaccard_join.word_hashes(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words) == 5_000_000 and most < 9 * len(text)
