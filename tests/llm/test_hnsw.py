import tracemalloc

import numpy as np
import pytest

from ledgerloom.llm import hnsw
from ledgerloom.llm.hnsw import near_vectors


def brute(rows, threshold=0.95):
    """(vec_id, links, component, kept) by all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if ok[i] and ok[j] and len(a) == len(b):
                a64, b64 = np.asarray(a, np.float64), np.asarray(b, np.float64)
                if a64 @ b64 / (np.linalg.norm(a64) * np.linalg.norm(b64)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, links[i], least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)]


def planted(rng, n, d=16):
    base = rng.standard_normal((n // 4, d))
    rows = [base[rng.integers(len(base))] + rng.standard_normal(d) * rng.choice([0.0, 0.1, 0.2, 0.3]) for _ in range(n)]
    return [[float(np.float32(x)) for x in r] for r in rows]


@pytest.mark.parametrize(("shards", "size"), [(1, 1 << 20), (6, 1 << 20), (6, 2000)])
def test_same_as_brute_force(spark, monkeypatch, shards, size):
    monkeypatch.setattr(hnsw, "SHARDS", shards)
    monkeypatch.setattr(hnsw, "SHARD_BYTES", size)
    rng = np.random.default_rng(5)
    rows = list(enumerate(planted(rng, 300)))
    rows += [(1000 + i, rows[7][1]) for i in range(20)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [float("inf")] * 16)]
    rows += [(2006, [1.0, 0.0]), (2007, [2.0, 0.0]), (3, rows[3][1]), (None, rows[4][1])]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "vec_id long, embedding array<float>, label int, node string")
    found = near_vectors(df.repartition(3)).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found), key=str)
    assert all((r["recall"] is None) == (2000 <= (r["vec_id"] or 0) <= 2005) for r in found) and min(r["recall"] or 1 for r in found) >= hnsw.AUDIT_RECALL
    assert got == sorted(brute(rows), key=str)
    assert near_vectors(df.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    """All links of sf0.01 against brute force."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(table).collect())
    assert got == sorted(brute(rows))


def test_full_beams_widen_until_all_links_are_found():
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(24)
    crowd = centre + rng.standard_normal((900, 24)) * 0.05
    rows = np.concatenate([crowd, rng.standard_normal((2000, 24))])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    graph = hnsw.Graph(rows, 0.95)
    found = {(a, b) for q, n in graph.near(rows.astype(np.float32), 0.95) for a, b in zip(q.tolist(), n.tolist(), strict=True)}
    want = set(zip(*(x.tolist() for x in np.nonzero(rows @ rows.T >= 0.95)), strict=True))
    assert len(want & found) >= 0.99 * len(want) and len(want) > 500_000


def test_a_graph_travels_as_rows():
    rows = np.random.default_rng(3).standard_normal((3000, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    graph = hnsw.Graph(rows, 0.95)
    again = hnsw.Graph.from_links(rows, graph.links(), graph.beam)
    assert again.entry == graph.entry and len(again.levels) == len(graph.levels) > 1
    assert all((a == b).all() for a, b in zip(again.levels, graph.levels, strict=True))


def test_memory_of_a_dense_shard():
    """All vectors alike: every cell is a pair, and few of them are held at a time."""
    r = np.random.default_rng(0)
    vectors = np.ones((20_000, 8)) + 1e-3 * r.standard_normal((20_000, 8))
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    graph = hnsw.Graph.__new__(hnsw.Graph)
    graph.vectors, graph.beam = vectors, len(vectors)
    tracemalloc.start()
    pairs = sum(len(q) for q, _ in graph.near(vectors[:1_000], 0.95))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == 1_000 * 20_000 and most < 300 << 20
